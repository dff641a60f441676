"""Language ID in two steps: the family first, then one-versus-one linear SVMs between its languages."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.words import _LOWER, slices

#: Buckets of byte pairs and of byte triples; texts whose profiles are held at a time (32 KiB each).
BUCKETS, ROWS = 4096, 512
#: Labelled texts that are learned from, about, at most: of one language, of all; and languages.
MAX_PER_LANGUAGE, MAX_SAMPLE, MAX_LANGUAGES = 600, 6_000, 500
UNKNOWN = "und"


def profiles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, profiles, which rows hold ASCII letters) for runs of texts; a profile is the root of the shares of hashed byte pairs and triples."""
    for i, j, data, offs in slices(texts, 1 << 20, ROWS):
        b = _LOWER[data].astype(np.uint32)
        two = ((b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)) >> np.uint32(20)) if len(b) > 1 else b[:0]
        three = ((b[:-2] * np.uint32(0xC2B2AE3D) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(20)) if len(b) > 2 else b[:0]
        letter = (b >= 97) & (b <= 122)
        x = np.zeros((j - i, 2 * BUCKETS), dtype=np.float32)
        has = np.zeros(j - i, dtype=bool)
        for r in range(j - i):
            a, e = offs[r], offs[r + 1]
            has[r] = letter[a:e].any()
            for k, (grams, n) in enumerate(((two, 2), (three, 3))):
                if e - a >= n:
                    c = np.bincount(grams[a : e - n + 1], minlength=BUCKETS)
                    x[r, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(c / (e - a - n + 1) / 2)
        yield i, x, has


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, c: float = 20.0) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    rate = 1 / (1 + 2 * c * 2.1)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * c * (x.T @ (weight * slack * y)))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Families, and the SVM of each pair: of families, and of languages within a family."""

    def __init__(self, x: np.ndarray, names: list[str]) -> None:
        self.languages = sorted(set(names))
        y = np.array([self.languages.index(n) for n in names], dtype=int)
        n = len(self.languages)
        self.family = self._families(x, y, n)
        self.pairs: list[tuple[str, int, int]] = []
        weights = []
        for kind, of, groups in (("family", self.family[y] if n else y, [list(range(max(self.family, default=-1) + 1))]), ("language", y, [list(np.flatnonzero(self.family == f)) for f in range(max(self.family, default=-1) + 1)])):
            for group in groups:
                for a, b in combinations(group, 2):
                    at = (of == a) | (of == b)
                    self.pairs.append((kind, int(a), int(b)))
                    weights.append(_svm(x[at], np.where(of[at] == a, 1.0, -1.0)))
        self.weights = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((2 * BUCKETS + 1, 0), dtype=np.float32)

    @staticmethod
    def _families(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """Languages merged by the average likeness of their mean profiles until about the root of their number is left, two at least.

        One or two languages are one family.
        """
        groups = [[k] for k in range(n)]
        if n:
            mean = np.stack([x[y == k].mean(0) for k in range(n)])
            mean -= mean.mean(0)  # what all languages share says nothing
            mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
            like = mean @ mean.T
        while len(groups) > (max(2, round(n**0.5)) if n > 2 else 1):
            a, b = max(combinations(range(len(groups)), 2), key=lambda p: like[np.ix_(groups[p[0]], groups[p[1]])].mean())
            groups[a] += groups.pop(b)
        family = np.zeros(n, dtype=int)
        for f, group in enumerate(groups):
            family[group] = f
        return family

    def _decide(self, kind: str, members: list[int], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, then by summed margins; and the probability of its closest duel."""
        rows = len(margins)
        if len(members) == 1:
            return np.full(rows, members[0]), np.ones(rows)
        place = {m: k for k, m in enumerate(members)}
        votes, lowest = np.zeros((rows, len(members))), np.full((rows, len(members)), np.inf)
        for k, (what, a, b) in enumerate(self.pairs):
            if what == kind and a in place and b in place:
                m = margins[:, k]
                for c, s in ((a, m), (b, -m)):
                    votes[:, place[c]] += (s > 0) + 1e-3 * np.tanh(s)
                    lowest[:, place[c]] = np.minimum(lowest[:, place[c]], s)
        win = votes.argmax(1)
        return np.array(members)[win], 1 / (1 + np.exp(-3 * np.clip(lowest[np.arange(rows), win], -9, 9)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        families, sure = self._decide("family", list(range(max(self.family) + 1)), margins)
        best = np.zeros(len(x), dtype=int)
        for f in np.unique(families):
            at = families == f
            win, p = self._decide("language", list(np.flatnonzero(self.family == f)), margins[at])
            best[at] = win
            sure[at] *= p
        return [self.languages[k] for k in best], sure


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_language: int = MAX_PER_LANGUAGE) -> DataFrame:
    """One row per document: ``id_col``, held_out, lang_pred (``und`` where the text is null or has no letter), score 0 to 1.

    Learns from texts with a language whose id is not ``held_out`` (a function from the id column to a boolean column):
    all, or about ``max_per_language`` per language and :data:`MAX_SAMPLE` in all, chosen by a hash of id and text, so the driver
    holds some 100 MB of profiles however many languages there are. More than :data:`MAX_LANGUAGES` languages raise a
    ValueError. Profiles of whole texts; every prediction uses its text alone. One counting pass, one pass over the sample,
    one over all texts; no text is shuffled.

    Without any labelled text all predictions are ``und`` with score 0. A null id is not held out. Rows that repeat an id
    or a text get equal answers; other columns, whatever their names, have no effect; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    flag = F.coalesce(held_out(F.col("id")), F.lit(False))
    learn = docs.where(~flag & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in learn.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    most = min(max_per_language, max(1, MAX_SAMPLE // max(1, len(counts))))
    u = F.pmod(F.xxhash64(F.lit(23), F.col("id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        if n > most:
            share = F.when(F.col("lang") == lang, F.lit(most / n)).otherwise(share)

    def run_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, _ in profiles(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["lang", "x"])

    sample = learn.where(u < share).select("lang", "text").mapInArrow(run_sample, "lang string, x binary").toArrow()
    x = np.stack([np.frombuffer(b, dtype=np.float16) for b in sample.column("x").to_pylist()]).astype(np.float32) if sample.num_rows else np.zeros((0, 2 * BUCKETS), np.float32)
    model = spark.sparkContext.broadcast(Model(x, sample.column("lang").to_pylist()))
    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, texts = [], [], batch.column(2)
            for i, x, has in profiles(texts):
                pred, score = model.value.predict(x)
                for r in np.flatnonzero(~has):
                    if not any(ch.isalpha() for ch in texts[i + int(r)].as_py() or ""):
                        pred[r], score[r] = UNKNOWN, 0.0
                names += pred
                scores.append(score)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score.astype(float))], names=schema.names)

    return docs.select("id", flag.alias("held_out"), "text").mapInArrow(run, schema)
