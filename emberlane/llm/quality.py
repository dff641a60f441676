"""Quality scores: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import bit_filter, stored
from emberlane.llm.words import slices, spans, windows, word_hashes

#: Labelled rows that the trees are fitted on at most (those with the smallest hash of their id).
MAX_TRAIN = 20_000
DEPTH, TREES, RATE, BINS, MIN_LEAF, RIDGE = 4, 120, 0.08, 64, 12, 1.0

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10,), "stop": b".", "comma": b",",
    "bang": b"!", "ask": b"?", "bar": b"|", "hash": b"#", "dollar": b"$", "percent": b"%", "amp": b"&", "star": b"*", "colon": b":;",
    "quote": b"\"'`", "bracket": b"()[]{}<>", "link": b"/\\@_=+~^", "dash": b"-", "wide": range(128, 256), "control": [*range(0, 9), *range(14, 32)],
}
_CLASS = np.zeros((256, len(_GROUPS)), dtype=np.float64)
for _i, _g in enumerate(_GROUPS.values()):
    _CLASS[list(_g), _i] = 1.0
STATISTICS = [*(f"share_{g}" for g in _GROUPS), "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "distinct_fours", "words_a_line", "repeated_lines", "stopped_lines"]


def _distinct(h: np.ndarray) -> tuple[int, int]:
    """Number of distinct values, and the count of the most frequent."""
    if not len(h):
        return 0, 0
    s = np.sort(h)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    return len(at) - 1, int(np.diff(at).max())


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of :data:`STATISTICS` per text, all from the whole text; null and empty texts give zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    k = len(_GROUPS)
    for i, j, data, offs in slices(texts):
        starts, ends = spans(data, offs)
        words, firsts = word_hashes(data, offs, lower=True)
        pairs, fours = windows(words, 2), windows(words, 4)
        length = ends - starts
        for r in range(i, j):
            a, b, u, v = offs[r - i], offs[r - i + 1], firsts[r - i], firsts[r - i + 1]
            if a == b:
                continue
            x, n, w = out[r], b - a, max(1, v - u)
            x[:k] = np.bincount(data[a:b], minlength=256) @ _CLASS / n
            lines = [s for s in data[a:b].tobytes().split(b"\n") if s.strip()]
            own = length[u:v]
            distinct, top = _distinct(words[u:v])
            x[k:] = (
                np.log1p(n), np.log1p(v - u), own.mean() if v > u else 0.0, (own <= 3).sum() / w, (own > 12).sum() / w, distinct / w, top / w,
                _distinct(pairs[u : max(u, v - 1)])[0] / w, _distinct(fours[u : max(u, v - 3)])[0] / w, (v - u) / max(1, len(lines)),
                1 - len(set(lines)) / max(1, len(lines)), sum(s.rstrip().endswith((b".", b"!", b"?")) for s in lines) / max(1, len(lines)),
            )
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth in three arrays: (tree, inner node) feature and threshold, (tree, leaf) value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the log loss on quantile histograms; every level of a tree is split at once."""
    n, m = x.shape
    if not n:
        return Trees(np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)), 0.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    feature, threshold, leaf = (np.zeros((TREES, k), dtype=d) for k, d in ((2**DEPTH - 1, np.int64), (2**DEPTH - 1, float), (2**DEPTH, float)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for d in range(DEPTH):
            width, first = 2**d, 2**d - 1
            best, bf, bt, bb = np.full(width, 1e-6), np.zeros(width, int), np.full(width, np.inf), np.full(width, BINS)
            for f in range(m):
                if not len(edges[f]):
                    continue
                at = node * BINS + binned[:, f]
                G, H, C = (np.bincount(at, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None))
                gl, hl, cl = G[:, :-1], H[:, :-1], C[:, :-1]
                gt, ht, ct = G[:, -1:], H[:, -1:], C[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cl < MIN_LEAF) | (ct - cl < MIN_LEAF)] = -1
                gain = gain[:, : len(edges[f])]
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best[better], bf[better], bt[better], bb[better] = gain[np.arange(width), at][better], f, edges[f][at[better]], at[better]
            feature[t, first : first + width], threshold[t, first : first + width] = bf, bt
            node = 2 * node + (binned[np.arange(n), bf[node]] > bb[node])
        G, H = (np.bincount(node, weights=w, minlength=2**DEPTH) for w in (g, h))
        leaf[t] = -RATE * G / (H + RIDGE)
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, start)


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "x"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _fit(table: DataFrame, labels: DataFrame, held_out, id_col: str, label_col: str, max_train: int) -> Trees:  # noqa: ANN001
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    learn = ~F.coalesce(held_out(F.col("id")), F.lit(False))
    sample = table.join(known.where(learn), "id").select("x", "y", F.xxhash64("id").alias("h")).orderBy("h", "y").limit(max_train).select("x", "y").toArrow()
    y = sample.column("y").to_numpy()
    x = np.asarray(sample.column("x").combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0)).reshape(len(y), len(STATISTICS))
    return fit_trees(x, y)


def score_quality(
    docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cutoff: float = 0.3, max_train: int = MAX_TRAIN,
) -> DataFrame:
    """One row per document: ``id_col``, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= ``cutoff``).

    ``held_out`` is a function from the id column to a boolean column; no label of such an id is used. Statistics of
    whole texts are computed once and written; the trees are fitted on the driver on at most ``max_train`` labelled rows
    and reach the workers as three small arrays. Rows without a label 0 or 1 teach nothing; without any labels every
    score is 0.5. Several labels of one id all teach, each as a row of its own. A null id is not held out and can't be
    labelled; null and empty texts are scored as texts of zeros. Rows that repeat an id are scored each by their own text;
    other columns, whatever their names, have no effect; an empty table gives an empty result.
    """
    table = stored(_features(docs, id_col, text_col))
    trees = docs.sparkSession.sparkContext.broadcast(_fit(table, labels, held_out, id_col, label_col, max_train))

    @F.pandas_udf("double")
    def score(v):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(trees.value.score(np.stack(v.to_numpy())) if len(v) else [])

    held = F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out")
    scored = table.select(F.col("id").alias(id_col), held, score("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cutoff, 1).otherwise(0))


def keep_good(
    docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cutoff: float = 0.3, max_train: int = MAX_TRAIN,
) -> DataFrame:
    """The documents that score at least ``cutoff``, all columns as they were; trees as in :func:`score_quality`, no shuffle of texts.

    Only labelled texts are measured for the fit; then one narrow pass scores and filters. Null ids and texts, repeats and
    columns of any name are kept or dropped by the row's own score; an empty table stays empty.
    """
    labelled = bit_filter(docs, F.col(id_col), labels.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "id")
    trees = docs.sparkSession.sparkContext.broadcast(_fit(_features(labelled, id_col, text_col), labels, held_out, id_col, label_col, max_train))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(trees.value.score(statistics(batch.column(at))) >= cutoff))

    return docs.mapInArrow(run, docs.schema)
