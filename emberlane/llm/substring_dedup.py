"""Substring dedup by seed and extend: winnowed anchors, extended both ways, maximal repeats over a length threshold."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import bit_filter, bit_flag, drop_stored, row_keys, spread_join, stored
from emberlane.llm.words import buffers, slices, windows, word_hashes

#: Words of a seed. A window of L words holds L - SEED + 1 seeds and is anchored at the one with the least hash.
SEED = 12
#: Bytes of a word's hash that extensions compare; seeds that are extended at a time, about.
WORD, SEEDS = 5, 20_000
#: Occurrences from which on the rows of a key are dealt to many tasks.
HOT = 2_000
_LOW = np.uint64((1 << 24) - 1)


def anchors(words: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchored runs of windows: (text, anchor hash, anchor's place in its text, first window in its text, number of windows).

    Windows of ``length`` words that follow each other and share their anchor form a run. Equal windows have equal anchors at
    equal distances, wherever they are.
    """
    none = np.zeros(0, np.int64)
    m = len(words) - length + 1
    if m <= 0:
        return none, none, none, none, none
    seeds = windows(words, SEED)
    c = (seeds & ~_LOW) | (_LOW - (np.arange(len(seeds), dtype=np.uint64) & _LOW))  # ties go to the last
    span, have = length - SEED + 1, 1
    least = c
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: m], least[span - have : span - have + m])
    at = np.arange(m, dtype=np.uint64)
    where = at + ((_LOW - (least & _LOW) - at) & _LOW)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:m]
    valid = at.astype(np.int64) + length <= firsts[text + 1]
    head = valid.copy()
    head[1:] &= (where[1:] != where[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    s = np.flatnonzero(head)
    tail = valid.copy()
    tail[:-1] &= (where[1:] != where[:-1]) | (text[1:] != text[:-1]) | ~valid[1:]
    e = np.flatnonzero(tail)
    return text[s], seeds[where[s].astype(np.int64)].view(np.int64), where[s].astype(np.int64) - firsts[text[s]], s - firsts[text[s]], e - s + 1


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row under two hashes of its id and text: rows that agree in both have the same repeats, so they may share them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *row_keys(F.col(id_col), text))


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            for i, _, data, offs in slices(batch.column(0)):
                words, firsts = word_hashes(data, offs, lower=False)
                text, anchor, at, first, n = anchors(words, firsts, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k1[i + text], k2[i + text], anchor, at.astype(np.int32), first.astype(np.int32), n.astype(np.int16))], names=["k1", "k2", "anchor", "at", "first", "n"]
                )

    return run


def _around(words: np.ndarray, firsts: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, outside: int) -> np.ndarray:
    """The words that windows anchored at ``at`` reach, as rows of hashes of :data:`WORD` bytes; ``outside`` beyond the text."""
    place = firsts[doc][:, None] + at[:, None] + np.arange(SEED - length, length)
    inside = (place >= firsts[doc][:, None]) & (place < firsts[doc + 1][:, None])
    out = (words[np.where(inside, place, 0)] >> np.uint64(64 - 8 * WORD)) | np.uint64(2)
    out[~inside] = outside
    return out


def _listed(batch: pa.RecordBatch, i: int, j: int) -> tuple[pa.StructArray, np.ndarray]:
    """The entries of rows i to j's lists, one after the other, and the row (from 0) of each."""
    part = batch.column("seeds").slice(i, j - i)
    return part.flatten(), np.repeat(np.arange(j - i), part.value_lengths().to_numpy())


def _rows_of(seeds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about :data:`SEEDS` seeds."""
    i = 0
    while i < len(seeds):
        j = max(i + 1, int(np.searchsorted(np.cumsum(seeds[i:]), SEEDS, side="right")) + i)
        yield i, j
        i = j


def _contexts(length: int):
    """The words around each representative occurrence, from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("seeds").value_lengths().to_numpy()
            for i, j in _rows_of(sizes):
                data, offs = buffers(batch.column("text").slice(i, j - i))
                words, firsts = word_hashes(data, offs, lower=False)
                seeds, doc = _listed(batch, i, j)
                near = _around(words, firsts, doc, seeds.field("at").to_numpy().astype(np.int64), length, 0)
                raw = near.astype("<u8").view(np.uint8).reshape(*near.shape, 8)[:, :, :WORD]
                yield pa.RecordBatch.from_arrays([seeds.field("anchor"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["anchor", "near"])

    return run


def extended(mine: np.ndarray, theirs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words match to the left and to the right of the anchors of two occurrences; -1 to the left where anchors differ."""
    same, left = mine == theirs, length - SEED
    to_left = np.cumprod(same[:, :left][:, ::-1], axis=1).sum(1)
    to_right = np.cumprod(same[:, left + SEED :], axis=1).sum(1)
    return np.where(same[:, left : left + SEED].all(1), to_left, -1), to_right


def _extension(length: int):
    """Every occurrence against its anchor's representative: windows that match (kind 0: here, kind 1: there), and those that don't (kind 2)."""
    names = ["kind", "k1", "k2", "key", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for i, j in _rows_of(batch.column("seeds").value_lengths().to_numpy()):
                data, offs = buffers(batch.column("text").slice(i, j - i))
                words, firsts = word_hashes(data, offs, lower=False)
                own = windows(words, length).view(np.int64)
                seeds, doc = _listed(batch, i, j)
                at, first, n = (seeds.field(f).to_numpy().astype(np.int64) for f in ("at", "first", "n"))
                anchor = seeds.field("anchor").to_numpy()
                raw = np.frombuffer(b"".join(seeds.field("near").to_pylist()), dtype=np.uint8).reshape(len(at), 2 * length - SEED, WORD)
                theirs = np.zeros((len(at), 2 * length - SEED, 8), dtype=np.uint8)
                theirs[:, :, :WORD] = raw
                to_left, to_right = extended(_around(words, firsts, doc, at, length, 1), theirs.view("<u8")[:, :, 0], length)
                lo, hi = np.maximum(first - at, -to_left), np.minimum(first + n - 1 - at, to_right - (length - SEED))
                hit = (to_left >= 0) & (lo <= hi)
                lo, hi = np.where(hit, lo, 1), np.where(hit, hi, 0)
                rows = [(0, k1[i + doc[hit]], k2[i + doc[hit]], anchor[hit], (at + lo)[hit], (hi - lo + 1)[hit])]
                there = np.unique(np.stack([anchor[hit], lo[hit], (hi - lo + 1)[hit]], axis=1), axis=0) if hit.any() else np.zeros((0, 3), np.int64)
                rows.append((1, np.zeros(len(there), np.int64), np.zeros(len(there), k2.dtype), there[:, 0], there[:, 1], there[:, 2]))
                each = np.repeat(np.arange(len(n)), n)
                start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                out = (start < (at + lo)[each]) | (start > (at + hi)[each])
                each, start = each[out], start[out]
                rows.append((2, k1[i + doc[each]], k2[i + doc[each]], own[firsts[doc[each]] + start], start, np.ones(len(start), np.int64)))
                for kind, a, b, key, f, m in rows:
                    if len(f):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), kind, np.int8)), pa.array(a), pa.array(b), pa.array(key), pa.array(f.astype(np.int32)), pa.array(m.astype(np.int32))], names=names)

    return run


def _removal(length: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            data, offs = buffers(texts)
            n_words, n_removed, kept, found = [], [], [], []
            for r in range(batch.num_rows):
                words = data[offs[r] : offs[r + 1]].tobytes().split()  # bytes.split knows just these six blanks
                runs = lists[r].as_py() or []
                spans: list[tuple[int, int]] = []
                for a, n in sorted((x["first"], x["n"]) for x in runs):
                    b = a + n + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                    else:
                        spans.append((a, b))
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in spans))
                found.append([{"begin": a, "end": b} for a, b in spans])
                for a, b in reversed(spans):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                names=schema.names,
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept (the text without repeats), repeats (word spans).

    A window of ``length`` words repeats if its words start anywhere else too, in the same text or another. Seeds: every
    window is anchored at its least seed of :data:`SEED` words, and only anchors that occur again go on. One occurrence
    represents its anchor, by preference in the same few texts; every other occurrence is paired with it and extended to the
    left and to the right, word by word, as far as the anchor's windows reach, which finds the windows that match in both.
    Matches of neighbouring anchors merge into maximal repeats. So a passage shared by very many texts is linear work, and
    rows of such a hot anchor are dealt to many tasks. An occurrence may match another one where both differ from the
    representative: windows that the extension leaves over are counted by hash, which is exact for them, as any window that
    equals one of the representative's is found by extension already.

    Null texts have no words. A repeated row repeats all of its windows. Ids may be null or repeated: rows are matched
    by two hashes of id and text. Words are compared by 40 bits in extensions, seeds and windows by 64. Extra columns are
    ignored; an empty table gives an empty result.
    """
    length = int(length)
    if length <= SEED:
        raise ValueError(f"length must exceed {SEED}")
    rows = _keys(docs, id_col, text_col)
    hot = lambda counts, key: counts.where(F.col("c") > HOT).select(key)
    found = stored(rows.select("text", "k1", "k2").mapInArrow(_scan(length), "k1 long, k2 int, anchor long, at int, first int, n short"))
    again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "at")).alias("rep")).where("c > 1")
    again = stored(again.select("anchor", "c", F.col("rep.k1").alias("r1"), F.col("rep.k2").alias("r2"), F.col("rep.at").alias("r_at")))

    listed = stored(again.groupBy(F.col("r1").alias("k1"), F.col("r2").alias("k2")).agg(F.collect_list(F.struct("anchor", F.col("r_at").alias("at"))).alias("seeds")))
    texts = lambda lists: bit_filter(rows, F.col("k1"), lists, "k1").dropDuplicates(["k1", "k2"]).join(lists, ["k1", "k2"]).select("k1", "k2", "text", "seeds")
    near = stored(texts(listed).mapInArrow(_contexts(length), "anchor long, near binary"))

    facts = again.join(near, "anchor").select("anchor", "near", F.struct("r1", "r2", "r_at").alias("rep"))
    others = spread_join(bit_filter(found, F.col("anchor"), again, "anchor"), facts, "anchor", hot(again, "anchor"), "inner").where("struct(k1, k2, at) != rep")
    seeds = stored(others.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "at", "first", "n", "near")).alias("seeds")))
    met = stored(texts(seeds).mapInArrow(_extension(length), "kind byte, k1 long, k2 int, key long, first int, n int"))
    drop_stored(near, seeds)
    here = met.where("kind = 0").select("k1", "k2", "first", "n")
    there = met.where("kind = 1").select(F.col("key").alias("anchor"), "first", "n").distinct().join(again, "anchor").select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), (F.col("r_at") + F.col("first")).alias("first"), "n")
    rest = met.where("kind = 2").withColumnRenamed("key", "window")
    twice = stored(rest.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    left = spread_join(rest, twice.select("window"), "window", hot(twice, "window"), "left_semi").select("k1", "k2", "first", "n")
    listed_again = stored(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2"))
    twins = bit_filter(found, F.col("k1"), listed_again, "k1").join(listed_again, ["k1", "k2"], "left_semi").select("k1", "k2", "first", F.col("n").cast("int").alias("n"))

    spans = here.union(there).union(left).union(twins).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    spans = stored(spans)
    drop_stored(found, again, listed, met, twice, listed_again)
    out = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    flagged = bit_flag(rows, F.col("k1"), spans, "k1", "may")  # texts without repeats stay where they are
    rest = flagged.where("not may").select("id", "text", F.lit(None).cast(spans.schema["runs"].dataType).alias("runs"))
    joined = flagged.where("may").join(spans, ["k1", "k2"], "left").select("id", "text", "runs")
    return rest.union(joined).mapInArrow(_removal(length, out), out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """(id, text) with every repeated window removed."""
    return repeated_spans(docs, id_col, text_col, length).select(F.col(id_col), F.col("kept").alias(text_col))

