"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""
from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import stored
from emberlane.llm.words import mix, slices, spans, word_hashes

#: Words that a worker remembers; bytes encoded at a time; pieces that one ranking task gets on average at most.
WORDS, BLOCK, RANK_ROWS = 1_000_000, 1 << 20, 100_000
#: A run of Latin letters, and ASCII marks behind it that a tokenizer of words keeps apart from letters.
_STEM = re.compile("([A-Za-z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+)([!-/:-@\\[-`{-~]*)")
_encoders: dict[str, "_Encoder"] = {}


class _Encoder:
    """Ids of texts, put together word by word from a table of words seen before.

    The tokenizer drops white space and never merges over it, so encoding a text's words (runs between blanks) gives the
    ids of the whole text. Words are found in the table by their 64-bit hashes, a batch at a time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self._clear()

    def _clear(self) -> None:
        self.slots = 1 << 16
        self.hashes, self.n = np.zeros(1 << 15, dtype=np.uint64), 0
        self.index = np.full(self.slots, -1, dtype=np.int32)
        self.starts, self.flat, self.used = np.zeros((1 << 15) + 1, dtype=np.int64), np.zeros(1 << 17, dtype="<u4"), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Table rows of hashes, -1 where unknown: open addressing, all probes at once."""
        mask = np.uint64(self.slots - 1)
        at = (h & mask).astype(np.int64)
        row = self.index[at]
        todo = np.flatnonzero((row >= 0) & (self.hashes[row] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) & (self.slots - 1)
            row[todo] = self.index[at[todo]]
            todo = todo[(row[todo] >= 0) & (self.hashes[row[todo]] != h[todo])]
        return row

    def _place(self, rows: np.ndarray) -> None:
        at = (self.hashes[rows] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(rows):
            free = self.index[at] < 0
            self.index[at[free]] = rows[free]
            lost = self.index[at] != rows  # taken before, or by another of these
            rows, at = rows[lost], (at[lost] + 1) & (self.slots - 1)

    def _add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        n, used = self.n + len(h), self.used + int(sizes.sum())
        if n > len(self.hashes):
            size = 1 << n.bit_length()
            self.hashes = np.concatenate([self.hashes[: self.n], np.zeros(size - self.n, dtype=np.uint64)])
            self.starts = np.concatenate([self.starts[: self.n + 1], np.zeros(size - self.n, dtype=np.int64)])
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(used + used // 2 - self.used, dtype="<u4")])
        self.hashes[self.n : n] = h
        self.starts[self.n + 1 : n + 1] = self.used + np.cumsum(sizes)
        if used > self.used:
            self.flat[self.used : used] = np.concatenate(ids)
        rows = np.arange(self.n, n)
        self.n, self.used = n, used
        if 2 * n > self.slots:
            self.slots = 1 << (2 * n).bit_length()
            self.index, rows = np.full(self.slots, -1, dtype=np.int32), np.arange(n)
        self._place(rows)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a in range(0, len(words), 8192):
            out += [np.asarray(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(words[a : a + 8192], add_special_tokens=False)]
        return out

    def _encode_stems(self, stems: list[str]) -> list[np.ndarray]:
        """Runs of Latin letters, many in one text: each is one word to the tokenizer, so its last id carries the word end."""
        if not hasattr(self, "ends"):
            self.ends = np.zeros(self.model.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        out: list[np.ndarray] = []
        for a in range(0, len(stems), 20_000):
            block = stems[a : a + 20_000]
            joined = [" ".join(block[k : k + 500]) for k in range(0, len(block), 500)]
            ids = np.concatenate([np.asarray(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(block) or cuts[-1] != len(ids):
                out += self._encode(block)
            else:
                out += [ids[u:v] for u, v in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        return out

    def _hash(self, words: list[str]) -> np.ndarray:
        data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return word_hashes(data, np.array([0, len(data)]), lower=True)[0]

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        """Add words by their hashes; Latin letters with marks behind are put together from the two."""
        split = [_STEM.fullmatch(w) for w in words]
        stems = list({m[1].encode().lower().decode() for m in split if m})  # ASCII only, as the hashes
        if stems:
            own = self._hash(stems)
            new = np.flatnonzero(self._find(own) < 0)
            self._add(own[new], self._encode_stems([stems[i] for i in new]))
        rest = np.flatnonzero(self._find(h) < 0)
        tails = {m[2] for i in rest if (m := split[i])}
        marks = dict(zip(tails, self._encode(list(tails)), strict=True))
        marked = [i for i in rest if split[i]]
        if marked:
            row = self._find(self._hash([split[i][1] for i in marked]))
            a, b = self.starts[row].tolist(), self.starts[row + 1].tolist()
            self._add(h[marked], [np.concatenate([self.flat[u:v], marks[split[i][2]]]) for u, v, i in zip(a, b, marked, strict=True)])
        plain = [i for i in rest if not split[i]]
        self._add(h[plain], self._encode([words[i] for i in plain]))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and where each text's ids begin.

        The tokenizer lower-cases, so words are known by their lower-case forms - but special strings are told apart by
        case before that, so runs with one of their openings keep their case, under hashes of their own.
        """
        raw = data.tobytes()
        special = b"<|" in raw
        h, firsts = word_hashes(data, offs, lower=not special)
        if special:
            h = mix(h ^ np.uint64(0x6A09E667F3BCC909))
        row = self._find(h)
        if len(missing := np.flatnonzero(row < 0)):
            new, first = np.unique(h[missing], return_index=True)
            if self.n and self.n + 2 * len(new) > WORDS:
                self._clear()
                missing = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            begin, end = spans(data, offs)
            words = [raw[begin[i] : end[i]].decode() for i in missing[first]]
            if special:
                self._add(new, self._encode(words))
            else:
                self._learn(new, words)
            row = self._find(h)
        size = self.starts[row + 1] - self.starts[row]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.starts[row] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[firsts]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than ``capacity``."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, _, data, offs in slices(batch.column(1), BLOCK):
                ids, firsts = encode(data, offs)
                for k, (u, v) in enumerate(zip(firsts[:-1], firsts[1:], strict=True), i):
                    whole = ids[u:v].tobytes() + end
                    for p, a in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[a : a + 4 * capacity]
                        row.append(k)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths) of the bins that hold all pieces; lengths of a bin in descending order.

    A bin opens with the longest piece left and takes the longest that fits until none does. Then its smallest piece, if
    it isn't the only one, gives way to two unpacked pieces where two fit the widened gap more tightly. The same bin is
    repeated as long as the pieces last, so there are about as many steps as lengths, whatever the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    bins = []

    def fits(gap: int, spare: dict[int, int]) -> int:
        i = bisect.bisect_right(sizes, gap) - 1
        while i >= 0 and left[sizes[i]] - spare.get(sizes[i], 0) <= 0:
            i -= 1
        return sizes[i] if i >= 0 else 0

    while sizes:
        used: dict[int, int] = {}
        held: list[int] = []
        gap = capacity
        while gap and (n := fits(gap, used)):
            take = max(1, min(left[n] - used.get(n, 0), gap // n)) if gap >= 2 * n else 1
            held += [n] * take
            used[n] = used.get(n, 0) + take
            gap -= n * take
        if gap and len(held) > 1:
            out = held[-1]
            wide = gap + out
            used[out] -= 1
            best = (out, 0, 0)
            lo, hi = 0, bisect.bisect_right(sizes, wide) - 1
            free = lambda n: left[n] - used.get(n, 0)
            while lo <= hi:  # two pieces with the largest sum that fits, by two pointers
                a, b = sizes[lo], sizes[hi]
                if a + b > wide or free(b) <= 0:
                    hi -= 1
                elif free(a) <= 0 or (lo == hi and free(a) < 2):
                    lo += 1
                else:
                    if a + b > best[0]:
                        best = (a + b, a, b)
                    lo += 1
            if best[1]:
                held.pop()
                for n in best[1:]:
                    used[n] = used.get(n, 0) + 1
                    held.append(n)
            else:
                used[out] += 1
        reps = min(left[n] // k for n, k in used.items() if k)
        bins.append((reps, sorted(held, reverse=True)))
        for n, k in used.items():
            left[n] -= k * reps
        if any(k and not left[n] for n, k in used.items()):
            sizes = [n for n in sizes if left[n]]
    return bins


def _slots(bins: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: from ``at`` on, ``k`` in each bin from ``first`` on, at ``offset``."""
    seen: dict[int, int] = {}
    rows = []
    first = 0
    for reps, held in bins:
        offset = 0
        for n in dict.fromkeys(held):
            k = held.count(n)
            rows.append((n, seen.get(n, 0), k, first, offset))
            seen[n] = seen.get(n, 0) + k * reps
            offset += k * n
        first += reps
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "at": a[:, 1], "k": a[:, 2], "first": a[:, 3], "offset": a[:, 4]}


def pack(pieces: DataFrame, capacity: int, key: list[str]) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) with sequence_id and offset; gapless from 0 in a sequence.

    Packing depends on lengths alone: their histogram (at most ``capacity`` rows) is planned on the driver, and the plan
    (bounded by ``capacity`` too) goes to all executors. Pieces find their places by rank within their length. Ranks
    are given in buckets of a length, as many as its pieces need, so a length that very many share is spread over
    tasks. Bucket and order come from a hash of ``key``; rows that repeat a key follow each other.
    """
    spark = pieces.sparkSession
    h = F.xxhash64(*key)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity), capacity))
    parts = F.broadcast(_parts(spark, counts))
    dealt = pieces.withColumn("_h", h).join(parts, "length").withColumn("_b", F.pmod("_h", F.col("_n")).cast("int"))
    from pyspark.sql import Window as W

    tally = dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = tally.withColumn("_before", F.sum("_c").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("length", "_b").orderBy("_h", *key))).join(before, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_r") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        p = plan.value
        i = np.searchsorted(p["length"] * (1 << 44) + p["at"], length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64), side="right") - 1
        d = rank.to_numpy(np.int64) - p["at"][i]
        k = p["k"][i]
        return pd.DataFrame({"sequence_id": p["first"][i] + d // k, "offset": p["offset"][i] + d % k * length.to_numpy(np.int64)})

    out = ranked.withColumn("_p", place("length", "_rank"))
    return out.select(*[F.col(f"`{c}`") for c in pieces.columns], F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def _parts(spark, counts: dict[int, int]) -> DataFrame:  # noqa: ANN001
    """How many buckets each length's pieces are ranked in: at most ``capacity`` rows."""
    rows = F.create_map(*[x for n, c in counts.items() if c > RANK_ROWS for x in (F.lit(n).cast("long"), F.lit(-(-c // RANK_ROWS)).cast("long"))]) if any(c > RANK_ROWS for c in counts.values()) else None
    base = spark.range(1, max(counts, default=0) + 1).withColumnRenamed("id", "length")
    return base.withColumn("_n", F.lit(1).cast("long") if rows is None else F.coalesce(rows[F.col("length")], F.lit(1)))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces of at most ``capacity`` tokens, each with its place in a sequence.

    A document is its ids and ``end_id``; null counts as empty (the end id alone). Only longer documents are cut. Pieces
    are written to the shared folder once, so the tokenizer runs once. Repeated ids are packed as often as listed.
    An empty table gives an empty result.
    """
    pieces = stored(token_pieces(docs, path, capacity, end_id, id_col, text_col))
    return pack(pieces, capacity, [id_col, "piece"])
