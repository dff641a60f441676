"""Counts of word n-grams over a whole corpus: texts in chunks, a count table partitioned by hash, an answer to every chunk.

An n-gram that many documents share travels once per chunk that holds it, so no key is hot; a count partition holds the
entries of one hash range and nothing else, so no task and no driver ever holds the whole table.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import stored
from emberlane.llm.words import mix, slices, word_hashes

#: Bytes of text whose n-grams travel together; entries of a count partition, about.
CHUNK, PARTITION = 8 << 20, 750_000
#: Bits of a word's hash: of V different words about V in 2 ** 49 / V meet another.
WORD_BITS = 48
_ZSTD = pa.Codec("zstd", compression_level=5)
CHUNK_TYPE = "chunk long, first long, ids array<{id}>, n long, sizes binary, vocab binary, codes binary"


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: planes that are all zeros cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpacked(data, n: int) -> np.ndarray:  # noqa: ANN001
    planes = np.frombuffer(_ZSTD.decompress(data, decompressed_size=8 * n, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _raw(words: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()


def _written(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seq = row = 0
        for batch in batches:
            for i, j, data, offs in slices(batch.column(1), size):
                words, firsts = word_hashes(data, offs, lower=True)
                vocab, codes, counts = np.unique(words >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
                rank = np.argsort(-counts, kind="stable")
                number = np.empty(len(rank), dtype=np.int64)
                number[rank] = np.arange(len(rank))
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                longs = [pa.array([v], pa.int64()) for v in ((task << 32) + seq, (task << 40) + row, len(words))]
                blobs = [pa.array([b], pa.binary()) for b in (packed(np.diff(firsts)), _raw(vocab[rank], bits), packed(number[codes]))]
                yield pa.RecordBatch.from_arrays([*longs[:2], ids, longs[2], *blobs], names=["chunk", "first", "ids", "n", "sizes", "vocab", "codes"])
                seq, row = seq + 1, row + j - i

    return run


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, word_bits: int = WORD_BITS) -> DataFrame:
    """Whole texts as word numbers (A-Z lower-cased) and hashes of so many bits, about ``size`` bytes of text a row, written once.

    ``first`` numbers a chunk's first row; its further rows follow, so every row has a number of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_written(size, word_bits), CHUNK_TYPE.format(id=kind)))


def vocabulary(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words of the one chunk in ``row``, the number of each word in it, and where each of its texts begins."""
    get = lambda c: row.column(c)[0].as_py()
    codes = unpacked(get("codes"), get("n")).astype(np.int64)
    known, raw = int(codes.max(initial=-1)) + 1, np.frombuffer(get("vocab"), dtype=np.uint8)
    width = len(raw) // max(1, known)
    vocab = np.zeros((known, 8), dtype=np.uint8)
    vocab[:, :width] = raw.reshape(known, width)
    vocab = mix(vocab.view("<u8").ravel())
    sizes = unpacked(get("sizes"), len(row.column("ids")[0])).astype(np.int64)
    return vocab, codes, np.concatenate(([0], np.cumsum(sizes)))


def opened(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the one chunk in ``row``, and where each of its texts begins."""
    vocab, codes, firsts = vocabulary(row)
    return vocab[codes], firsts


def _part_of(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Count partition of a hash: equal ranges, so a sorted run of hashes is also sorted by partition."""
    first = h >> np.uint64(bits - 32) if bits >= 32 else h << np.uint64(32 - bits)
    return (first * np.uint64(parts)) >> np.uint64(32)


def _dealt(entries: Callable, parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                hashes, counts, *more = entries(*opened(pa.Table.from_batches([batch.slice(r, 1)])))
                at = np.searchsorted(_part_of(hashes, parts, bits), np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(at))
                for some in np.array_split(full, max(1, len(full) // 64)):
                    gaps = [packed(np.diff(hashes[at[p] : at[p + 1]], prepend=np.uint64(0))) for p in some]
                    cols = [pa.array(np.full(len(some), batch.column("chunk")[r].as_py())), pa.array(some.astype(np.int32)), pa.array(np.diff(at)[some])]
                    cols += [pa.array(gaps, pa.binary()), pa.array([packed(counts[at[p] : at[p + 1]]) for p in some], pa.binary())]
                    cols += [pa.array([more[0][at[p] : at[p + 1]].astype("<u4").tobytes() if more else None for p in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["chunk", "p", "m", "hashes", "counts", "more"])

    return run


def same_runs(hashes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where in it a new key begins; ``more`` are further bits of the keys."""
    order = np.argsort(hashes, kind="stable")
    head = np.ones(len(hashes), dtype=bool)
    head[1:] = hashes[order][1:] != hashes[order][:-1]
    if more is not None:
        other = more[order][1:] != more[order][:-1]
        if (other & ~head[1:]).any():  # keys that agree in their first bits alone: sort by all
            order = np.lexsort((more, hashes))
            head[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, head


def gathered(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """One partition of the count table: entries of each row, their counts, an order that puts equal keys side by side, and where in it each key begins."""
    sizes = group.column("m").to_pylist()
    open_up = lambda name: [unpacked(b.as_buffer(), n) for b, n in zip(group.column(name), sizes, strict=True)]
    hashes, counts = np.concatenate([np.cumsum(d, dtype=np.uint64) for d in open_up("hashes")]), np.concatenate(open_up("counts"))
    more = [b for b in group.column("more") if b.is_valid]
    more = np.concatenate([np.frombuffer(b.as_buffer(), dtype="<u4") for b in more]) if more else None
    order, head = same_runs(hashes, more)
    return sizes, counts, order, np.flatnonzero(head)


def counts_elsewhere(counts: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For every entry the sum of the other entries of its key."""
    rest = np.empty_like(counts)
    rest[order] = np.repeat(np.add.reduceat(counts[order], begin), np.diff(begin, append=len(counts)))
    return rest - counts


def cut(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.array([packed(v) for v in np.split(values, np.cumsum(sizes)[:-1])], pa.binary())


def _elsewhere(group: pa.Table) -> pa.Table:
    """For every chunk's n-grams in one partition of the count table, their counts in all other chunks."""
    sizes, counts, order, begin = gathered(group)
    return pa.table({"chunk": group.column("chunk"), "p": group.column("p"), "m": group.column("m"), "rest": cut(counts_elsewhere(counts, order, begin), sizes)})


def answered(chunks: DataFrame, entries: Callable, expected: int, n_chunks: int, bits: int, answer: Callable | None = None, columns: str = "rest binary", own: DataFrame | None = None) -> DataFrame:
    """Each chunk (p = -1) together with the answers of all count partitions: to be grouped by ``chunk``.

    ``entries`` makes a chunk's sorted distinct hashes of ``bits`` bits, their counts, and where hashes alone are
    too few bits to tell keys apart, 32 more for each (the keys being sorted by both). Both shuffles have
    as many partitions as the ``expected`` entries and the chunks need, so tasks don't grow with the corpus. ``answer``
    makes another answer than counts elsewhere for the given number of partitions, with ``columns`` of its own; ``own`` are
    the rows that meet the answers, where that aren't the chunks themselves.
    """
    parts = max(8, expected // PARTITION + 1)
    dealt = chunks.mapInArrow(_dealt(entries, parts, bits), "chunk long, p int, m long, hashes binary, counts binary, more binary").repartition(parts, "p")
    totals = dealt.groupBy("p").applyInArrow(answer(parts) if answer else _elsewhere, f"chunk long, p int, m long, {columns}")
    both = (chunks if own is None else own).withColumn("p", F.lit(-1)).unionByName(totals, allowMissingColumns=True)
    return both.repartition(max(1, n_chunks), "chunk")


def answers(group: pa.Table, name: str = "rest") -> tuple[pa.Table, np.ndarray]:
    """A chunk's own row, and for its distinct hashes in order the counts in all other chunks, or another answer by its ``name``."""
    group = group.sort_by("p")
    some = [unpacked(b.as_buffer(), m.as_py()) for b, m in zip(group.column(name).slice(1), group.column("m").slice(1), strict=True)]
    return group.slice(0, 1), np.concatenate(some or [np.zeros(0, np.uint64)]).astype(np.int64)
