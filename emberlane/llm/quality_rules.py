"""Quality rules over whole documents: rules of one text, and lines that too many documents of a host share."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.llm.common import BROADCAST_ROWS, bit_filter, spread_join, stored
from emberlane.llm.words import buffers, slices, spans, windows, word_hashes

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words that a text has at least, and percent of its words within repeated 3-word windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A line goes where more than so many documents of its host have it, and more than so many percent of them; a document that
#: keeps less than so many percent of its words is depleted. Documents of one line from which on they are dealt to many tasks.
LINE_DOCS, LINE_PERCENT, LEFT_PERCENT, HOT = 20, 1, 50, 2_000
_SPACES = " \t\n\x0b\x0c\r"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each text how many of its words lie in 3-word windows that it holds twice or more."""
    n = len(firsts) - 1
    if len(words) < 4:
        return np.zeros(n, dtype=np.int64)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    grams = windows(words, 3)[inside]
    order = np.lexsort((grams, doc[inside]))
    same = (grams[order][1:] == grams[order][:-1]) & (doc[inside][order][1:] == doc[inside][order][:-1])
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[inside[order[again]] + k] = True
    return np.bincount(doc, weights=covered, minlength=n).astype(np.int64)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags)))
    return run[offsets[1:]] - run[offsets[:-1]]


def line_key(words: list[bytes]) -> int:
    """A line's 64-bit hash: its words lower-cased A-Z, joined by one space."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words).translate(_LOWER), digest_size=8).digest(), "little", signed=True)


def text_lines(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier line of the text, and the words that each normalised line has in all."""
    seen: set[bytes] = set()
    again, keys = 0, {}
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again += line in seen
            seen.add(line)
            key = line_key(words)
            keys[key] = keys.get(key, 0) + len(words)
    return again, keys


def _measured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column(batch.num_columns - 1)):
                words, firsts = word_hashes(data, offs, lower=False)
                starts, ends = spans(data, offs)
                inner = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=inner[1:])  # code points begin at bytes that don't continue one
                chars = np.concatenate(([0], np.cumsum(inner[ends] - inner[starts])))
                lines = [text_lines(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                sizes = np.concatenate(([0], np.cumsum([len(k) for _, k in lines]))).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array([v for _, k in lines for v in of(k)], pa.int64()))
                    for of in (dict.keys, dict.values)
                ]
                stats = [
                    np.diff(firsts), chars[firsts[1:]] - chars[firsts[:-1]], _sums(_IS_SYMBOL[data], offs),
                    np.array([n for n, _ in lines], dtype=np.int64), repeated_words(words, firsts),
                ]
                own = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, stats), *lists], names=names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, k1, k2, d1, d2, text): two hashes that tell rows apart, and two that tell the texts of a host apart."""
    col = lambda c: F.col(f"`{c}`")
    text = F.coalesce(col(text_col), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), col(host_col).cast("string")), F.lit("null"))
    return docs.select(
        col(id_col).alias("id"), host.alias("host"), F.xxhash64(text, host, col(id_col)).alias("k1"), F.hash(col(id_col), text).alias("k2"),
        F.xxhash64(text, host).alias("d1"), F.hash(text, host).alias("d2"), text.alias("text"),
    )


def frequent_lines(measured: DataFrame, docs: int = LINE_DOCS, percent: int = LINE_PERCENT) -> DataFrame:
    """(key, host, line, n): normalised lines that more than ``docs`` documents and ``percent`` percent of a host's hold.

    Equal texts of a host are one document here: whole copies are another operator's matter and make no line frequent.
    """
    once = measured.groupBy("host", "d1", "d2").agg(F.first("lines").alias("lines"))
    once = stored(once)
    hosts = once.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > docs)
    total = F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts
    over = counts.join(total, "host").where(F.col("n") * 100 > F.col("of") * percent)
    return stored(over.select(F.xxhash64("host", "line").alias("key"), "host", "line", "n"))


def _measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col, host_col)
    longs = [T.StructField(c, T.LongType()) for c in _STATS]
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("lines", "sizes")]
    out = T.StructType([*keyed.schema.fields[:-1], *longs, *arrays])
    return stored(keyed.mapInArrow(_measured(out.fieldNames()), out))


def _suspects(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """Frequent lines of each row, repeated rows once: (k1, k2, line, size)."""
    lines = measured.select("k1", "k2", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select(
        "k1", "k2", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"), F.xxhash64("host", "x.lines").alias("key")
    )
    some = bit_filter(lines, F.col("key"), frequent, "key").groupBy("key", "host", "line", "k1", "k2").agg(F.first("size").alias("size"))
    hot = frequent.where(F.col("n") > HOT).select("key")
    met = spread_join(some, frequent.select("key", F.col("host").alias("_host"), F.col("line").alias("_line")), "key", hot, "inner")
    return met.where("host = _host and line = _line").select("k1", "k2", "line", "size")


def base_failed() -> Column:
    """Fewer than :data:`LEAST_WORDS` words, or too large a share of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", left_percent: int = LEFT_PERCENT) -> DataFrame:
    """One row per document: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words.

    Lines are normalised (words lower-cased A-Z, joined by one space) and hashed; distinct documents are counted for each
    line and host (:func:`frequent_lines`); lines above the limits go, ``n_line_words`` of words in all, and a document that is
    left with less than ``left_percent`` percent of its words is rejected, as is one that fails the rules of a single text.

    Texts are read once, in one narrow pass; afterwards only line hashes move: counted with partial sums, so a line that all
    documents share is never gathered, and looked up through a bitmap of bounded size before rows of frequent lines, dealt
    to many tasks, join their counts. Null texts are empty and have no words; a null host is a host of its own; rows listed
    twice get the same answer, and count once for their lines; an empty table gives an empty result.
    """
    measured = _measure(docs, id_col, text_col, host_col)
    lost = _suspects(measured, frequent_lines(measured)).groupBy("k1", "k2").agg(F.sum("size").alias("lost"))
    rows = measured.select("id", "k1", "k2", *_STATS).join(lost, ["k1", "k2"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = base_failed()
    kept = ~failed & (100 * (F.col("n_words") - F.col("lost")) >= left_percent * F.col("n_words"))
    return rows.select(F.col("id").alias(id_col), *_STATS, failed.alias("base_failed"), kept.alias("kept"), F.col("lost").alias("n_line_words"))


def _without_lines(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            texts = []
            for r, gone in enumerate(batch.column(2).to_pylist()):
                lines = data[offs[r] : offs[r + 1]].tobytes().split(b"\n")
                some = set(gone or ())
                texts.append(b"\n".join(x for x in lines if not some or not x.split() or line_key(x.split()) not in some).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=names)

    return run


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", left_percent: int = LEFT_PERCENT) -> DataFrame:
    """(``id_col``, ``text_col``) of the documents that :func:`judge` keeps, without the lines that are too frequent in their host."""
    measured = _measure(docs, id_col, text_col, host_col)
    gone = _suspects(measured, frequent_lines(measured)).groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"), F.sum("size").alias("lost"))
    left = 100 * (F.col("n_words") - F.coalesce("lost", F.lit(0))) >= left_percent * F.col("n_words")
    stays = measured.where(~base_failed()).select("k1", "k2", "n_words").distinct().join(gone, ["k1", "k2"], "left").where(left)
    texts = _keyed(docs, id_col, text_col, host_col).join(stays.select("k1", "k2", "gone"), ["k1", "k2"])
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType())])
    return texts.select("id", "text", "gone").mapInArrow(_without_lines(out.fieldNames()), out)
