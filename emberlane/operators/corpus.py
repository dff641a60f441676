"""Corpus text: headed line lists, probe sets."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlane.functions import text as tx
from emberlane.operators.sampling import numbered
from emberlane.scratch import Scratch


def headed_lines(docs: DataFrame, header: Column, skip: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of texts with the last header above them: blank, boilerplate and all-digit lines go, headers become categories.

    ``header`` and ``skip`` are conditions on the column ``line`` (trimmed).
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[0-9]+$") & ~skip)
    mark = F.last(F.when(header, F.col("line")), ignorenulls=True).over(W.partitionBy(id_col).orderBy("line_no"))
    return lines.withColumn("category", F.coalesce(mark, F.lit("Uncategorized"))).where(~header).select(id_col, F.col("line_no").cast("long").alias("line_no"), "category", F.col("line").alias("text"))


def title_like() -> Column:
    """Header heuristic for corpora without a known list: letters only, title or upper case, no final stop."""
    line = F.col("line")
    return line.rlike("^[A-Z][A-Za-z '/()]+$") & ((F.initcap(line) == line) | (F.upper(line) == line))


def first_rows(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Exact (category, text) repeats once, the first by document and line."""
    t = lines.groupBy("category", "text").agg(F.min(F.struct(id_col, "line_no")).alias("_f"))
    return t.select("category", "text", F.col(f"_f.{id_col}").alias(id_col), F.col("_f.line_no").alias("line_no"))


def probe_set(seeds: DataFrame, text: str = "text", order: str = "seed_id") -> DataFrame:
    """Each seed as a grounded item and one item per transform that changes it, with sequential ids from probe_0000."""
    t = F.col(text)
    kinds = ((tx.flip_negation(t), "negation"), (tx.swap_recipient(t), "recipient"), (tx.refusal_to_consent(t), "refusal_consent"))
    none = F.lit(None).cast("string")
    items = [F.struct(F.lit(0).alias("k"), none.alias("drift_type"), none.alias("dangerous_variant"))]
    items += [F.when(v.isNotNull() & (v != "") & (v != t), F.struct(F.lit(i + 1).alias("k"), F.lit(name).alias("drift_type"), v.alias("dangerous_variant"))) for i, (v, name) in enumerate(kinds)]
    rows = seeds.select(order, t.alias("intended_text"), F.explode(F.array_compact(F.array(*items))).alias("_i")).select(order, "intended_text", "_i.*")
    rows = numbered(rows, [order, "k"], "_at")
    return rows.select(F.format_string("probe_%04d", F.col("_at") - 1).alias("message_id"), F.lit("message_critical").alias("category"), "intended_text", "drift_type", "dangerous_variant")


def word_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(word, zipf): how often a lower-cased word occurs in a billion words of the texts, as a logarithm to base 10."""
    words = df.select(F.explode(F.transform(tx.tokens(F.col(text)), F.lower)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return _zipf(words)


def _zipf(words: DataFrame) -> DataFrame:
    total = words.agg(F.sum("n").alias("_n"))
    return words.crossJoin(F.broadcast(total)).select("word", F.log10(F.col("n") * 1e9 / F.col("_n")).alias("zipf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = re.compile(tx.TOKEN)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            counts = [Counter(w.lower() for w in token.findall(t or "")) for t in part.column(1).to_pylist()]
            at = [i for i, c in enumerate(counts) for _ in c]
            ids = part.column(0).take(pa.array(at, pa.int64()))
            words, n = (pa.array([x for c in counts for x in f(c)], kind) for f, kind in ((Counter.keys, pa.string()), (Counter.values, pa.int64())))
            yield pa.RecordBatch.from_arrays([ids, words, n], names=["id", "word", "_k"])


def mean_word_frequency(df: DataFrame, id_col: str, text: str, frequencies: DataFrame | None = None) -> DataFrame:
    """(id, mean_word_freq): the mean of a text's words in a table (word, zipf), 0 for a word that it lacks and for a text without words.

    Words are counted within each text as it is read, so nothing is shuffled for that and a common word meets the table once a
    text. Without a table, the texts' own :func:`word_frequencies` are taken, from the same stored counts. Ids are unique.
    """
    kind = df.schema[id_col].dataType.simpleString()
    words = Scratch(df.sparkSession).keep(df.select(id_col, text).mapInArrow(_counted, f"id {kind}, word string, _k long"))
    if frequencies is None:
        n = words.groupBy("word").agg(F.sum("_k").alias("n"))
        frequencies = _zipf(n)
    met = words.join(frequencies, "word", "left").groupBy(F.col("id").alias(id_col))
    mean = met.agg((F.sum(F.col("_k") * F.coalesce("zipf", F.lit(0.0))) / F.sum("_k")).alias("mean_word_freq"))
    return df.select(id_col).join(mean, id_col, "left").select(id_col, F.coalesce("mean_word_freq", F.lit(0.0)).alias("mean_word_freq"))
