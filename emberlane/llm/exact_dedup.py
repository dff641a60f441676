"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""
from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import bit_flag, row_keys, spread_join, stored, without

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Code points of the normalised text that the second level hashes.
PREFIX = 256
#: Rows of a group from which on they are dealt to many tasks.
HOT = 2_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; a text of one byte per character takes the faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), digest: str | None = None) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, the ``carry`` columns.

    Texts are equal when identical after lower-casing A-Z; null counts as empty; of equal texts the largest id stays.
    Level 1 counts lengths; level 2 hashes the first :data:`PREFIX` characters where the length repeats; level 3 hashes
    whole texts (SHA-256) where length and prefix hash repeat. What repeats at a level reaches the next scan as bitmaps of
    bounded size, so no text is shuffled: only ids and hashes are, pre-aggregated, and rows of large groups are dealt to many
    tasks. A row listed more than once under one id is one document: each listing
    gets the same answer. A null id stays only if its group has no other id; an empty table gives an empty result. Where the
    caller already carries the SHA-256 of normalised texts, ``digest`` names that column and level 3 takes it from there.
    """
    return _groups(docs, id_col, text_col, carry, digest).select(id_col, "keep_id", "group_size", "kept", *carry)


def _groups(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str], digest: str | None = None) -> DataFrame:
    """:func:`exact_groups` and ``_full``, the hash that tells groups of several rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *carry, text.alias("_t"), F.octet_length(text).cast("long").alias("_len"))
    lengths = docs.select(F.octet_length(text).cast("long").alias("_len")).groupBy("_len").count().where("count > 1")
    rows = bit_flag(rows, F.col("_len"), lengths, "_len", "_same_len", bits=1 << 22)
    key = F.when(F.col("_same_len"), F.xxhash64("_len", ascii_lower(F.substring("_t", 1, PREFIX))))
    rows = rows.withColumn("_key", key)
    prefixes = rows.where("_same_len").groupBy("_key").count().where("count > 1")
    rows = bit_flag(rows, F.col("_key"), prefixes, "_key", "_same_prefix")
    full = F.col(digest) if digest else F.sha2(ascii_lower(F.col("_t")), 256)
    own = F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    rows = rows.select("_id", *carry, F.when(F.col("_same_len") & F.col("_same_prefix"), full).alias("_full"))
    groups = rows.where("_full is not null").groupBy("_full").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).where("_n > 1")
    # a text that met no other joins under a key of its own, so such rows spread evenly
    groups = groups.withColumnRenamed("_full", "_k")
    joined = spread_join(rows.withColumn("_k", F.coalesce("_full", own)), groups, "_k", groups.where(F.col("_n") > HOT).select("_k"), "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col), *carry, keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), "_full",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row of each group, all columns as they were; of rows under one id or none, one stays.

    No text is shuffled but those that a bit filter suspects.
    """
    keyed = docs.select(F.col(id_col), F.col(text_col), *row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    found = stored(_groups(keyed, id_col, text_col, ["k1", "k2"]).where("group_size > 1").select("k1", "k2", "kept", "_full"))
    first = found.where("kept").groupBy("_full").agg(F.min(F.struct("k1", "k2")).alias("w"), F.count(F.lit(1)).alias("c"))
    again = first.where("c > 1").select("_full", "w.*")
    ties = found.where("kept").join(again.select("_full"), "_full", "left_semi").select("k1", "k2").distinct()
    losers = found.where("not kept").select("k1", "k2").unionByName(ties.join(again, ["k1", "k2"], "left_anti"))
    return without(docs, losers, id_col, text_col, once=again.select("k1", "k2"))
