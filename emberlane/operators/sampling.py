"""Apportionment, stratified draws by stable hashes, sheets with keys, greedy matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlane.operators import ordered as od



def hash_order(seed: str, *parts: str) -> Column:
    """A shared deterministic order: SHA-256 of the seed and the parts, joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)


def hamilton(sizes: DataFrame, key: str, total: int, capacity: Column | None = None) -> DataFrame:
    """Largest-remainder shares of ``total`` by size: floors first, then the largest fractions, ties by key. One row per stratum."""
    cap = (capacity if capacity is not None else F.col("size")).cast("double")
    t = sizes.withColumn("_q", total * cap / F.sum(cap).over(W.partitionBy()))
    t = t.withColumn("_f", F.floor("_q").cast("long"))
    left = F.lit(total) - F.sum("_f").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.col("_q") - F.col("_f")), F.col(key)))
    return t.select(key, "size", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("alloc"))


def hamilton_with_floor(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """The same with at least one each: one is set aside per stratum, the rest goes by what is left of each."""
    n, room = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    if total < n or total > room:
        raise ValueError(f"{total} units can't give each of {n} strata one within {room}")
    extra = hamilton(sizes, key, total - n, F.col("size") - 1)
    return extra.withColumn("alloc", F.col("alloc") + 1)


def draw(df: DataFrame, strata: list[str], k: Column, seed: str, *ids: str) -> DataFrame:
    """The first k rows of each stratum in hash order; k may be a column."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(hash_order(seed, *ids), *ids))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def proportional_sample(df: DataFrame, stratum: str, n: int, seed: str, id_col: str) -> DataFrame:
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    return draw(df.join(hamilton(sizes, stratum, n).select(stratum, "alloc"), stratum), [stratum], F.col("alloc"), seed, id_col).drop("alloc")


def equal_quota_sample(df: DataFrame, stratum: str, n: int, seed: str, id_col: str) -> DataFrame:
    """max(1, n // strata) rows of each stratum, capped by its size."""
    quota = F.greatest(F.lit(1), F.expr(f"{n} div count(1)"))
    q = df.select(stratum).distinct().agg(quota.alias("_quota"))
    return draw(df.crossJoin(F.broadcast(q)), [stratum], F.col("_quota"), seed, id_col).drop("_quota")


def weighted_panel(df: DataFrame, strata: list[str], k: int, seed: str, *ids: str) -> DataFrame:
    """k rows per stratum with weight population / drawn."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("population"))
    drawn = draw(df, strata, F.lit(k), seed, *ids).join(sizes, strata)
    return drawn.withColumn("sampling_weight", F.col("population") / F.least(F.col("population"), F.lit(k)))


def length_terciles(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with length_bin: exact terciles of the character length, right-closed, repeated edges dropped."""
    n = F.length(text)
    cuts = od.quantiles(df, n, [0, 1 / 3, 2 / 3, 1])
    edges = sorted({c for c in cuts if c is not None})
    above = sum(((n > e).cast("int") for e in edges[1:-1]), F.lit(0))
    names = ("short",) if len(edges) <= 2 else ("short", "long") if len(edges) == 3 else ("short", "medium", "long")
    at = F.lit(names[0])
    for k, name in enumerate(names[1:], 1):
        at = F.when(above == k, name).otherwise(at)
    return df.withColumn("length_bin", at)


def numbered(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its place (from 1) in the order of some columns, by a scan over ranges; rows with equal keys in any order."""
    return od.scan(df, order, {name: od.Running("count")}, ranges=ranges)


def number_items(df: DataFrame, prefix: str, order: list[str], width: int = 4) -> DataFrame:
    """Ids R0001, R0002, ... in a canonical order; beyond ``width`` digits they grow."""
    digits = F.col("_place").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    return numbered(df, order, "_place").withColumn("item_id", F.concat(F.lit(prefix), padded)).drop("_place")


def shuffle_items(df: DataFrame, seed: str, id_col: str = "item_id") -> DataFrame:
    """``df`` with its place in the stable hash shuffle."""
    return numbered(df.withColumn("_hash", hash_order(seed, id_col)), ["_hash", id_col], "place").drop("_hash")


def blinded(df: DataFrame, texts: list[str]) -> DataFrame:
    """The rater's sheet: ids and texts, empty answer columns, no provenance."""
    return df.select("item_id", *texts, F.lit("").alias("rating"), F.lit("").alias("notes"))


def unblinding_key(df: DataFrame, provenance: list[str]) -> DataFrame:
    return df.select("item_id", *provenance)


def first_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """De-duplicate, keeping the first row in a stated order."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def union_with_provenance(stratified: DataFrame, critical: DataFrame, key: list[str]) -> DataFrame:
    """Two selections as one: each key once, tagged stratified, message_critical or both."""
    a, b = stratified.select(*key, F.lit(1).alias("s"), F.lit(0).alias("c")), critical.select(*key, F.lit(0).alias("s"), F.lit(1).alias("c"))
    t = a.unionByName(b).groupBy(*key).agg(F.max("s").alias("s"), F.max("c").alias("c"))
    return t.select(*key, F.when((F.col("s") == 1) & (F.col("c") == 1), "both").when(F.col("s") == 1, "stratified").otherwise("message_critical").alias("provenance"))


def two_stage_sample(df: DataFrame, category: str, text: str, n: int, seed: str, id_col: str) -> DataFrame:
    """``n`` rows, each text once: shared among categories by size, then among the length terciles of each, drawn in hash order.

    The first row of a repeated text (by id) stands for it. Terciles are those of the whole deduplicated corpus.
    """
    once = first_by_key(df, [text], [id_col])
    rows = length_terciles(once, F.col(text))
    sizes = rows.groupBy(category).agg(F.count(F.lit(1)).alias("size"))
    if n > sizes.agg(F.sum("size")).first()[0]:
        raise ValueError(f"{n} rows wanted, fewer texts are there")
    per_category = hamilton(sizes, category, n).select(category, F.col("alloc").alias("_n"))
    cells = rows.groupBy(category, "length_bin").agg(F.count(F.lit(1)).alias("size")).join(per_category, category)
    w = W.partitionBy(category)
    share = F.col("_n") * F.col("size") / F.sum("size").over(w)
    cells = cells.withColumn("_f", F.floor(share).cast("long")).withColumn("_rest", share - F.floor(share))
    place = F.row_number().over(w.orderBy(F.desc("_rest"), "length_bin"))
    alloc = F.col("_f") + F.when(place <= F.col("_n") - F.sum("_f").over(w), 1).otherwise(0)
    cells = cells.select(category, "length_bin", alloc.cast("long").alias("_alloc"))
    return draw(rows.join(cells, [category, "length_bin"]), [category, "length_bin"], F.col("_alloc"), seed, id_col).drop("_alloc")


def pair_items(pairs: DataFrame) -> DataFrame:
    """Drawn pairs as two items each: CRIT with the critical half's label, CTRL with the control half's."""
    role = F.explode(F.array(*[F.struct(F.lit(c).alias("corpus"), F.col(f"{c.lower()}_label").alias("automated_label")) for c in ("CRIT", "CTRL")]))
    return pairs.select("pair_id", "cer_target", role.alias("_r")).select("pair_id", "cer_target", "_r.*")


def substudy_rows(auth: DataFrame, probes: DataFrame, reserved: DataFrame, n: int, seed: str, stratum: str, max_replicate: int = 10) -> DataFrame:
    """Exposures of a substudy: ``n`` unreserved AUTH messages by stratum (one at least each) and all probe rows, early replicates only."""
    free = auth.join(reserved.select("message_id").distinct(), "message_id", "left_anti")
    messages = free.groupBy("message_id").agg(F.min(stratum).alias(stratum))
    sizes = messages.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    chosen = draw(messages.join(hamilton_with_floor(sizes, stratum, n).select(stratum, "alloc"), stratum), [stratum], F.col("alloc"), seed, "message_id").select("message_id")
    rows = free.join(chosen, "message_id", "left_semi").unionByName(probes, allowMissingColumns=True)
    return rows.where(F.col("replicate_idx") < max_replicate)
