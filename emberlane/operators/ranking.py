"""Adjusted p-values, pickers and ordered categories."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlane.operators import ordered as od


def benjamini_hochberg(df: DataFrame, p: str, order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with q: the smallest p * m / rank at or above each p, at most 1, for a family of any size (two scans by ranges)."""
    rows = od.in_ranges(df, [p, order], ranges)
    m = df.count()
    ranked = od.running(rows, [p, order], {"_rank": od.Running("count")}).withColumn("_step", F.col(p) * m / F.col("_rank"))
    least = od.running(ranked, ["_rank"], {"_least": od.Running("min", "_step")}, descending=True)
    return least.withColumn("q", F.least(F.lit(1.0), "_least")).drop("_rank", "_step", "_least", od.BUCKET)


def nearest_to_level(df: DataFrame, levels: tuple[float, ...], value: str, key: str) -> DataFrame:
    """For each level the row whose value lies nearest, ties by key."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x,) for x in levels], "level double")
    t = df.crossJoin(F.broadcast(grid)).groupBy("level").agg(F.min(F.struct(F.abs(F.col(value) - F.col("level")).alias("gap"), F.col(key).alias("key"))).alias("b"))
    return t.select("level", F.col("b.key").alias(key), F.col("b.gap").alias("gap"))


def span_extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """k rows that span a column: smallest, largest, second smallest, ... in turn. Only k rows from each end are sorted; keys are unique."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    ends = []
    for order, first in (((F.asc(value), F.asc(key)), -1), ((F.desc(value), F.desc(key)), 0)):
        end = df.orderBy(*order).limit(k)
        ends.append(end.select(row, F.col(key).alias("key"), (2 * F.row_number().over(W.orderBy(*order)) + first).alias("turn")))
    once = ends[0].unionByName(ends[1]).groupBy("key").agg(F.min("turn").alias("turn"), F.min_by("row", "turn").alias("row"))
    return once.select("row.*", F.col("turn").cast("long").alias("turn")).orderBy("turn").limit(k)


def clean_example(text: str, lo: int = 10, hi: int = 80):  # noqa: ANN201
    """Fit to be shown: bounded length, no code fence, no ellipsis."""
    t = F.col(text)
    return F.length(t).between(lo, hi) & ~t.contains("```") & ~t.contains("...") & ~t.contains("…")


def first_per_spec(df: DataFrame, specs: list[dict], order: list[str]) -> DataFrame:
    """One row per spec (label, corpus, level), the first in order whose message no earlier spec used."""
    spark, used, rows = df.sparkSession, [], []
    for i, spec in enumerate(specs):
        t = df.where(~F.col("message_id").isin(*used)) if used else df
        for c, v in spec.items():
            t = t.where(F.col(c) == v)
        got = t.orderBy(*order).limit(1).collect()
        if got:
            used.append(got[0]["message_id"])
            rows.append((i, got[0]["message_id"]))
    return spark.createDataFrame(rows, "spec long, message_id string")


def validated_examples(agreed: DataFrame, text: str, rate: str, per_class: int, levels: tuple[float, ...], span: tuple[str, ...] = ("drift",), classes: tuple[str, ...] = ("faithful", "degraded", "drift")) -> DataFrame:
    """``per_class`` clean agreed examples of each class, or a ValueError: nearest to a level each, or the extremes of the rate for ``span`` classes.

    Ties go to the smallest item. One pass ranks all candidates; only the few chosen reach the driver.
    """
    rows = agreed.where(clean_example(text))
    nearest = lambda level: F.row_number().over(W.partitionBy("label").orderBy(F.abs(F.col(rate) - level), "item_id"))
    low, high = (F.row_number().over(W.partitionBy("label").orderBy(o, "item_id")) for o in (F.col(rate), F.desc(rate)))
    marks = {f"_n{i}": nearest(v) for i, v in enumerate(levels)} | {"_lo": low, "_hi": high}
    ranked = rows.withColumns(marks)
    top = ranked.where(" or ".join(f"{m} <= {2 * per_class}" for m in marks)).select("item_id", "label", F.col(rate).alias("rate"), *marks).collect()
    out = []
    for c in classes:
        mine, used = [r for r in top if r["label"] == c], []
        order = ["_lo", "_hi"] * per_class if c in span else [f"_n{i}" for i in range(len(levels))]
        for mark in order[:per_class]:
            left = [r for r in sorted(mine, key=lambda r: r[mark]) if r["item_id"] not in used]
            used += [left[0]["item_id"]] if left else []
        if len(used) < per_class:
            raise ValueError(f"{len(used)} clean agreed examples of {c}, {per_class} wanted")
        out += [(c, k, i) for k, i in enumerate(used)]
    return agreed.sparkSession.createDataFrame(out, "label string, place long, item_id string")
