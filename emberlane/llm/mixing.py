"""Mixing sources to target weights by entropy balancing. DataFrame functions only; the driver holds one dual per source."""
from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlane.llm.common import stored, unwrapped, wrapped

_WS = r"[\x20\x09-\x0D]"
#: Steps of the two threshold tables: the last choice falls on a slice of 2 / BINS^2 of the unit interval.
BINS = 4096
#: Newton steps before the dual counts as unsolved; sources at most (the driver holds a few numbers of each).
MAX_STEPS, MAX_SOURCES = 200, 5_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    edge = lambda c: F.when(c.rlike(_WS), 1).otherwise(0)
    inner = F.size(F.split(t, _WS + "+", -1)) - edge(F.substring(t, 1, 1)) - edge(F.substring(t, -1, 1))
    return F.when(t == "", 0).otherwise(inner).cast("long")


def share_targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split ``share`` of all sizes by weight; none gets over ``cap`` times its size, the excess goes to the others by weight."""
    sizes, weights = [Fraction(s) for s in sizes], [Fraction(w) for w in weights]
    share, cap = Fraction(str(share)), Fraction(str(cap))
    target, left, budget = [Fraction(0)] * len(sizes), set(range(len(sizes))), min(share, cap) * sum(sizes)
    while left:
        total = sum(weights[i] for i in left)
        over = {i for i in left if budget * weights[i] > cap * sizes[i] * total}
        for i in over or left:
            target[i] = cap * sizes[i] if over else budget * weights[i] / total
        if not over:
            break
        budget -= sum(target[i] for i in over)
        left -= over
    return [float(t) for t in target]


def _table(spark: SparkSession, rows: list[dict], kinds: dict[str, str]) -> DataFrame:
    """A few literal rows, one per source."""
    one = lambda r: F.struct(*[F.lit(r[k]).cast(t).alias(k) for k, t in kinds.items()])
    return spark.range(1).select(F.inline(F.array(*map(one, rows))))


def _rate(x: Column, dual: Column, cap: float) -> Column:
    """Exponential tilt of one copy per document, held at the cap; a null dual stands for the cap itself."""
    return F.when(dual.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(dual * x, F.lit(60.0)))))


def _solve(cells: DataFrame, sources: list[dict], cap: float) -> None:
    """Newton steps on the convex dual of every source at once, one aggregation each; a bracket guards the steps.

    Sums are taken as decimals, so they don't depend on the order of the rows and reruns agree to the last bit.
    """
    spark = cells.sparkSession
    for s in sources:
        s |= {"dual": 0.0, "lo": -math.inf, "hi": math.inf, "open": 0 < s["target"] < cap * s["size"]}
        if s["target"] >= cap * s["size"]:
            s["dual"] = None
        elif s["target"] <= 0:
            s["dual"] = -1e6
    for _ in range(MAX_STEPS):
        todo = [s for s in sources if s["open"]]
        if not todo:
            return
        state = _table(spark, todo, {"k": "int", "dual": "double", "mean": "double"})
        x, dec = F.col("size") / F.col("mean"), lambda c: F.sum(c.cast("decimal(38,12)"))
        r = _rate(x, F.col("dual"), cap)
        sums = (
            cells.join(F.broadcast(state), "k")
            .select("k", (F.col("n") * F.col("size") * r).alias("f"), F.when(r < cap, F.col("n") * F.col("size") * x * r).otherwise(0.0).alias("g"))
            .groupBy("k").agg(dec(F.col("f")).alias("f"), dec(F.col("g")).alias("g")).collect()
        )
        for row in sums:
            s = next(s for s in todo if s["k"] == row["k"])
            gap, slope = float(row["f"]) - s["target"], float(row["g"])
            if abs(gap) <= 1e-9 * max(1.0, s["target"]):
                s["open"] = False
                continue
            s["hi" if gap > 0 else "lo"] = s["dual"]
            step = s["dual"] - gap / slope if slope > 0 else math.nan
            if not s["lo"] < step < s["hi"]:
                if math.isinf(s["lo"]) or math.isinf(s["hi"]):
                    step = s["dual"] + math.copysign(max(1.0, 2 * abs(s["dual"])), -gap)
                else:
                    step = (s["lo"] + s["hi"]) / 2
            if step == s["dual"] or (s["hi"] - s["lo"]) <= 1e-13 * max(1.0, abs(step)):
                s["open"] = False
            s["dual"] = step
    if any(s["open"] for s in sources):
        raise RuntimeError(f"the dual of {sum(s['open'] for s in sources)} sources did not settle in {MAX_STEPS} steps")


class Mix:
    """Targets, duals and rounding thresholds of all sources, found once; :meth:`on` applies them to any rows of the same ids."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: int, seed: int) -> None:
        self.spark, self.id, self.text, self.source, self.cap, self.seed = docs.sparkSession, id_col, text_col, source_col, cap, seed
        sized = stored(docs.select(F.col(id_col), F.col(source_col).cast("string").alias(source_col), word_count(F.col(text_col)).alias("size")))
        self.sized = sized
        stats = sized.groupBy(source_col).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(stats) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        stats.sort(key=lambda r: (r[0] is None, r[0] or ""))
        goal = share_targets([r["size"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], share, cap)
        self.sources = [
            {"k": i, "source": r[0], "size": r["size"], "mean": max(r["size"] / r["n"], 1e-9), "target": t, "limit": 0}
            for i, (r, t) in enumerate(zip(stats, goal, strict=True))
        ]
        if self.sources:
            numbers = F.broadcast(_table(self.spark, self.sources, {"k": "int", "source": "string"}).withColumnRenamed("source", "_s"))
            cells = sized.join(numbers, F.col(source_col).eqNullSafe(F.col("_s"))).groupBy("k", "size").agg(F.count(F.lit(1)).alias("n"))
            _solve(stored(cells), self.sources, float(cap))
            self._thresholds()

    def _rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a size) with rate, base copies, and the slot of [0, 1) in which the hash of the id lies from the fraction."""
        kinds = {"k": "int", "source": "string", "dual": "double", "mean": "double", "target": "double", "size": "long", "limit": "long"}
        each = _table(self.spark, self.sources, kinds).withColumnsRenamed({"source": "_s", "size": "source_size", "limit": "_limit", "mean": "_mean", "dual": "_dual", "k": "_k"})
        rated = rows.join(F.broadcast(each), F.col(self.source).eqNullSafe(F.col("_s"))).withColumn("rate", _rate(F.col("size") / F.col("_mean"), F.col("_dual"), float(self.cap)))
        u = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), self.id), 11) / F.lit(float(1 << 53))
        rated = rated.withColumn("_base", F.floor("rate").cast("int"))
        v = (u - (F.col("rate") - F.col("_base")) + 1) / 2
        rated = rated.withColumn("_slot", F.least(F.floor(v * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long"))
        return rated.withColumn("_free", (F.col("_base") < self.cap) & (F.col("size") > 0))

    def _thresholds(self) -> None:
        """A document takes one more copy below its source's limit; the limit that brings the source next to its target.

        Two tables of :data:`BINS` slices per source are summed up in order; the driver gets one row per source of each.
        """
        rated = self._rated(self.sized).withColumn("bin", F.expr(f"_slot div {BINS}"))
        extra = F.sum(F.when(F.col("_free"), F.col("size")).otherwise(0))
        up = W.partitionBy("_k").orderBy("bin")
        coarse = rated.groupBy("_k", "bin").agg(extra.alias("w"), F.sum(F.col("_base") * F.col("size")).alias("b"), F.first("target").alias("goal"))
        coarse = coarse.withColumn("left", F.col("goal") - F.sum("b").over(W.partitionBy("_k"))).withColumn("below", F.sum("w").over(up) - F.col("w"))
        over = F.when(F.col("below") + F.col("w") > F.col("left"), F.struct("bin", "below"))
        found = coarse.groupBy("_k").agg(F.first("left").alias("left"), F.sum("w").alias("all"), F.min(over).alias("m")).collect()
        marks = [{"m": r["_k"], "at": r["m"]["bin"], "need": r["left"] - r["m"]["below"]} for r in found if r["m"] is not None]
        limits = {s["k"]: BINS * BINS for s in self.sources}
        if marks:
            each = _table(self.spark, marks, {"m": "int", "at": "long", "need": "double"})
            inner = rated.where("_free").join(F.broadcast(each), F.expr("m = _k and at = bin")).groupBy("_k", "at", "need", "_slot").agg(F.sum("size").alias("w"))
            before = F.sum("w").over(W.partitionBy("_k").orderBy("_slot")) - F.col("w")
            take = (F.col("need") > before) & (F.col("w") - (F.col("need") - before) <= F.col("need") - before)  # the nearer side
            steps = inner.withColumn("take", take).withColumn("past", F.min(F.when(~F.col("take"), F.col("_slot"))).over(W.partitionBy("_k")))
            last = F.max(F.when(F.col("past").isNull() | (F.col("_slot") < F.col("past")), F.col("_slot") + 1))
            limits |= {m["m"]: m["at"] * BINS for m in marks}
            limits |= {r["_k"]: r["last"] for r in steps.groupBy("_k").agg(last.alias("last")).collect() if r["last"] is not None}
        for s in self.sources:
            s["limit"] = limits[s["k"]]

    def on(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a size) with source_size, target, rate, copies and taken."""
        if not self.sources:
            return rows.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("source_size", "long"), ("target", "double"), ("rate", "double"), ("copies", "int"), ("taken", "long"))])
        copies = F.col("_base") + F.when(F.col("_free") & (F.col("_slot") < F.col("_limit")), 1).otherwise(0)
        rated = self._rated(rows).withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        return rated.select(*[F.col(f"`{c}`") for c in rows.columns], "source_size", "target", "rate", "copies", "taken")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17,
) -> DataFrame:
    """One row per document: ``id_col``, size, source_size, target, taken, source, rate, copies.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words; targets stop at
    ``cap`` times their source's size. Rates minimise the relative entropy to one copy of each document under each
    source's word target and the cap: ``min(cap, exp(dual * size / mean size))``. Copies round the rates by a hash of the
    id; per source one threshold, found in two tables of :data:`BINS` slices, brings the words taken next to the target
    (within the size of the documents in one slice). The driver gets one row per source and step; sources are a configured
    list, more than :data:`MAX_SOURCES` raise a ValueError. Everything else stays distributed; only (source, size) counts
    and slice tables are aggregated. A dual that doesn't settle raises a RuntimeError.

    Null or empty texts have size 0 and take 0; null ids are rounded by one hash, so are rows that repeat an id; extra
    columns have no effect; an empty table gives an empty result.
    """
    plan = Mix(docs, id_col, text_col, source_col, weights, share, cap, seed)
    return plan.on(plan.sized).select(id_col, "size", "source_size", "target", "taken", source_col, "rate", "copies")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17,
) -> DataFrame:
    """The documents as often as :func:`mix` takes them, all columns as they were; no text is shuffled."""
    plan = Mix(docs, id_col, text_col, source_col, weights, share, cap, seed)
    rows = wrapped(docs, **{id_col: F.col(id_col), source_col: F.col(source_col).cast("string"), "size": word_count(F.col(text_col))})
    taken = plan.on(rows).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies")))
    return unwrapped(taken, docs)
