"""Greedy nearest-neighbour matching without replacement, spread over tasks: each row of an order takes its nearest free control.

What rows take in turn is also what they end with if all propose at once: a control keeps the earliest row that proposes to
it, and rows that are turned down propose to their next nearest. No row ever needs a control that it has been turned down
by, because whoever holds it comes earlier. So rounds of proposals give the sequential result, whatever their order.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlane.operators import ordered as od
from emberlane.operators.sampling import hash_order
from emberlane.scratch import Scratch

#: Rows that propose together and settle their own conflicts; controls of a range; candidates beyond those a point needs.
BLOCK, RANGE, SPARE = 4096, 200_000, 16
#: Digits at which squared distances are compared, so that the order of a sum doesn't decide ties.
DIGITS = 9
_POINT = "point long, need long, first long, z array<double>"
_FOUND = "point long, control long, tie string, d double, holder long"


def _lists(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _routed(meta: list[tuple[int, float, float]], width: int, far: bool):
    """Points with the ranges of the first feature to search: the nearest one, or all others within reach."""
    number, lo, hi = (np.array(c) for c in zip(*meta, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _lists(batch.column("z"), width)[:, 0]
            gap = np.maximum(0, np.maximum(lo - z[:, None], z[:, None] - hi))
            own = gap.argmin(1)
            if far:
                reach = batch.column("reach").to_numpy(zero_copy_only=False)
                wanted = np.round(gap**2, DIGITS) <= reach[:, None]
                wanted[np.arange(len(z)), own] = False
                row, at = np.nonzero(wanted)
            else:
                row, at = np.arange(len(z)), own
            if len(row):
                cols = [batch.column(c).take(pa.array(row)) for c in ("point", "need", "first", "z")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(number[at].astype(np.int32))], names=["point", "need", "first", "z", od.BUCKET])

    return run


def _searched(width: int):
    """A range's controls for each of its points: the nearest that may be free for the point's first row, as many as it needs."""

    def run(points: pa.Table, pool: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if points.num_rows and pool.num_rows:
            pool = pool.take(pc.sort_indices(pool.column("tie")))  # once, so that a stable order of distances settles ties
            z, x = _lists(points.column("z"), width), _lists(pool.column("z"), width)
            holder = pool.column("holder").to_numpy()
            need, first, point = (points.column(c).to_numpy() for c in ("need", "first", "point"))
            for r in range(len(z)):
                free = np.flatnonzero(holder > first[r])
                d = np.round(((x[free] - z[r]) ** 2).sum(1), DIGITS)
                k = min(int(need[r]), len(free))
                if k == 0:
                    continue
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                near = near[np.argsort(d[near], kind="stable")][:k]
                at = pa.array(free[near])
                out.append(pa.table([pa.array(np.full(k, point[r])), pool.column("control").take(at), pool.column("tie").take(at), pa.array(d[near]), pool.column("holder").take(at)], names=_names(_FOUND)))
        return pa.concat_tables(out) if out else _nothing(_FOUND)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _nothing(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (c.split() for c in schema.split(", "))})


def _proposed(rows: pa.Table, found: pa.Table, spare: int) -> pa.Table:
    """A block's rows in order: each proposes to the nearest control that no earlier row of the block wants or anyone earlier holds.

    A row whose candidates are all taken waits for the next round.
    """
    order = np.lexsort((found.column("tie").to_numpy(), found.column("d").to_numpy(), found.column("point").to_numpy())) if found.num_rows else np.zeros(0, int)
    point, control, holder = (found.column(c).to_numpy()[order] for c in ("point", "control", "holder"))
    begin = dict(zip(*np.unique(point, return_index=True), strict=True))
    found_n = dict(zip(*np.unique(point, return_counts=True), strict=True))
    needs = dict(zip(*np.unique(rows.column("point").to_numpy(), return_counts=True), strict=True))
    at = {p: int(b) for p, b in begin.items()}
    wanted: set[int] = set()
    out = []
    ranks, points = rows.column("rank").to_numpy(), rows.column("point").to_numpy()
    for i in np.argsort(ranks, kind="stable"):
        p, r = points[i], ranks[i]
        k, end = at.get(p, 0), int(begin.get(p, 0)) + min(int(found_n.get(p, 0)), int(needs[p]) + spare)
        while k < end and (control[k] in wanted or holder[k] <= r):  # later rows of the point come no nearer either
            k += 1
        at[p] = k
        if k < end:
            wanted.add(control[k])
            out.append((control[k], r))
    c, r = zip(*out, strict=True) if out else ((), ())
    return pa.table({"control": pa.array(c, pa.int64()), "rank": pa.array(r, pa.int64())})


def greedy_controls(critical: DataFrame, pool: DataFrame, features: Sequence[str], seed: int | str, order: Sequence[str], id_col: str = "message_id") -> DataFrame:
    """The nearest unused control for each critical row, taken in ``order``: ids, both sides' features, match_distance.

    Distances are Euclidean on z-scores over both sides (a constant feature counts for nothing), squared and compared at
    :data:`DIGITS` digits; ties go by the SHA-256 of seed and control id. Both sides may be of any size: controls lie in ranges of
    the first feature, a point searches its own range and then those that its farthest candidate so far can reach; critical
    rows propose in blocks of neighbours. Rows at one point share a search in all their blocks. Fewer controls than critical rows raise, as do null features. Ids are unique on each side.
    """
    spark = critical.sparkSession
    width, cols = len(features), [F.col(f"`{f}`").cast("double") for f in features]
    sides = [t.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(keys)], F.array(*cols).alias("v")) for t, keys in ((critical, order), (pool, ()))]
    whole = sides[0].select("v").unionByName(sides[1].select("v"))
    stats = whole.agg(*[f(F.col("v")[k]) for k in range(width) for f in (F.avg, F.stddev_pop)], F.max(F.exists("v", lambda x: x.isNull()).cast("int"))).first()
    n, m = sides[0].count(), sides[1].count()
    if m < n:
        raise ValueError(f"{m} candidates for {n} critical rows")
    if stats[-1]:
        raise ValueError("features of matched rows have nulls")
    scaled = F.array(*[(F.col("v")[k] - F.lit(stats[2 * k] or 0.0)) / F.lit(stats[2 * k + 1] or 1.0) for k in range(width)])
    scratch = Scratch(spark)
    rows = scratch.keep(od.scan(sides[0], [*[f"o{k}" for k in range(len(order))], "id"], {"rank": od.Running("count")}).select("rank", "id", "v", scaled.alias("z")))
    tied = sides[1].select("id", "v", scaled.alias("z"), hash_order(str(seed), "id").alias("tie"))
    tied = tied.withColumns({f"z{k}": F.col("z")[k] for k in range(width)})
    ranged = od.in_ranges(tied, [*[f"z{k}" for k in range(width)], "tie"], m // RANGE + 1)
    controls = scratch.keep(ranged.select("id", "v", "z", "tie", od.BUCKET, F.monotonically_increasing_id().alias("control")))
    meta = [tuple(r) for r in controls.groupBy(od.BUCKET).agg(F.min(F.col("z")[0]), F.max(F.col("z")[0])).collect()]
    holders = spark.createDataFrame([], "control long, rank long")
    waiting = rows.select("rank", "z")
    while (left := waiting.count()) > 0:
        holders, waiting = _round(scratch, rows, waiting, left, controls, holders, meta, width)
    got = rows.join(holders, "rank").join(controls.select("control", F.col("id").alias("_id"), F.col("v").alias("_v"), F.col("z").alias("_z")), "control")
    gap = F.sqrt(F.round(F.aggregate(F.zip_with("z", "_z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), DIGITS))
    own = [F.col("v")[k].alias(f"crit_{f}") for k, f in enumerate(features)]
    theirs = [F.col("_v")[k].alias(f) for k, f in enumerate(features)]
    return got.select(F.col("id").alias(f"crit_{id_col}"), *own, F.col("_id").alias(id_col), *theirs, gap.alias("match_distance"))


def _round(scratch: Scratch, rows: DataFrame, waiting: DataFrame, left: int, controls: DataFrame, holders: DataFrame, meta: list, width: int) -> tuple[DataFrame, DataFrame]:
    """One round of proposals: who holds what after it, and who is still, or again, without a control.

    A point's candidates are numbered once. A block of its rows starts after as many of them as the point has rows in earlier
    blocks: each of those candidates is taken by an earlier row, or was passed by one since someone earlier still has it.
    """
    keys = [f"z{k}" for k in range(width)]
    spread = waiting.withColumns({k: F.col("z")[i] for i, k in enumerate(keys)})
    blocks = scratch.keep(od.in_ranges(spread, [*keys, "rank"], left // BLOCK + 1).select("rank", "z", F.col(od.BUCKET).alias("block")))
    parts = blocks.groupBy("block", "z").agg(F.count(F.lit(1)).alias("need"), F.min("rank").alias("first"))
    of_point = W.partitionBy("z")
    before = F.coalesce(F.sum("need").over(of_point.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.keep(parts.select("z", "block", "need", F.min("first").over(of_point).alias("first"), before.alias("skip")))
    whole = parts.groupBy("z").agg((F.sum("need") + SPARE).alias("need"), F.min("first").alias("first"))
    points = scratch.keep(whole.select(F.monotonically_increasing_id().alias("point"), "need", "first", "z"))
    held = controls.join(holders, "control", "left").select("control", "z", "tie", od.BUCKET, F.coalesce("rank", F.lit(1 << 62)).alias("holder"))
    search = lambda some: some.groupBy(od.BUCKET).cogroup(held.groupBy(od.BUCKET)).applyInArrow(_searched(width), _FOUND)
    found = scratch.keep(search(points.mapInArrow(_routed(meta, width, far=False), f"{_POINT}, {od.BUCKET} int")))
    if len(meta) > 1:
        reach = found.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"))
        wide = points.join(reach, "point", "left").withColumn("reach", F.when(F.col("n") >= F.col("need"), F.col("far")).otherwise(float("inf")))
        found = found.unionByName(search(wide.mapInArrow(_routed(meta, width, far=True), f"{_POINT}, {od.BUCKET} int")))
    # of what several ranges found for a point only as many count as each of them searched for: beyond them a nearer one may lack
    found = found.withColumn("place", F.row_number().over(W.partitionBy("point").orderBy("d", "tie")))
    shares = parts.join(points.select("z", "point"), "z").select("point", "block", "need", "skip")
    theirs = (F.col("place") > F.col("skip")) & (F.col("place") <= F.col("skip") + F.col("need") + SPARE)
    found = scratch.keep(shares.join(found, "point").where(theirs).select("point", "block", "control", "tie", "d", "holder"))
    placed = blocks.join(points.select("z", "point"), "z").select("block", "rank", "point")
    spare = SPARE
    propose = lambda some, near: _proposed(some, near, spare)
    proposals = placed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(propose, "control long, rank long")
    after = scratch.keep(holders.unionByName(proposals).groupBy("control").agg(F.min("rank").alias("rank")))
    return after, rows.select("rank", "z").join(after.select("rank"), "rank", "left_anti")
