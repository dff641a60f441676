"""Bootstrap of any metric of weighted sums: units are resampled n of n within ranges, draws in blocks, sums merged by cell.

A metric names a cell (such as a score) and terms; it gets, for every draw, the weighted sums of its terms in each cell. A
draw splits exactly: how many of the n picks fall into each range of units is multinomial, and so are the picks within a
range, each seeded by draw and range. So every task draws for its own units alone, results don't depend on partitions, and
nothing but intervals needs to reach the driver.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.operators import ordered as od
from emberlane.scratch import Scratch

#: Rows of a range of units, about; numbers (draws times cells times ranges) that a task merges, about; cells of a group at most.
RANGE_ROWS, MERGED, MOST_CELLS = 20_000, 4_000_000, 100_000


@dataclass(frozen=True)
class Metric:
    """``finish`` turns cells in ascending order and each term's sums (draws x cells) into one array of draws for each of ``values``."""

    values: tuple[str, ...]
    terms: dict[str, Column]
    finish: Callable[[np.ndarray, dict[str, np.ndarray]], Sequence[np.ndarray]]
    cell: Column | None = None


def of_sums(terms: dict[str, Column], statistic: Callable[[dict[str, np.ndarray]], np.ndarray], name: str = "value") -> Metric:
    """A metric of sums over all rows."""
    return Metric((name,), terms, lambda _, sums: (statistic({k: v.sum(1) for k, v in sums.items()}),))


def rate(hit: Column) -> Metric:
    return of_sums({"k": hit.cast("double"), "n": F.lit(1.0)}, lambda s: s["k"] / s["n"])


def auroc(score: Column, positive: Column) -> Metric:
    """Rank AUROC with ties at one half; NaN where a draw has one class."""

    def finish(_: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray]:
        pos, neg = sums["pos"], sums["neg"]
        u = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(1)
        return (u / (pos.sum(1) * neg.sum(1)),)

    p = positive.cast("double")
    return Metric(("auroc",), {"pos": p, "neg": 1 - p}, finish, score.cast("double"))


def calibration_error(score: Column, hit: Column, bins: int = 10) -> Metric:
    """Expected calibration error over equal bins, [lo, hi) with the last closed."""
    edges = np.arange(1, bins) / bins

    def finish(cells: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray]:
        at = np.searchsorted(edges, cells, side="right")
        n, k, s = (np.stack([v[:, at == b].sum(1) for b in range(bins)]) for v in (sums["n"], sums["k"], sums["n"] * cells))
        gap = np.where(n > 0, np.abs(k - s) / np.where(n > 0, n, 1), 0)
        return ((gap * n).sum(0) / n.sum(0),)

    return Metric(("ece",), {"n": F.lit(1.0), "k": hit.cast("double")}, finish, score.cast("double"))


def quantile(value: Column, share: float) -> Metric:
    """The smallest value that reaches a share of a draw's rows, or the mean of it and the next where the share is met exactly."""

    def finish(cells: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray]:
        run = np.cumsum(sums["n"], axis=1)
        goal = share * run[:, -1:]
        lo = np.minimum((run < goal - 1e-9).sum(1), len(cells) - 1)
        hi = np.minimum((run <= goal + 1e-9).sum(1), len(cells) - 1)
        return ((cells[lo] + cells[hi]) / 2,)

    return Metric(("quantile",), {"n": F.lit(1.0)}, finish, value.cast("double"))


def both(a: Metric, b: Metric) -> Metric:
    """Two metrics of the same cell from the same draws."""
    terms = {**{f"a_{k}": c for k, c in a.terms.items()}, **{f"b_{k}": c for k, c in b.terms.items()}}
    part = lambda sums, p: {k[2:]: v for k, v in sums.items() if k.startswith(p)}
    first, second = a.finish, b.finish
    return Metric((*a.values, *b.values), terms, lambda c, s: (*first(c, part(s, "a_")), *second(c, part(s, "b_"))), a.cell)


def _weights(seed: int, group: int, me: int, sizes: np.ndarray, units: np.ndarray, draws: range) -> np.ndarray:
    """How often each unit of range ``me`` is picked in each draw; draw 0 is the table itself."""
    out = np.empty((len(draws), len(units)))
    share, n = units / units.sum(), int(sizes.sum())
    for row, d in enumerate(draws):
        if d == 0:
            out[row] = units
            continue
        picks = np.random.default_rng([seed, group, d]).multinomial(n, sizes / n)[me] if len(sizes) > 1 else n
        out[row] = np.random.default_rng([seed, group, d, me]).multinomial(picks, share)
    return out


def _drawn(seed: int, draws: int, block: int, keys: int, terms: int, names: list[str]):
    """A range's sums by cell, for every block of draws as one array a term."""

    def run(rows: pa.Table, plan: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _types(keys, terms), strict=True)})
        rows = rows.sort_by([("unit", "ascending"), ("cell", "ascending")])
        labels = [rows.column(f"b{k}")[0].as_py() for k in range(keys)]
        unit = rows.column("unit").to_numpy()
        first = np.concatenate(([True], unit[1:] != unit[:-1]))
        size = rows.column("m").to_numpy()
        cell = rows.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
        values = [rows.column(f"t{k}").to_numpy()[order] for k in range(terms)]
        at = (np.cumsum(first) - 1)[order]
        sizes = np.array(plan.column("sizes")[0].as_py(), dtype=float)
        me = plan.column("ranges")[0].as_py().index(plan.column(od.BUCKET)[0].as_py())
        group = zlib.crc32(repr(labels).encode())
        out: list[list] = [[] for _ in names]
        for number, a in enumerate(range(0, draws + 1, block)):
            w = _weights(seed, group, me, sizes, size[first], range(a, min(draws + 1, a + block)))[:, at]
            sums = [np.add.reduceat(w * v, begin, axis=1) for v in values]
            for c, start in enumerate(begin):
                for col, v in zip(out, [*labels, float(cell[order[start]]), number, *[s[:, c].tolist() for s in sums]], strict=True):
                    col.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, _types(keys, terms), strict=True)], names=names)

    return run


def _types(keys: int, terms: int) -> list[pa.DataType]:
    return [*[pa.string()] * keys, pa.float64(), pa.int32(), *[pa.list_(pa.float64())] * terms]


def _stacked(table: pa.Table, terms: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cells in order and each term's sums (cells x draws) over all ranges."""
    cell = table.column("cell").to_numpy()
    cells, at = np.unique(cell, return_inverse=True)
    out = []
    for k in range(terms):
        col = table.column(f"t{k}").combine_chunks()
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1)
        total = np.zeros((len(cells), x.shape[1]))
        np.add.at(total, at, x)
        out.append(total)
    return cells, at, out


def bootstrap(df: DataFrame, metric: Metric, by: Sequence[str] = (), cluster: str | None = None, draws: int = 2000, seed: int = 0) -> DataFrame:
    """The metric's values in every draw, by ``by`` (as text): (by..., draw, values...); draw 0 is the table itself.

    Units are the clusters of a group, or its rows, of which equal ones are counted. A draw takes as many units as there are,
    with replacement. (group, range) tasks multiply their units' picks with the sums by cell; sums of several ranges are merged by
    cell and block of draws; a task finishes a block. Units are stored, so ``df`` is read once. A group of more than :data:`MOST_CELLS` cells raises: round its score.
    Rows with a null in a term, the cell or the cluster are left out.
    """
    names = list(metric.terms)
    keys = [f"b{k}" for k in range(len(by))]
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(k) for c, k in zip(by, keys, strict=True)]
    cell = metric.cell if metric.cell is not None else F.lit(0.0)
    rows = df.select(*labels, *([F.col(cluster).cast("string").alias("unit")] if cluster else []), cell.alias("cell"), *[c.cast("double").alias(f"t{k}") for k, c in enumerate(metric.terms.values())]).dropna()
    rows = rows.withColumn("cell", F.col("cell") + 0.0)
    ts = [f"t{k}" for k in range(len(names))]
    if cluster:
        units = rows.groupBy(*keys, "unit", "cell").agg(*[F.sum(t).alias(t) for t in ts]).withColumn("m", F.lit(1.0))
        order = [*keys, "unit"]
    else:
        units = rows.groupBy(*keys, "cell", *ts).agg(F.count(F.lit(1)).cast("double").alias("m"))
        units = units.withColumn("unit", F.concat_ws("|", F.col("cell").cast("string"), *[F.col(t).cast("string") for t in ts]))
        order = [*keys, "cell", *ts]
    units = Scratch(df.sparkSession).keep(units)
    n_units = units.count()
    most = units.select(*keys, "cell").distinct().groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    if most > MOST_CELLS:
        raise ValueError(f"{most} cells in a group, at most {MOST_CELLS}: round the score")
    ranges = min(od.MOST_RANGES, n_units // RANGE_ROWS + 1)
    units = od.in_ranges(units, order, ranges)
    block = int(max(1, min(draws + 1, MERGED // (most * min(ranges, 64)))))
    sizes = units.select(*keys, od.BUCKET, "unit", "m").distinct().groupBy(*keys, od.BUCKET).agg(F.sum("m").alias("size"))
    whole = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(od.BUCKET, "size"))).alias("s"))
    plan = whole.select(*keys, F.col(f"s.{od.BUCKET}").alias("ranges"), F.col("s.size").alias("sizes"), F.explode(f"s.{od.BUCKET}").alias(od.BUCKET))
    schema = ", ".join([*[f"{k} string" for k in keys], "cell double", "block int", *[f"{t} array<double>" for t in ts]])
    cols = [*keys, "cell", "block", *ts]
    at = [*keys, od.BUCKET]
    sums = units.groupBy(*at).cogroup(plan.groupBy(*at)).applyInArrow(_drawn(seed, draws, block, len(keys), len(ts), cols), schema)
    if ranges > 1:

        def merged(table: pa.Table) -> pa.Table:
            cells, _, total = _stacked(table, len(ts))
            own = [table.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(cells), int))) for k in (*keys, "block")]
            lists = [pa.array(t.tolist(), pa.list_(pa.float64())) for t in total]
            return pa.table([*own[:-1], pa.array(cells), own[-1], *lists], names=cols)

        part = F.pmod(F.xxhash64("cell"), F.lit(most // 500 + 1))
        sums = sums.withColumn("part", part).groupBy(*keys, "block", "part").applyInArrow(lambda t: merged(t.drop_columns(["part"])), schema)
    out_names, finish = [*keys, "draw", *metric.values], metric.finish

    def finished(table: pa.Table) -> pa.Table:
        cells, _, total = _stacked(table, len(ts))
        with np.errstate(divide="ignore", invalid="ignore"):
            values = finish(cells, {n: t.T for n, t in zip(names, total, strict=True)})
        n = total[0].shape[1]
        own = [pa.array([table.column(k)[0].as_py()] * n, pa.string()) for k in keys]
        draw = table.column("block")[0].as_py() * block + np.arange(n)
        return pa.table([*own, pa.array(draw), *[pa.array(np.asarray(v, dtype=float)) for v in values]], names=out_names)

    out = ", ".join([*[f"{k} string" for k in keys], "draw long", *[f"{v} double" for v in metric.values]])
    done = sums.groupBy(*keys, "block").applyInArrow(finished, out)
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "draw", *metric.values)


def interval(value: str, prefix: str = "", level: float = 0.95) -> list[Column]:
    """Aggregates of drawn values: point, lo, hi, se and the number of finite draws."""
    v = F.col(value)
    drawn = F.when((F.col("draw") > 0) & v.isNotNull() & ~F.isnan(v), v)
    edges = F.percentile(drawn, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    point = F.max(F.when((F.col("draw") == 0) & ~F.isnan(v), v))
    return [point.alias(f"{prefix}point"), edges[0].alias(f"{prefix}lo"), edges[1].alias(f"{prefix}hi"), F.stddev_samp(drawn).alias(f"{prefix}se"), F.count(drawn).alias(f"{prefix}n_draws")]


def difference(df: DataFrame, metric: Metric, arm: str, a: str, b: str, cluster: str | None = None, draws: int = 2000, seed: int = 0) -> DataFrame:
    """The metric's first value in arm ``a`` less that in ``b``, arms resampled apart: point, interval and two-sided p."""
    t = bootstrap(df.where(F.col(arm).isin(a, b)), metric, [arm], cluster, draws, seed)
    value = metric.values[0]
    side = lambda x: F.max(F.when(F.col(arm) == x, F.col(value)))
    gaps = t.groupBy("draw").agg((side(a) - side(b)).alias("gap"))
    drawn = F.when((F.col("draw") > 0) & F.col("gap").isNotNull() & ~F.isnan("gap"), F.col("gap"))
    share = lambda c: F.count_if(c) / F.count(drawn)
    p = F.least(F.lit(1.0), 2 * F.least(share(drawn <= 0), share(drawn >= 0)))
    return gaps.agg(*interval("gap"), p.alias("p"))
