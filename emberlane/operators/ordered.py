"""Work that needs a total order, without a task that holds all rows: running aggregates by ranges, exact quantiles by refinement."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most; keys a range that bounds are picked from, about.
RANGE_ROWS, MOST_RANGES, KEYS = 500_000, 4096, 64
#: Values that a quantile's last step collects at most, and bits that each step before it settles.
FEW_VALUES, STEP_BITS = 10_000, 11
BUCKET = "_range"


def _key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order])


def _at_or_below(key: Column, bounds: list[Column]) -> Column:
    """How many of some ascending bounds don't exceed the key: a tree of comparisons down to short lists."""
    if len(bounds) <= 16:
        return F.size(F.filter(F.array(*bounds), lambda b: b <= key)) if bounds else F.lit(0)
    half = len(bounds) // 2
    return F.when(key < bounds[half], _at_or_below(key, bounds[:half])).otherwise(half + 1 + _at_or_below(key, bounds[half + 1 :]))


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: its place among ranges of the order, in which equal keys lie together.

    Bounds are picked among the keys that a hash selects, some :data:`KEYS` a range, so they are the same whenever the plan
    runs again. The number of ranges follows the number of rows; a small table is one range.
    """
    n = df.count()
    ranges = ranges or min(MOST_RANGES, n // RANGE_ROWS + 1)
    if ranges == 1:
        return df.withColumn(BUCKET, F.lit(0))
    some = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(max(1, n // (KEYS * ranges)))) == 0
    picked = df.select(*[F.col(f"`{c}`") for c in order]).where(some).distinct().orderBy(*order).collect()
    step = max(1, len(picked) // ranges)
    kinds = df.select(*order).schema
    literal = lambda v: F.struct(*map(literal, v)) if isinstance(v, tuple) else F.lit(v)
    bounds = [F.struct(*[literal(v).cast(f.dataType).alias(f.name) for f, v in zip(kinds, r, strict=True)]) for r in picked[step::step][:MOST_RANGES]]
    return df.withColumn(BUCKET, _at_or_below(_key(order), bounds))


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``min``, ``max`` of a column, or ``count`` of rows; ``before``: without the row itself."""

    kind: str
    column: str = ""
    before: bool = False

    def whole(self) -> Column:
        return F.count(F.lit(1)) if self.kind == "count" else getattr(F, self.kind)(self.column)

    def joined(self, earlier: Column, own: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.when(earlier.isNull(), own).when(own.isNull(), earlier).otherwise(earlier + own)
        return (F.least if self.kind == "min" else F.greatest)(earlier, own)


def running(rows: DataFrame, order: Sequence[str], wanted: dict[str, Running], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``rows`` of :func:`in_ranges` (by ``by`` and ``order``) with running aggregates in their order, or against it.

    Ranges are aggregated apart, their totals run over at most as many rows as there are ranges for each of the groups
    ``by``, and every range goes on from what lies before it. Rows with equal keys come in any order, so keys should be
    distinct wherever that matters; then no range is much larger than the others.
    """
    way = [F.desc(c) if descending else F.asc(c) for c in order]
    keys = [BUCKET, *by]
    totals = rows.groupBy(*keys).agg(*[w.whole().alias(f"_all_{k}") for k, w in wanted.items()])
    to_here = W.partitionBy(*by).orderBy(F.desc(BUCKET) if descending else F.asc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    add = {k: F.sum if w.kind in ("sum", "count") else getattr(F, w.kind) for k, w in wanted.items()}
    earlier = totals.select(*[F.col(c).alias(f"_own_{c}") for c in keys], *[add[k](f"_all_{k}").over(to_here).alias(f"_to_{k}") for k in wanted])
    earlier = earlier if by else F.broadcast(earlier)  # a row a range
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    met = rows.join(earlier, same).drop(*[f"_own_{c}" for c in keys])
    inside = W.partitionBy(*keys).orderBy(*way)
    for k, w in wanted.items():
        frame = inside.rowsBetween(W.unboundedPreceding, -1 if w.before else 0)
        met = met.withColumn(k, w.joined(F.col(f"_to_{k}"), w.whole().over(frame)))
        if w.kind in ("sum", "count") and w.before:
            met = met.withColumn(k, F.coalesce(k, F.lit(0)))
    return met.drop(*[f"_to_{k}" for k in wanted])


def scan(df: DataFrame, order: Sequence[str], wanted: dict[str, Running], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with running aggregates (:class:`Running`) in an order, within the groups ``by``: :func:`in_ranges`, then :func:`running`."""
    return running(in_ranges(df, [*by, *order], ranges), order, wanted, by).drop(BUCKET)


def _ordinal(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; zeros are one, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view("<u8")
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(k: int) -> float:
    bits = k & ((1 << 63) - 1) if k >> 63 else ~k & ((1 << 64) - 1)
    return float(np.array([bits], dtype="<u8").view("<f8")[0])


def _counted(slices: list[tuple[int, int]]):
    """Values of a task in each of the equal parts of slices (first, width as a power of two): (slice, part, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [min(STEP_BITS, bits) for _, bits in slices]
        total = [np.zeros(1 << p, dtype=np.int64) for p in parts]
        for batch in batches:
            k = _ordinal(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            for s, (first, bits) in enumerate(slices):
                off = k - np.uint64(first)  # what lies below wraps around to beyond
                inside = off[(k >= np.uint64(first)) & ((off >> np.uint64(bits)) == 0)] if bits < 64 else k
                total[s] += np.bincount((inside >> np.uint64(bits - parts[s])).astype(np.int64), minlength=len(total[s]))
        for s, t in enumerate(total):
            some = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s)), pa.array(some), pa.array(t[some])], names=["slice", "part", "n"])

    return run


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, as ``percentile`` gives them; null values are left out, none gives None.

    A pass counts values in equal parts of the slices that hold the wanted ranks, on the integers of the same order as the
    doubles, so six passes settle any column; a slice with at most :data:`FEW_VALUES` values is collected sooner. A task
    sends at most ``2 ** STEP_BITS`` counts a slice, whatever the number of distinct values.
    """
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    n = x.count()
    if n == 0:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    found: dict[int, float] = {}
    open_ = {(0, 64): (0, n, {r for p in places for r in (math.floor(p), math.ceil(p))})}
    while open_:
        small = {s: v for s, v in open_.items() if v[1] <= FEW_VALUES or s[1] == 0}
        for (first, bits), (below, _, ranks) in small.items():
            lo, hi = _value(first), _value(first + (1 << bits) - 1)
            if bits == 0:
                found |= dict.fromkeys(ranks, lo)
                continue
            inside = x if bits == 64 else x.where((F.col("x") >= lo) & ((F.col("x") <= hi) if not math.isnan(hi) else F.lit(True)))
            got = np.sort(np.array([r[0] for r in inside.collect()]))
            found |= {r: float(got[r - below]) for r in ranks}
        large = [s for s in open_ if s not in small]
        if not large:
            break
        counts = x.mapInArrow(_counted(large), "slice long, part long, n long").groupBy("slice", "part").agg(F.sum("n").alias("n")).collect()
        inner: dict[tuple[int, int], tuple[int, int, set[int]]] = {}
        for s, (first, bits) in enumerate(large):
            below, _, ranks = open_[first, bits]
            left = bits - min(STEP_BITS, bits)
            for r in sorted((c for c in counts if c["slice"] == s), key=lambda c: c["part"]):
                mine = {k for k in ranks if below <= k < below + r["n"]}
                if mine:
                    inner[first + (r["part"] << left), left] = (below, r["n"], mine)
                below += r["n"]
        open_ = inner
    mixed = lambda p: (1 - (p - math.floor(p))) * found[math.floor(p)] + (p - math.floor(p)) * found[math.ceil(p)] if p % 1 else found[int(p)]
    return [mixed(p) for p in places]
