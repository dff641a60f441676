"""Running aggregates and exact quantiles against plain Python, with ranges forced and with ties, nulls and odd values."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import calibration as cal
from emberlane.operators import ordered as od
from emberlane.operators import ranking as rk
from emberlane.operators import sampling as sm


def rows_of(seed, n=4000):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None, "c"]), rng.choice([None, 0.5, rng.random()]), rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, x double, v long").repartition(7)


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_scan_against_plain_running_sums(spark, ranges):
    rows = rows_of(1)
    wanted = {"n": od.Running("count"), "s": od.Running("sum", "v"), "b": od.Running("sum", "v", before=True), "lo": od.Running("min", "v"), "hi": od.Running("max", "v", before=True)}
    out = {r["id"]: r for r in od.scan(frame(spark, rows), ["x", "id"], wanted, ["g"], ranges).collect()}
    assert len(out) == len(rows)
    for g in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        for k, r in enumerate(mine):
            to_here, before = [q[3] for q in mine[: k + 1] if q[3] is not None], [q[3] for q in mine[:k] if q[3] is not None]
            got = out[r[0]]
            assert (got["n"], got["b"], got["lo"], got["hi"]) == (k + 1, sum(before), min(to_here, default=None), max(before, default=None))
            assert got["s"] == (sum(to_here) if to_here else None)


def test_ranges_are_even_and_keep_equal_keys_together(spark):
    df = spark.range(50_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"))
    sizes = {r[0]: r[1] for r in od.in_ranges(df, ["x", "id"], 40).groupBy(od.BUCKET).count().collect()}
    assert len(sizes) > 30 and max(sizes.values()) < 4 * 50_000 / 40
    together = od.in_ranges(df, ["x"], 40).where("x = 7").select(od.BUCKET).distinct().count()
    assert together == 1


@pytest.mark.parametrize("ranges", [1, 30])
def test_adjusted_p_values_by_ranges(spark, ranges):
    rng = np.random.default_rng(4)
    p = [float(v) for v in rng.random(700) ** 3] + [0.5] * 50
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "k long, p double").repartition(6)
    got = {r["k"]: r["q"] for r in rk.benjamini_hochberg(df, "p", "k", ranges).collect()}
    order = sorted(range(len(p)), key=lambda i: (p[i], i))
    least = 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        assert got[order[rank - 1]] == pytest.approx(least, rel=1e-12)


@pytest.mark.parametrize("ranges", [1, 25])
def test_auroc_by_ranges(spark, ranges):
    rng = np.random.default_rng(9)
    rows = [(("a", "b")[i % 2], float(rng.choice([rng.random(), 0.25])), bool(rng.random() < 0.4)) for i in range(3000)]
    out = {r["g"]: r["auroc"] for r in cal.auroc(spark.createDataFrame(rows, "g string, s double, y boolean"), "s", "y", "g", ranges=ranges).collect()}
    for g in "ab":
        s, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        gap = s[y][:, None] - s[~y]
        assert out[g] == pytest.approx(((gap > 0) + (gap == 0) / 2).mean(), rel=1e-12)


@pytest.mark.parametrize("few", [5, 100_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "integers", "one"])
def test_quantiles_equal_percentile(spark, monkeypatch, few, kind):
    monkeypatch.setattr(od, "FEW_VALUES", few)
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(0, 1, 3000), "ties": rng.choice([-0.0, 0.0, 1.5, 2.5], 3000), "wide": rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-300, 300, 2000),
        "integers": rng.integers(-5, 2000, 3000).astype(float), "one": np.array([3.25]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double").repartition(5)
    shares = [0, 0.1, 1 / 3, 0.5, 0.777, 0.95, 1]
    want = df.agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("p")).first()["p"]
    got = od.quantiles(df, F.col("x"), shares)
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got, want, strict=True))


def test_quantiles_of_nothing_and_order_of_doubles(spark):
    assert od.quantiles(spark.createDataFrame([(None,)], "x double"), F.col("x"), [0.5, 1]) == [None, None]
    x = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, np.inf, np.nan])
    k = od._ordinal(x)
    assert (np.diff(k.astype(object)) > 0).all() and od._ordinal(np.array([-0.0]))[0] == k[4]
    assert [od._value(int(v)) for v in k[:-1]] == x[:-1].tolist()


def test_span_of_few_rows_and_ids_beyond_their_width(spark):
    df = spark.createDataFrame([(float(i), f"k{i}") for i in range(5)], "x double, k string")
    assert [r["k"] for r in rk.span_extremes(df, "x", "k", 3).collect()] == ["k0", "k4", "k1"]
    assert [r["k"] for r in rk.span_extremes(df, "x", "k", 9).collect()] == ["k0", "k4", "k1", "k3", "k2"]
    ids = {r["item_id"] for r in sm.number_items(spark.range(120).withColumnRenamed("id", "n"), "R", ["n"], width=2).collect()}
    assert len(ids) == 120 and {"R01", "R99", "R120"} <= ids
