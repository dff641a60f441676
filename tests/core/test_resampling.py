"""Bootstraps against the same draws worked out in plain numpy, n of n picks over many ranges, and coverage."""
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import inference, matched
from emberlane.operators import resampling as rs


def scored(seed, n=400, groups=2, clusters=30):
    rng = np.random.default_rng(seed)
    return [(f"g{i % groups}", f"c{rng.integers(0, clusters):02}", float(rng.integers(0, 12)) / 12, bool(rng.random() < 0.4)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, c string, s double, y boolean").repartition(5)


def plain_auroc(s, y, w):
    pos, neg = (w * y), (w * ~y)
    beats = (s[:, None] > s) + (s[:, None] == s) / 2
    return float(pos @ beats @ neg / (pos.sum() * neg.sum()))


def plain_ece(s, y, w):
    out = 0.0
    for b in range(10):
        here = (s >= b / 10) & ((s < (b + 1) / 10) | (b == 9))
        if (n := w[here].sum()) > 0:
            out += abs((w * y)[here].sum() - (w * s)[here].sum()) / w.sum() if n else 0
    return out


def test_metrics_equal_plain_ones_at_the_same_weights(spark):
    rows = scored(1)
    score, hit = F.col("s"), F.col("y")
    metric = rs.both(rs.both(rs.auroc(score, hit), rs.calibration_error(score, hit)), rs.quantile(score, 0.3))
    got = {(r["g"], r["draw"]): r for r in rs.bootstrap(frame(spark, rows), metric, ["g"], "c", draws=25, seed=4).collect()}
    assert len(got) == 52
    for g in ("g0", "g1"):
        mine = [r for r in rows if r[0] == g]
        names = sorted({r[1] for r in mine})
        s, y, at = np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([names.index(r[1]) for r in mine])
        w = rs._weights(4, zlib.crc32(repr([g]).encode()), 0, np.array([float(len(names))]), np.ones(len(names)), range(26))
        for d in range(26):
            each = w[d][at]
            r = got[g, d]
            assert w[d].sum() == len(names)
            assert r["auroc"] == pytest.approx(plain_auroc(s, y, each)) and r["ece"] == pytest.approx(plain_ece(s, y, each))
            drawn = np.sort(np.repeat(s, each.astype(int)))
            k = 0.3 * len(drawn)
            want = (drawn[math.ceil(k - 1e-9) - 1] + drawn[min(len(drawn) - 1, math.floor(k + 1e-9))]) / 2
            assert r["quantile"] == pytest.approx(want)


@pytest.mark.parametrize("cluster", [None, "c"])
def test_ranges_pick_n_of_n_and_keep_their_draws(spark, monkeypatch, cluster):
    monkeypatch.setattr(rs, "RANGE_ROWS", 20)
    monkeypatch.setattr(rs, "MERGED", 4000)
    rows = [(g, f"{c}{i % 97}", s + i % 7, y) for i, (g, c, s, y) in enumerate(scored(2, 1500, clusters=90))]
    terms = {"n": F.lit(1.0), "x": F.col("s")}
    metric = rs.Metric(("n", "mean"), terms, lambda _, s: (s["n"].sum(1), s["x"].sum(1) / s["n"].sum(1)), F.col("s"))
    a, b = ({(r["g"], r["draw"]): (r["n"], r["mean"]) for r in rs.bootstrap(frame(spark, t), metric, ["g"], cluster, 60, 9).collect()} for t in (rows, rows[::-1]))
    assert len(a) == 122 and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    for g in ("g0", "g1"):
        mine = [r for r in rows if r[0] == g]
        assert a[g, 0] == pytest.approx((len(mine), np.mean([r[2] for r in mine])))
        counts = {a[g, d][0] for d in range(61)}
        assert counts == {len(mine)} if cluster is None else len(counts) > 5
        sd = np.std([a[g, d][1] for d in range(1, 61)])
        assert 0.5 < sd / (np.std([r[2] for r in mine]) / math.sqrt(len(mine))) < 2


def test_intervals_cover_the_truth(spark):
    """Sixty samples of 50 normal values each: about 95 % of the mean's intervals hold the true mean."""
    rng = np.random.default_rng(12)
    rows = [(f"s{k}", float(v)) for k in range(60) for v in rng.normal(3, 2, 50)]
    metric = rs.of_sums({"x": F.col("x"), "n": F.lit(1.0)}, lambda s: s["x"] / s["n"])
    t = rs.bootstrap(spark.createDataFrame(rows, "g string, x double"), metric, ["g"], draws=400, seed=1).groupBy("g").agg(*rs.interval("value")).collect()
    assert 50 <= sum(r["lo"] <= 3 <= r["hi"] for r in t) <= 60 and all(r["n_draws"] == 400 for r in t)


def test_difference_of_arms_in_any_metric(spark):
    rng = np.random.default_rng(3)
    rows = [(arm, float(round(rng.normal(1.0 if arm == "a" and y else 0.0, 1), 2)), y) for arm in "abz" for y in (True, False) for _ in range(150)]
    df = spark.createDataFrame(rows, "arm string, s double, y boolean")
    auc = rs.difference(df, rs.auroc(F.col("s"), F.col("y")), "arm", "a", "b", draws=300).first()
    assert auc["lo"] > 0 and auc["p"] < 0.05 and auc["lo"] < auc["point"] < auc["hi"]
    same = rs.difference(df, rs.quantile(F.col("s"), 0.5), "arm", "b", "z", draws=300).first()
    assert same["lo"] < 0 < same["hi"] and same["p"] > 0.05


def test_nulls_empty_tables_and_too_many_cells(spark, monkeypatch):
    df = frame(spark, [("g", "c", None, True), ("g", None, 0.5, True), ("g", "c", 0.5, None), ("g", "c", 0.25, False), (None, "c", 1.0, True)])
    got = rs.bootstrap(df, rs.rate(F.col("y")), ["g"], "c", draws=3).collect()
    assert {(r["g"], r["draw"]): r["value"] for r in got} == {**{("g", d): 0.5 for d in range(4)}, **{("null", d): 1.0 for d in range(4)}}
    assert rs.bootstrap(df.limit(0), rs.rate(F.col("y")), ["g"], "c", draws=3).collect() == []
    monkeypatch.setattr(rs, "MOST_CELLS", 1)
    with pytest.raises(ValueError, match="cells"):
        rs.bootstrap(df, rs.auroc(F.col("s"), F.col("y")), cluster="c", draws=2)


def test_pair_risk_difference_by_key(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i}", float(i % 2), float(rng.binomial(5, 0.6)), 5, float(rng.binomial(5, 0.2)), 5) for i in range(120)]
    df = spark.createDataFrame(rows, "pair_id string, cer_target double, k_crit double, n_crit long, k_ctrl double, n_ctrl long")
    one = inference.risk_difference_bootstrap(df, draws=200).first()
    assert one["n_pairs"] == 120 and one["lo"] < 0.4 < one["hi"]
    assert one["point"] == pytest.approx(sum(r[2] for r in rows) / 600 - sum(r[4] for r in rows) / 600)
    assert {r["cer_target"]: r["n_pairs"] for r in inference.risk_difference_bootstrap(df, ("cer_target",), draws=50).collect()} == {"0.0": 60, "1.0": 60}


def counting(df, column):
    """``df`` with a column that counts the rows that pass it, and that count."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    passing = F.udf(one, df.schema[column].dataType).asNondeterministic()
    return df.withColumn(column, passing(column)), seen


def test_rates_share_one_pass_over_the_attempts(spark):
    rows = [(f"p{i % 12}", i % 2, "drift" if i % 3 else "faithful", (i % 4) / 10) for i in range(480)]
    df, seen = counting(spark.createDataFrame(rows, "pair_id string, critical int, label string, cer_target double"), "label")
    assert len(matched.risk_difference_by_rate(df, draws=20).collect()) == 4 and seen.value == len(rows)


def test_a_bootstrap_reads_its_table_once(spark):
    df, seen = counting(frame(spark, scored(2)), "s")
    rs.bootstrap(df, rs.auroc(F.col("s"), F.col("y")), ["g"], "c", draws=5).collect()
    assert seen.value == 400
    rs.bootstrap(df, rs.rate(F.col("s") > 0.5), draws=5).collect()
    assert seen.value == 800
