"""Fits by recovery of known truth and by identities; generators by their statistics; sources by round trips."""
import inspect
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import glm, inference, noise, sampling
from emberlane.sources import io
from emberlane.streaming import attempts as st


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(11)
    rows = []
    for m in range(120):
        u = rng.normal(0, 0.4)
        for x in (0.0, 0.1, 0.2, 0.3, 0.4):
            for r in range(4):
                p = 1 / (1 + math.exp(-(-2 + 6 * x + u)))
                rows.append((f"m{m}", f"k{r}", x, "drift" if rng.random() < p else "faithful" if rng.random() < 0.7 else "degraded"))
    return spark.createDataFrame(rows, "message_id string, model string, cer_target double, label string").withColumn("realized_cer", F.col("cer_target")).persist()


def test_logit_recovers_the_slope(simulated):
    r = {x["term"]: x for x in inference.dose_model(simulated).collect()}["cer_target"]
    assert abs(r["beta"] - 6) < 3 * r["se"] + 0.6 and r["converged"]


def test_saturated_logit_is_log_odds(simulated):
    dummies = {f"l{k}": (F.round("cer_target", 1) == k / 10).cast("double") for k in range(1, 5)}
    fit = glm.logit(simulated, F.col("label") == "drift", {"one": F.lit(1.0), **dummies})
    closed = {round(r["cer_target"] * 10): r["log_odds"] for r in inference.categorical_dose(simulated).collect()}
    assert all(fit.beta[k] == pytest.approx(closed[k], abs=1e-6) for k in closed)


def test_distributed_fit_equals_the_count_fit(simulated):
    fit = glm.logit(simulated, F.col("label") == "drift", {"one": F.lit(1.0), "x": F.col("realized_cer")}, ["message_id"])
    t = simulated.groupBy("message_id", "realized_cer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "drift").alias("k")).toPandas()
    b, se, ok = glm.fit_counts(t.realized_cer.to_numpy(), t.k.to_numpy(float), t.n.to_numpy(float), t.message_id.to_numpy())
    assert ok and fit.beta[1] == pytest.approx(b, rel=1e-6) and fit.table("message_id")[1]["se"] == pytest.approx(se, rel=1e-6)


def test_two_way_reduces_to_one_way_when_axes_coincide(simulated):
    df = simulated.withColumn("model", F.col("message_id"))
    r = inference.two_way_slope(df).first()
    assert r["se_twoway"] == pytest.approx(r["se_message_id"], rel=1e-9)


def test_multinomial_with_two_classes_is_logit(simulated):
    two = simulated.withColumn("label", F.when(F.col("label") == "drift", "drift").otherwise("faithful"))
    fit, _ = glm.multinomial(two, "label", ("faithful", "drift"), {"one": F.lit(1.0), "x": F.col("realized_cer")}, "message_id")
    ref = glm.logit(two, F.col("label") == "drift", {"one": F.lit(1.0), "x": F.col("realized_cer")}, ["message_id"])
    assert np.allclose(fit.beta, ref.beta, atol=1e-6) and np.allclose(fit.covariance("message_id"), ref.covariance("message_id"), rtol=1e-5)


def test_conditional_logit_is_the_discordant_ratio(spark):
    rows = [(f"s{i}", c, float(y)) for i in range(60) for c, y in ((1, i % 3 != 0), (0, i % 3 == 0))]
    df = spark.createDataFrame(rows, "s string, critical int, y double")
    fit = glm.conditional_pairs(df, "s", "critical", F.col("y"))
    assert fit.beta[0] == pytest.approx(math.log(2), abs=1e-6)
    many = glm.conditional_strata(df, "s", F.col("y"), {"critical": F.col("critical")})
    assert many.beta[0] == pytest.approx(fit.beta[0], abs=1e-6)
    with pytest.raises(ValueError, match="1:1"):
        glm.conditional_pairs(df.union(df), "s", "critical", F.col("y"))


def test_matched_effect_uses_every_row_of_a_stratum(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", c, "drift" if rng.random() < (0.45 if c else 0.3) else "faithful") for s in range(40) for c in (1, 0) for _ in range(rng.integers(1, 6))]
    df = spark.createDataFrame(rows, "pair_id string, critical int, label string")
    got = inference.matched_effect(df, ["pair_id"]).first()
    whole = glm.conditional_strata(df, "pair_id", (F.col("label") == "drift").cast("double"), {"critical": F.col("critical").cast("double")})
    assert got["beta"] == pytest.approx(whole.beta[0], abs=1e-7) and got["se"] == pytest.approx(whole.table()[0]["se"], rel=1e-6) and got["converged"]
    lone = spark.createDataFrame([(f"s{i}", c, "drift" if c == (i % 3 != 0) else "faithful") for i in range(60) for c in (1, 0)], "pair_id string, critical int, label string")
    got = inference.matched_effect(lone, ["pair_id"]).first()
    assert got["beta"] == pytest.approx(math.log(2), abs=1e-6) and got["n_discordant"] == 60


def test_gee_close_to_the_marginal_slope(simulated):
    r = inference.gee_slope(simulated).first()
    plain = {x["term"]: x for x in inference.dose_model(simulated).collect()}["cer_target"]
    assert abs(r["slope"] - plain["beta"]) < plain["se"] and r["se"] > 0


def test_bootstraps_are_seeded_and_sensible(simulated):
    a, b = (inference.slope_bootstrap(simulated, draws=40).first() for _ in range(2))
    assert a == b and a["lo"] < a["point"] < a["hi"]
    assert inference.slope_bootstrap(simulated, "model", draws=20).first()["unstable"]


def test_replicates_are_the_references(spark, simulated, monkeypatch):
    from emberlane.plans import registry

    registry.load()
    monkeypatch.setattr(registry, "view", lambda s, d, t: s.range(1) if t == "region" else simulated.withColumn("corpus", F.lit("AUTH")))
    draws = {n: registry.QUERIES[n](spark, "").first()["n_draws"] for n in ("generic_bootstrap", "bootstrap_slope_by_message", "bootstrap_slope_by_model", "bootstrap_rate")}
    assert draws == {"generic_bootstrap": 2000, "bootstrap_slope_by_message": 500, "bootstrap_slope_by_model": 500, "bootstrap_rate": 2000}
    assert registry.QUERIES["power_simulation"](spark, "").first()["n_sim"] == 200
    made = []
    monkeypatch.setattr(inference, "_weights", lambda rng, n, w=inference._weights: made.append(n) or w(rng, n))
    registry.QUERIES["stability_verdict"](spark, "").collect()
    assert len(made) == 500
    for f, n in ((inference.ece_auroc_bootstrap, 1000), (inference.curve_bootstrap, 1000), (inference.prevalence_bootstrap, 1000)):
        assert inspect.signature(f).parameters["draws"].default == n


def test_generic_bootstrap_of_a_mean(spark, simulated):
    terms = {"n": F.lit(1.0), "x": F.col("realized_cer")}
    a, b = (inference.resample(df, terms, lambda s: s["x"] / s["n"]).first() for df in (simulated, simulated.repartition(7)))
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in ("point", "lo", "hi", "se")) and a["n_draws"] == 2000
    x = np.array([r[0] for r in simulated.select("realized_cer").collect()])
    assert a["point"] == pytest.approx(x.mean()) and a["se"] == pytest.approx(x.std() / math.sqrt(len(x)), rel=0.1)
    assert a["hi"] - a["lo"] == pytest.approx(3.92 * a["se"], rel=0.1)


def test_power_grows_with_the_slope(spark):
    lo, hi = (inference.power(25, 2, s, -1.5, 0.3, 24, 5, spark).first()["power"] for s in (0.0, 6.0))
    assert lo < 0.5 < hi


def test_stability_verdict():
    v = inference.stability(8.0, [("a", 8.1, 7.0, 9.0), ("b", 8.6, 8.2, 9.0)])
    assert v["stable"] and not v["covered"] and v["spread"] == pytest.approx(0.5)


def test_noise_channel():
    m = np.zeros((36, 36))
    m[0, 1] = 1
    ch = noise.Channel(m)
    text = "A" * 4000 + "?" * 100
    out, sub, ins, dele, pos, passed = ch.corrupt(text, 0.3, 7)
    assert ch.corrupt(text, 0.3, 7) == (out, sub, ins, dele, pos, passed) and pos == sorted(set(pos))
    assert len(pos) == sub + ins + dele and abs(sub / 4000 - 0.27) < 0.03 and abs((ins + dele) / 4100 - 0.03) < 0.015
    assert len(out) == len(text) + ins - dele and 80 < passed <= 100 and out.count("B") >= sub
    assert ch.corrupt("A?", 0.0, 1) == ("A?", 0, 0, 0, [], 1)
    assert ch.corrupt("B" * 50, 0.9, 3)[1] > 20  # an empty row falls back to any other character


def test_exposure_grid(spark):
    msgs = spark.createDataFrame([("m1", "AUTH", "please help me now"), ("m2", "AUTH", "")], "message_id string, corpus string, text string")
    t = noise.exposure(msgs, np.ones((36, 36)), (0.0, 0.4), 3, 9)
    rows = t.collect()
    assert len(rows) == 12 and all(r["realized_cer"] == 0 and r["noisy_text"] == r["text"] for r in rows if r["cer_target"] == 0)
    assert len({r["noisy_text"] for r in rows if r["message_id"] == "m1" and r["cer_target"] == 0.4}) == 3


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("i1", 'a "q", b', "n"), ("i2", "x\ny", None)], "item_id string, rating string, notes string")
    io.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/csv", ["item_id"]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="missing"):
        io.read_csv(spark, f"{tmp_path}/csv", ["nope"])
    with pytest.raises(ValueError, match="repeats"):
        io.read_sheets(spark, [f"{tmp_path}/csv", f"{tmp_path}/csv"])
    io.write_parquet(df, f"{tmp_path}/pq")
    assert io.frame(spark, f"{tmp_path}/pq", ["item_id"]).columns == ["item_id"]
    (tmp_path / "mymodel_shard3.jsonl").write_text('{"output_message": "ok"}\n\n{broken\n{"output_message": "__ERROR__ x"}\n')
    from pyspark.sql import types as T

    got = io.read_outputs(spark, f"{tmp_path}/mymodel_shard3.jsonl", T.StructType([T.StructField("model", T.StringType()), T.StructField("output_message", T.StringType())])).collect()
    assert [tuple(r) for r in got] == [("mymodel", "ok")]
    io.write_shards(spark.range(10).withColumnRenamed("id", "k"), f"{tmp_path}/sh", 4, ["k"])
    assert sorted(r["shard"] for r in spark.read.json(f"{tmp_path}/sh").select("shard").distinct().collect()) == [0, 1, 2, 3]
    items = [{"message_id": "p", "category": "message_critical", "source_category": "authored", "intended_text": "é", "drift_type": None, "dangerous_variant": None}]
    h = io.freeze_probes(spark, items, f"{tmp_path}/p.json")
    assert h == io.canonical_sha256(json.loads((tmp_path / "p.json").read_text())) and io.read_probes(spark, f"{tmp_path}/p.json").count() == 1
    io.write_digest(spark, {"a": df, "b": np.float64(2.5), "c": {1, 2}}, f"{tmp_path}/d.json")
    assert json.loads((tmp_path / "d.json").read_text())["b"] == 2.5
    io.log_provenance(spark, f"{tmp_path}/log", "x", {"n": np.int64(1)})
    io.log_provenance(spark, f"{tmp_path}/log", "x", {"m": 2})
    assert io.read_provenance(spark, f"{tmp_path}/log")["x"] == {"n": 1, "m": 2}
    m = np.eye(36)
    io.write_matrix(spark, m, noise.ALPHABET, f"{tmp_path}/m")
    assert np.array_equal(noise.matrix_array(spark.read.parquet(f"{tmp_path}/m")), m)


def test_streaming_rates(spark, tmp_path):
    rows = [{"message_id": f"m{i}", "corpus": "AUTH", "cer_target": 0.1, "label": "drift" if i % 4 == 0 else "faithful"} for i in range(20)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("message_id string, corpus string, cer_target double, label string").json(str(tmp_path))
    q = st.running_rates(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["drift_rate"]) for r in spark.sql("select * from running").collect()] == [(20, 0.25)]


def test_conditional_fit_against_all_subsets(spark):
    """Likelihood, score and information of strata by enumeration of every way to place the successes."""
    from itertools import combinations

    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (4, 5, 3)), np.zeros((4, 5))
    for s in range(4):
        y[s, rng.choice(5, 2, replace=False)] = 1
    b = np.array([0.4, -0.7, 0.2])
    ll, g, h = 0.0, np.zeros(3), np.zeros((3, 3))
    for s in range(4):
        ways = [x[s, list(c)].sum(0) for c in combinations(range(5), 2)]
        w = np.exp([v @ b for v in ways])
        mean = sum(wi * v for wi, v in zip(w, ways, strict=True)) / w.sum()
        won = y[s] @ x[s]
        ll, g = ll + won @ b - math.log(w.sum()), g + won - mean
        h += sum(wi * np.outer(v, v) for wi, v in zip(w, ways, strict=True)) / w.sum() - np.outer(mean, mean)
    a = glm.conditional_sums(x, y, b)
    assert a[0] == pytest.approx(ll) and np.allclose(a[1], g) and np.allclose(a[2], h)


def test_large_strata_equal_the_hypergeometric_counts(spark):
    """Strata of thousands of rows, whose number of ways is beyond a double's range."""
    rng = np.random.default_rng(4)
    rows = [(f"s{s}", c, float(rng.random() < (0.5 if c else 0.42))) for s in range(3) for c in (1, 0) for _ in range(1500)]
    df = spark.createDataFrame(rows, "s string, critical int, y double")
    cells = glm.conditional_strata(df, "s", F.col("y"), {"critical": F.col("critical")})
    counts = glm.conditional_counts(df, "s", "critical", F.col("y"))
    assert cells.converged and cells.n == 9000 and cells.clusters["strata"] == 3
    assert cells.beta[0] == pytest.approx(counts.beta[0], abs=1e-9) and cells.bread[0, 0] == pytest.approx(counts.bread[0, 0], rel=1e-9)


def test_strata_alone_and_together_give_the_same_sums():
    """Many cells by matrix products, few by the flat path, every row its own cell or rows gathered into cells."""
    rng = np.random.default_rng(6)
    b = np.array([0.6, -1.1])
    x = rng.integers(0, 3, (4, 250, 2)).astype(float)
    y = (rng.random((4, 250)) < 0.4).astype(float)
    ll, g, h = glm.conditional_sums(x, y, b)
    cells = []
    for s in range(4):
        kinds, at = np.unique(x[s], axis=0, return_inverse=True)
        cells.append((kinds, np.bincount(at.ravel()).astype(float), np.bincount(at.ravel(), weights=y[s])))
    start = np.cumsum([0, *[len(c[0]) for c in cells[:-1]]])
    got = glm.conditional_cells(*[np.concatenate([c[i] for c in cells]) for i in range(3)], start, b)
    assert got[0] == pytest.approx(ll, rel=1e-12) and np.allclose(got[1], g, rtol=1e-9, atol=1e-9) and np.allclose(got[2], h, rtol=1e-9)


def test_adjusted_effect_by_group_equals_each_fit_alone(spark):
    from emberlane.contracts import ContractError
    from emberlane.operators import matched

    rng = np.random.default_rng(3)
    rows = []
    for s in range(120):
        u = rng.normal(0, 1)
        for c in (1, 0):
            for _ in range(2):
                z = [float(v) for v in rng.normal(0, 1, 5)]
                rows.append((f"s{s}", f"m{s % 2}", c, int(rng.random() < 1 / (1 + math.exp(-(u + 0.8 * c + 0.5 * z[4])))), *z))
    df = spark.createDataFrame(rows, "pair_id string, model string, critical int, drift int, " + ", ".join(f"{a} double" for a in matched.ADJUSTERS))
    both = {(r["model"], r["term"]): r for r in matched.adjusted_effect(df, ["pair_id"], by="model").collect()}
    assert [k for k, _ in both] == ["m0"] * 6 + ["m1"] * 6
    for m in ("m0", "m1"):
        for r in matched.adjusted_effect(df.where(F.col("model") == m), ["pair_id"]).collect():
            assert both[m, r["term"]]["beta"] == pytest.approx(r["beta"], abs=1e-7) and both[m, r["term"]]["n_pairs"] == r["n_pairs"] and r["converged"]
    whole = {r["term"]: r for r in matched.adjusted_effect(df, ["pair_id"]).collect()}
    assert abs(whole["critical"]["beta"] - 0.8) < 3 * whole["critical"]["se"] and abs(whole["realized_cer"]["beta"] - 0.5) < 3 * whole["realized_cer"]["se"]
    with pytest.raises(ContractError):
        matched.adjusted_effect(df.withColumn("char_len", F.lit(None).cast("double")), ["pair_id"])


def test_risk_difference_by_rate_seeds_each_rate(spark):
    from emberlane.operators import matched

    rng = np.random.default_rng(2)
    rows = [(f"m{2 * p + 1 - c}", f"m{2 * p}", c, x, "drift" if rng.random() < 0.3 + 0.2 * c * x else "faithful") for p in range(30) for c in (1, 0) for x in (0.1, 0.3) for _ in range(4)]
    df = spark.createDataFrame(rows, "message_id string, pair_id string, critical int, cer_target double, label string")
    out = matched.risk_difference_by_rate(df, draws=50, seed=7).collect()
    assert [(r["cer_target"], r["seed"]) for r in out] == [(0.1, 7), (0.3, 8)]
    for r in out:
        alone = matched.risk_difference_by_rate(df.where(F.round("cer_target", 1) == r["cer_target"]), draws=50, seed=r["seed"]).first()
        assert (alone["point"], alone["lo"], alone["hi"]) == (r["point"], r["lo"], r["hi"]) and r["lo"] <= r["point"] <= r["hi"]


def test_random_intercept_of_balanced_data_is_the_analysis_of_variance(spark):
    rng = np.random.default_rng(4)
    g, n = 60, 6
    x = np.tile(np.linspace(0, 1, n), (g, 1))
    y = 1 + 2 * x + rng.normal(0, 0.7, (g, 1)) + rng.normal(0, 0.5, (g, n))
    df = spark.createDataFrame([(f"g{i}", float(x[i, j]), float(y[i, j])) for i in range(g) for j in range(n)], "g string, x double, y double")
    fit, residual, between = glm.random_intercept(df, F.col("y"), {"one": F.lit(1.0), "x": F.col("x")}, "g")
    slope = ((x - x.mean()) * (y - y.mean(1, keepdims=True))).sum() / ((x - x.mean()) ** 2).sum()
    within = (y - y.mean(1, keepdims=True) - slope * (x - x.mean())).ravel()
    ms_w = (within**2).sum() / (g * (n - 1) - 1)
    ms_b = n * y.mean(1).var(ddof=1)
    assert fit.beta[1] == pytest.approx(slope, abs=1e-9) and residual == pytest.approx(ms_w, rel=1e-4) and between == pytest.approx((ms_b - ms_w) / n, rel=1e-3)


def test_numbering_in_buckets_is_the_order(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(v), f"k{v % 7}", i) for i, v in enumerate(rng.integers(0, 400, 3000))], "a long, b string, i long")
    out = sorted(sampling.numbered(df, ["b", "a", "i"], "place", ranges=9).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in out] == list(range(1, 3001)) and [(r["b"], r["a"], r["i"]) for r in out] == sorted((r["b"], r["a"], r["i"]) for r in out)
    assert sampling.numbered(df.limit(0), ["a"], "place").count() == 0 and sampling.numbered(df.limit(1), ["a"], "place").first()["place"] == 1


def test_fallback_fit_is_the_newton_fit(simulated, monkeypatch):
    xs = {"intercept": F.lit(1.0), "x": F.col("realized_cer")}
    fit, _ = glm.multinomial(simulated, "label", ("faithful", "degraded", "drift"), xs, "message_id")
    monkeypatch.setattr(glm, "_newton", lambda stats, p: (np.zeros(p), np.eye(p), False, 0.0))
    other, _ = glm.multinomial(simulated, "label", ("faithful", "degraded", "drift"), xs, "message_id")
    assert (fit.engine, other.engine) == ("newton", "lbfgs") and np.allclose(fit.beta, other.beta, atol=1e-3) and other.converged


def test_dedupe_apply_answers_null_keys(spark):
    from emberlane import contracts as ct

    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), (None, 4)], "k string, v int")
    out = ct.dedupe_apply(df, ["k"], lambda t: t.withColumn("n", F.coalesce(F.length("k"), F.lit(-1))))
    assert sorted((r["v"], r["n"]) for r in out.collect()) == [(1, 1), (2, -1), (3, 1), (4, -1)] and out.columns == ["k", "v", "n"]
