"""Crossed random intercepts: against a dense one-coordinate-at-a-time fit of the same bound, and against quadrature."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import inference, mixed


def simulate(seed, messages=30, models=4, sd=(0.9, 0.5, 0.4), each=3):
    rng = np.random.default_rng(seed)
    um, uk, uc = rng.normal(0, sd[0], messages), rng.normal(0, sd[1], models), rng.normal(0, sd[2], 3)
    rows = []
    for m in range(messages):
        for k in range(models):
            for _ in range(each):
                x, z = float(rng.choice([0, 0.1, 0.2, 0.3, 0.4])), float(rng.integers(0, 2))
                eta = -1 + 4 * x - 0.5 * z + um[m] + uk[k] + uc[m % 3]
                rows.append((f"m{m:02}", f"k{k}", f"c{m % 3}", x, z, float(rng.random() < 1 / (1 + math.exp(-eta)))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "message_id string, model string, corpus string, x double, z double, y double")


def xs():
    return {"one": F.lit(1.0), "x": F.col("x"), "z": F.col("z")}


def dense_fit(rows, sweeps=3000):
    """Coordinate ascent of the same bound: each mean by its own Newton step, each variance and log deviation in turn."""
    names = [sorted({r[c] for r in rows}) for c in (0, 1, 2)]
    x = np.array([[1, r[3], r[4]] for r in rows])
    center, scale = x.mean(0), x.std(0)
    center[0], scale[0] = 0, 1
    x = np.column_stack([(x - center) / scale, *[[[float(r[c] == v) for v in names[c]] for r in rows] for c in (0, 1, 2)]])
    owner = np.array([0] * 3 + sum(([c + 1] * len(names[c]) for c in (0, 1, 2)), []))
    y = np.array([r[5] for r in rows])
    mean, var, tau = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1), [(-0.5, 0.1)] * 3
    at, weight = np.polynomial.hermite.hermgauss(30)
    for _ in range(sweeps):
        before = mean.copy()
        eta, spread = x @ mean, (x * x) @ var
        for j in range(x.shape[1]):
            here = x[:, j] != 0
            p = 1 / (1 + np.exp(-(eta[here, None] + np.sqrt(2 * spread[here, None]) * at)))
            w = weight / math.sqrt(math.pi)
            hold = 0.25 if owner[j] == 0 else math.exp(-2 * tau[owner[j] - 1][0] + 2 * tau[owner[j] - 1][1])
            slope = hold + x[here, j] ** 2 @ ((p * (1 - p)) @ w)
            step = (x[here, j] @ (y[here] - p @ w) - hold * mean[j]) / slope
            new = 1 / slope
            mean[j] += step
            eta[here] += x[here, j] * step
            spread[here] += x[here, j] ** 2 * (new - var[j])
            var[j] = new
        for g in range(3):
            mine = owner == g + 1
            q, (m, s2) = float((mean[mine] ** 2 + var[mine]).sum()), tau[g]
            for _ in range(60):
                e = math.exp(-2 * m + 2 * s2) * q
                m += (e - mine.sum() - m) / (2 * e + 1)
                s2 = 1 / (2 * math.exp(-2 * m + 2 * s2) * q + 1)
            tau[g] = (m, s2)
        if np.abs(mean - before).max() < 1e-9:
            break
    return mean[:3] / scale, np.sqrt(var[:3]) / scale, [math.exp(m) for m, _ in tau]


def test_equals_a_dense_fit_of_the_same_bound(spark):
    rows = simulate(3)
    fit = mixed.crossed_logit(frame(spark, rows), F.col("y"), xs(), "message_id", ["model", "corpus"])
    mean, sd, deviations = dense_fit(rows)
    assert fit.converged and fit.n == len(rows) and fit.levels == {"message_id": 30, "model": 4, "corpus": 3}
    assert np.allclose(fit.mean, mean, atol=2e-3) and np.allclose(fit.sd, sd, rtol=2e-3)
    assert np.allclose(list(fit.deviations.values()), deviations, rtol=5e-3)


def test_one_intercept_agrees_with_quadrature(spark):
    """Maximum likelihood by exhaustive quadrature over each cluster's intercept: 40 clusters of 24 rows."""
    rows = simulate(8, messages=40, models=1, sd=(1.0, 0, 0), each=24)
    fit = mixed.crossed_logit(frame(spark, rows), F.col("y"), xs(), "message_id")
    x = np.array([[1, r[3], r[4]] for r in rows])
    y = np.array([r[5] for r in rows])
    g = np.unique([r[0] for r in rows], return_inverse=True)[1]
    at, weight = np.polynomial.hermite.hermgauss(60)

    def minus_loglik(theta):
        eta = (x @ theta[:3])[:, None] + math.sqrt(2) * math.exp(theta[3]) * at
        each = np.zeros((g.max() + 1, len(at)))
        np.add.at(each, g, y[:, None] * eta - np.logaddexp(0, eta))
        return -float(np.log((np.exp(each) * weight).sum(1)).sum())

    theta = np.array([-1.0, 4.0, -0.5, 0.0])
    for _ in range(40):  # Newton by differences
        e = 1e-4 * np.eye(4)
        grad = np.array([(minus_loglik(theta + a) - minus_loglik(theta - a)) / 2e-4 for a in e])
        hess = np.array([[(minus_loglik(theta + a + b) - minus_loglik(theta + a - b) - minus_loglik(theta - a + b) + minus_loglik(theta - a - b)) / 4e-8 for a in e] for b in e])
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    se = np.sqrt(np.diag(np.linalg.inv(hess)))
    assert np.all(np.abs(fit.mean[1:] - theta[1:3]) < 0.35 * se[1:3])  # weak priors pull a little
    assert fit.deviations["message_id"] == pytest.approx(math.exp(theta[3]), rel=0.1)


def test_hot_level_levels_without_rows_of_a_class_and_nulls(spark):
    rows = simulate(4, messages=8, models=2) + [("hot", "k0", "c0", 0.1, 1.0, float(i % 3 == 0)) for i in range(3000)]
    fit = mixed.crossed_logit(frame(spark, rows), F.col("y"), xs(), "message_id", ["model"])
    assert fit.converged and fit.levels["message_id"] == 9 and all(math.isfinite(v) for v in fit.mean)
    with pytest.raises(ValueError, match="null"):
        mixed.crossed_logit(frame(spark, [*rows, ("m", None, "c", 0.1, 0.0, 1.0)]), F.col("y"), xs(), "message_id", ["model"])
    with pytest.raises(ValueError, match="levels"):
        mixed.crossed_logit(frame(spark, [(f"m{i}", f"k{i}", "c", 0.1, 0.0, 1.0) for i in range(400)]), F.col("y"), xs(), "corpus", ["model"])


def test_ladder_of_engines(spark):
    rows = frame(spark, simulate(5, messages=12, models=2)).withColumn("label", F.when(F.col("y") == 1, "drift").when(F.col("z") == 1, "degraded").otherwise("faithful"))
    only = {"x": F.col("x")}
    settled = inference.mixed_one_versus_rest(rows, only, "message_id", ("model",)).collect()
    assert {r["engine"] for r in settled} == {"glmm_vb"} and {r["term"] for r in settled if r["kind"] == "deviation"} == {"message_id", "model"}
    short = inference.mixed_one_versus_rest(rows, only, "message_id", ("model",), steps=1).collect()
    assert {r["engine"] for r in short} == {"clustered_logit_fallback"} and {r["term"] for r in short} == {"intercept", "x"}


def test_factors_without_any_effect_settle(spark):
    fit = mixed.crossed_logit(frame(spark, simulate(6, messages=25, models=4, sd=(0, 0, 0), each=8)), F.col("y"), xs(), "message_id", ["model", "corpus"])
    assert fit.converged and fit.steps <= 30 and all(v < 0.45 for v in fit.deviations.values())


def test_outcomes_share_their_patterns_and_passes(spark, monkeypatch):
    kept = []
    keep = mixed.Scratch.keep
    monkeypatch.setattr(mixed.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    rows = frame(spark, simulate(7, messages=12, models=3))
    fits = mixed.crossed_logits(rows, {"yes": F.col("y"), "no": 1 - F.col("y")}, xs(), "message_id", ["model", "corpus"])
    a, b = fits["yes"], fits["no"]
    assert a.converged and b.converged and len(kept) == 3 + 2 * max(a.steps, b.steps)
    assert np.allclose(a.mean, -b.mean, atol=1e-6) and np.allclose(a.sd, b.sd) and a.bound == pytest.approx(b.bound)


def test_blocks_are_bounded_in_bytes_for_the_reader():
    """Spark's Parquet reader decodes 4096 rows of blobs at once: 64 MiB of them a task, with many covariates too."""
    import pyarrow as pa

    for xs, ys in ((8, 3), (200, 1), (3000, 1)):
        n = 9000 if xs < 100 else 40
        columns = {"g": ["a"] * (n - 1) + ["b"], "f0": ["u", "v"] * (n // 2)} | {f"x{k}": np.arange(n) + float(k) for k in range(xs)} | {"n": np.ones(n)} | {f"k{c}": np.zeros(n) for c in range(ys)}
        packed = pa.Table.from_batches(mixed._packed(xs, ys, np.zeros(xs), np.ones(xs), [["u", "v"]])(iter([pa.RecordBatch.from_pydict(columns)])))
        sizes = np.array([sum(len(r[c]) for c in "xfk") for r in packed.to_pylist()])
        m = np.array(packed["m"].to_pylist())
        assert m.sum() == n and packed["g"].to_pylist()[-2:] == ["a", "b"] and np.all((sizes <= 16 << 10) | (m == 1))
        got = np.concatenate([np.frombuffer(r, np.float64).reshape(-1, xs)[:, 0] for r in packed["x"].to_pylist()])
        assert np.array_equal(got, np.arange(n))


def test_expectations_in_pairs_of_nodes():
    m, v = np.array([-40.0, -3.0, 0.0, 0.7, 30.0]), np.array([0.0, 2.0, 0.3, 50.0, 1.0])
    at, weight = np.polynomial.hermite.hermgauss(mixed.NODES)
    eta, w = m[:, None] + np.sqrt(2 * v)[:, None] * at, weight / math.sqrt(math.pi)
    p = 1 / (1 + np.exp(-eta))
    for got, wanted in zip(mixed.expectations(m, v, True), (p @ w, (p * (1 - p)) @ w, np.logaddexp(0, eta) @ w), strict=True):
        assert np.allclose(got, wanted, atol=1e-12)
