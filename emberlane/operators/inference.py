"""The study's models and resampling, on top of :mod:`emberlane.operators.glm`."""
from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.operators import agreement as ag
from emberlane.operators import calibration as cal
from emberlane.operators import glm, mixed
from emberlane.operators import resampling as rs
from emberlane.schema import CLASSES, CONDITIONS, Z_EXACT


def _drift() -> Column:
    return (F.col("label") == "drift").cast("double")



def _intercept() -> dict[str, Column]:
    return {"intercept": F.lit(1.0)}


def _frame(df: DataFrame, rows: list[dict]) -> DataFrame:
    kinds = {float: "double", int: "long", str: "string", bool: "boolean"}
    cols: dict[str, str] = {}
    for r in rows:
        for k, v in r.items():
            if k not in cols or (cols[k] == "void" and v is not None):
                cols[k] = kinds.get(type(v), "void")
    cols = {k: "double" if v == "void" else v for k, v in cols.items()}
    clean = [tuple(None if isinstance(r.get(k), float) and math.isnan(r[k]) else r.get(k) for k in cols) for r in rows]
    return df.sparkSession.createDataFrame(clean, ", ".join(f"`{k}` {v}" for k, v in cols.items()))


def dose_model(df: DataFrame, x: str = "cer_target", weight: Column | None = None) -> DataFrame:
    """drift ~ 1 + x, errors clustered by message; odds ratio per ten points of x."""
    fit = glm.logit(df, _drift(), {**_intercept(), x: F.col(x)}, ["message_id"], weight)
    return _frame(df, [r | {"n": int(fit.n), "n_clusters": fit.clusters["message_id"], "converged": fit.converged} for r in fit.table("message_id", scale=0.1)])


def predicted_grid(df: DataFrame, x: str = "realized_cer", grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4), weight: Column | None = None) -> DataFrame:
    fit = glm.logit(df, _drift(), {**_intercept(), x: F.col(x)}, weight=weight)
    return _frame(df, [{x: g, "predicted": 1 / (1 + math.exp(-(fit.beta[0] + fit.beta[1] * g)))} for g in grid])


def categorical_dose(df: DataFrame, reference: float = 0.0) -> DataFrame:
    """Level dummies against a reference level: closed-form log-odds differences from one count per level."""
    t = df.groupBy(F.round("cer_target", 1).alias("cer_target")).agg(F.count(F.lit(1)).alias("n"), F.sum(_drift()).alias("k"))
    odds = F.ln(F.col("k") / (F.col("n") - F.col("k")))
    base = t.where(F.col("cer_target") == reference).select(odds.alias("base"))
    return t.where(F.col("cer_target") != reference).crossJoin(F.broadcast(base)).select("cer_target", (odds - F.col("base")).alias("log_odds"), F.exp(odds - F.col("base")).alias("odds_ratio"))


def two_way_slope(df: DataFrame, x: str = "realized_cer", fallback: str = "max") -> DataFrame:
    fit = glm.logit(df, _drift(), {**_intercept(), x: F.col(x)}, ["message_id", "model", ("message_id", "model")])
    return _frame(df, [glm.two_way(fit, "message_id", "model", 1, fallback) | {"n_obs": int(fit.n), "n_message_clusters": fit.clusters["message_id"], "n_model_clusters": fit.clusters["model"]}])


def meats_at(df: DataFrame, beta: tuple[float, float], x: str = "realized_cer") -> DataFrame:
    """Cluster meats of the slope at a given point, by message, by model and by both: plain aggregation."""
    s = _drift() - glm.sigmoid(F.lit(beta[0]) + beta[1] * F.col(x))
    out = None
    for name, key in (("message", ["message_id"]), ("model", ["model"]), ("both", ["message_id", "model"])):
        g = df.groupBy(*key).agg(F.sum(s).alias("s0"), F.sum(s * F.col(x)).alias("s1"))
        one = g.agg(F.lit(name).alias("clustering"), F.count(F.lit(1)).alias("n_clusters"), F.sum(F.col("s0") * F.col("s0")).alias("m00"), F.sum(F.col("s0") * F.col("s1")).alias("m01"), F.sum(F.col("s1") * F.col("s1")).alias("m11"))
        out = one if out is None else out.unionByName(one)
    return out


def multinomial_model(df: DataFrame, xs: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Multinomial logit against faithful, clustered by message: Newton steps, or the quasi-Newton fit where they don't settle."""
    fit, _ = glm.multinomial(df, "label", CLASSES, {**_intercept(), **xs}, "message_id", weight)
    return _frame(df, [r | {"converged": fit.converged} for r in fit.table("message_id")])


def mixed_curve(df: DataFrame, x: str = "cer_target") -> DataFrame:
    """First-layout drift curve as a linear mixed model: drift ~ 1 + x with a random intercept per message, by restricted likelihood."""
    fit, residual, between = glm.random_intercept(df, _drift(), {**_intercept(), x: F.col(x)}, "message_id")
    return _frame(df, [r | {"residual_variance": float(residual), "message_variance": float(between), "n": int(fit.n), "n_messages": fit.clusters["message_id"]} for r in fit.table()])


def binary_contrast(df: DataFrame, positive: str, negative: str, xs: dict[str, Column], weight: Column | None = None) -> DataFrame:
    rows = df.where(F.col("label").isin(positive, negative))
    fit = glm.logit(rows, F.col("label") == positive, {**_intercept(), **xs}, ["message_id"], weight)
    return _frame(df, fit.table("message_id"))


def one_versus_rest(df: DataFrame, xs: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Adjusted model of each class against the rest by the clustered logit, which is the engine at scale; engine is told."""
    rows = []
    for c in CLASSES:
        fit = glm.logit(df, F.col("label") == c, {**_intercept(), **xs}, ["message_id"], weight)
        rows += [{"class": c, **r, "engine": "clustered_logit", "converged": fit.converged} for r in fit.table("message_id")]
    return _frame(df, rows)


def mixed_one_versus_rest(df: DataFrame, xs: dict[str, Column], large: str, small: tuple[str, ...], steps: int = mixed.STEPS) -> DataFrame:
    """Adjusted model of each class against the rest with crossed random intercepts; where that doesn't settle, the clustered logit.

    One row a coefficient (mean, sd, 95 % interval) and one a factor (median deviation, its number of levels); ``engine`` says
    which fit it was. The classes are fitted in step, over one table of patterns.
    """
    ys = {c: (F.col("label") == c).cast("double") for c in CLASSES}
    fits = mixed.crossed_logits(df, ys, {**_intercept(), **xs}, large, small, steps)

    def one(c: str) -> list[dict]:
        fit = fits[c]
        about = {"class": c, "engine": "glmm_vb", "converged": True, "n_obs": fit.n}
        rows = [
            {**about, "kind": "coefficient", "term": t, "est": float(m), "sd": float(s), "lo": float(m - 1.96 * s), "hi": float(m + 1.96 * s), "n_levels": None}
            for t, m, s in zip(fit.names, fit.mean, fit.sd, strict=True)
        ]
        if not fit.converged:
            plain = glm.logit(df, ys[c], {**_intercept(), **xs}, [large])
            about |= {"engine": "clustered_logit_fallback", "converged": plain.converged}
            keep = {"est": "beta", "sd": "se", "lo": "lo", "hi": "hi"}
            return [{**about, "kind": "coefficient", "term": r["term"], **{a: r[b] for a, b in keep.items()}, "n_levels": None} for r in plain.table(large)]
        return rows + [{**about, "kind": "deviation", "term": f, "est": v, "sd": None, "lo": None, "hi": None, "n_levels": fit.levels[f]} for f, v in fit.deviations.items()]

    with ThreadPoolExecutor(len(CLASSES)) as pool:
        return _frame(df, [r for rows in pool.map(one, CLASSES) for r in rows])


def interface_model(df: DataFrame, interaction: bool = True) -> DataFrame:
    """drift ~ condition (reference forced) with the rate, and with their interaction if it can be fitted; declined rows out.

    With an interaction a condition's odds ratio is its effect at rate 0; the main-effects fit is always reported too.
    """
    rows = df.where(~F.coalesce(F.col("abstained"), F.lit(False)))
    present = {r[0] for r in rows.select("condition").distinct().collect()}
    names = [c for c, *_ in CONDITIONS if c in present and c != "forced"]
    is_c = {c: (F.col("condition") == c).cast("double") for c in names}
    main = {**_intercept(), **is_c, "rate": F.col("cer_target")}
    kinds = [("main", main)]
    if interaction:
        kinds.append(("interaction", {**main, **{f"{c}:rate": is_c[c] * F.col("cer_target") for c in names}}))
    out = []
    for kind, xs in kinds:
        fit = glm.logit(rows, _drift(), xs, ["message_id"])
        if kind == "interaction" and not fit.converged:
            continue
        out += [{"model": kind, **r, "converged": fit.converged} for r in fit.table("message_id")]
    return _frame(df, out)


def matched_effect(matched: DataFrame, stratum: list[str]) -> DataFrame:
    """Critical against control within strata of any size, on all rows; a stratum key made of several columns."""
    fit = glm.conditional_counts(matched.withColumn("_s", F.concat_ws("|", *stratum)), "_s", "critical", _drift())
    return _frame(matched, [r | {"n_discordant": fit.clusters["_s"], "n_rows": int(fit.n), "converged": fit.converged} for r in fit.table()])


def matched_effect_strata(matched: DataFrame, stratum: list[str], xs: dict[str, Column]) -> DataFrame:
    fit = glm.conditional_strata(matched.withColumn("_s", F.concat_ws("|", *stratum)), "_s", _drift(), {"critical": F.col("critical").cast("double"), **xs})
    return _frame(matched, [r | {"n_rows": int(fit.n), "converged": fit.converged} for r in fit.table()])


def gee_slope(df: DataFrame, x: str = "realized_cer", weight: Column | None = None) -> DataFrame:
    g = glm.gee_exchangeable(df, _drift(), {**_intercept(), x: F.col(x)}, "message_id", weight=weight)
    b, se = float(g["beta"][-1]), float(g["se"][-1])
    return _frame(df, [{"slope": b, "se": se, "lo": b - Z_EXACT * se, "hi": b + Z_EXACT * se, "alpha": g["alpha"], "cov_struct_used": g["cov_struct_used"], "n_groups": g["n_groups"]}])


def model_slopes(df: DataFrame, x: str = "realized_cer", weight: Column | None = None) -> DataFrame:
    return glm.slopes_by(df, "model", F.col("label") == "drift", x, "message_id", weight)


def pooled_slope(df: DataFrame, x: str = "realized_cer", weight: Column | None = None) -> DataFrame:
    """Per-model slopes pooled with random effects; models without a usable fit stay out."""
    s = model_slopes(df, x, weight).where("converged and se > 0")
    t = s.select("slope", (F.col("slope") - 1.96 * F.col("se")).alias("lo"), (F.col("slope") + 1.96 * F.col("se")).alias("hi"))
    return cal.random_effects(t, "slope", "lo", "hi")


def aggregated_model(df: DataFrame) -> DataFrame:
    """Message-level grouped binomial: drift count of n on the message's mean realised rate."""
    t = df.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.sum(_drift()).alias("k"), F.avg("realized_cer").alias("x"))
    fit = glm.logit(t, F.col("k"), {**_intercept(), "mean_rate": F.col("x")}, ["message_id"], trials=F.col("n"))
    return _frame(df, fit.table("message_id"))


def stability(anchor: float, slopes: list[tuple[str, float, float, float]], tolerance: float = 10.0) -> dict:
    """Spread of slopes, their largest deviation from the anchor in percent, whether their intervals cover it."""
    values = [s for _, s, *_ in slopes]
    off = max(abs(s - anchor) / abs(anchor) * 100 for s in values)
    return {"spread": max(values) - min(values), "max_deviation_pct": off, "stable": off <= tolerance, "covered": all(lo <= anchor <= hi for _, _, lo, hi in slopes)}


# Resampling: statistics of clusters are aggregated by Spark (one row per cluster, a number that the design fixes);
# draws are seeded numpy over those rows, in sorted cluster order.


def _weights(rng: np.random.Generator, n: int) -> np.ndarray:
    return np.bincount(rng.integers(0, n, size=n), minlength=n).astype(float)


def _interval(df: DataFrame, point: float, draws: list[float], **more: object) -> DataFrame:
    d = np.array([x for x in draws if math.isfinite(x)])
    lo, hi = np.percentile(d, [2.5, 97.5]) if len(d) else (math.nan, math.nan)
    return _frame(df, [{"point": float(point), "lo": float(lo), "hi": float(hi), "se": float(d.std(ddof=1)) if len(d) > 1 else math.nan, "n_draws": len(d), **more}])


#: Cells of the table of weights (clusters times draws) that a cluster bootstrap broadcasts at most, two bytes each.
WEIGHT_CELLS = 100_000_000


def slope_bootstrap(df: DataFrame, cluster: str = "message_id", x: str = "realized_cer", draws: int = 500, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """Cluster bootstrap of a logit slope; few clusters are flagged unstable, draws whose fit fails are skipped.

    Only the clusters' names are collected (a number that the design fixes; more than :data:`WEIGHT_CELLS` weights raise).
    Their weights are drawn in sorted order and broadcast; (cluster, x) counts stay in Spark, and each Newton step sums the
    scores of all draws in one pass over them.
    """
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    t = df.groupBy(F.col(cluster).alias("g"), F.col(x).cast("double").alias("x")).agg(F.sum(w).alias("n"), F.sum(_drift() * w).alias("k")).persist()
    try:
        ids = np.array(sorted(r[0] for r in t.select("g").distinct().limit(WEIGHT_CELLS // max(1, draws) + 1).collect()))
        if len(ids) * draws > WEIGHT_CELLS:
            raise ValueError(f"{len(ids)} clusters are too many for {draws} draws")
        rng = np.random.default_rng(seed)
        weights = np.vstack([np.ones(len(ids)), *[_weights(rng, len(ids)) for _ in range(draws)]]).astype(np.int16)
        shared = df.sparkSession.sparkContext.broadcast((ids, weights))

        def sums(beta: np.ndarray) -> np.ndarray:
            def run(batches):  # noqa: ANN001, ANN202
                import pandas as pd

                names, w = shared.value
                total = np.zeros((len(w), 5))
                for pdf in batches:
                    for i in range(0, len(pdf), 2000):
                        part = pdf.iloc[i : i + 2000]
                        xs, n, k = (part[c].to_numpy(float) for c in ("x", "n", "k"))
                        v = w[:, np.searchsorted(names, part["g"].to_numpy())]
                        mu = 1 / (1 + np.exp(-np.clip(beta[:, :1] + beta[:, 1:] * xs, -35, 35)))
                        gap, info = v * (k - n * mu), v * n * mu * (1 - mu)
                        total += np.stack([gap.sum(1), gap @ xs, info.sum(1), info @ xs, info @ xs**2], axis=1)
                yield pd.DataFrame({"draw": np.arange(len(w)), **{f"s{j}": total[:, j] for j in range(5)}})

            rows = t.mapInPandas(run, "draw long, " + ", ".join(f"s{j} double" for j in range(5))).groupBy("draw").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(5)]).collect()
            out = np.zeros((len(weights), 5))
            for r in rows:
                out[r["draw"]] = r[1:]
            return out

        beta, live, good = np.zeros((draws + 1, 2)), np.ones(draws + 1, bool), np.zeros(draws + 1, bool)
        for _ in range(50):
            g0, g1, h0, h1, h2 = sums(beta).T
            det = h0 * h2 - h1 * h1
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.stack([h2 * g0 - h1 * g1, h0 * g1 - h1 * g0], axis=1) / det[:, None]
            live &= np.isfinite(step).all(1) & (det > 1e-12 * np.maximum(1.0, h0 * h2))
            beta[live] += step[live]
            live &= np.abs(beta).max(1) <= 1e3
            done = live & (np.abs(step).max(1) < 1e-10)
            good |= done
            live &= ~done
            if not live.any():
                break
        point = float(beta[0, 1]) if good[0] else math.nan
        return _interval(df, point, [float(b) for b in beta[1:, 1][good[1:]]], n_clusters=len(ids), unstable=len(ids) < 15)
    finally:
        t.unpersist()


def risk_difference_bootstrap(sums: DataFrame, by: tuple[str, ...] = (), draws: int = 1000, seed: int = 0) -> DataFrame:
    """Pair-clustered bootstrap of the risk difference from per-pair arm sums, by any keys."""
    terms = {c: F.col(c) for c in ("k_crit", "n_crit", "k_ctrl", "n_ctrl")}
    metric = rs.of_sums(terms, lambda s: s["k_crit"] / s["n_crit"] - s["k_ctrl"] / s["n_ctrl"])
    drawn = rs.bootstrap(sums, metric, by, "pair_id", draws, seed)
    n = sums.groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg(F.countDistinct("pair_id").alias("n_pairs"))
    found = drawn.groupBy(*by).agg(*rs.interval("value"))
    return found.join(n, list(by)) if by else found.crossJoin(F.broadcast(n))


def ece_auroc_bootstrap(df: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Message-clustered bootstrap of ECE and AUROC per model, both from the same draws."""
    rows = cal.calibration_frame(df)
    score, hit = F.col("confidence"), F.col("correct")
    drawn = rs.bootstrap(rows, rs.both(rs.calibration_error(score, hit), rs.auroc(score, hit)), ["model"], "message_id", draws, seed)
    t = drawn.groupBy("model").agg(*rs.interval("ece", "e_"), *rs.interval("auroc", "a_"))
    n = rows.groupBy("model").agg(F.countDistinct("message_id").alias("n_clusters"))
    names = {"ece": "e_point", "auroc": "a_point", "ece_lo": "e_lo", "ece_hi": "e_hi", "auroc_lo": "a_lo", "auroc_hi": "a_hi"}
    return t.join(n, "model").select("model", *[F.col(c).alias(k) for k, c in names.items()], "n_clusters")


def _prevalence(columns: list[str], target: int):  # noqa: ANN202
    """Draws' class counts and confusion cells to the target's corrected share."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            q, m = pdf[columns[:3]].to_numpy(), pdf[columns[3:]].to_numpy().reshape(-1, 3, 3)
            yield pd.DataFrame({"draw": pdf["draw"], "value": [float(ag.solve_prevalence(a, b)["corrected"][target]) for a, b in zip(q, m, strict=True)]})

    return run


def prevalence_bootstrap(cohort: DataFrame, validated: DataFrame, target: str = "drift", draws: int = 1000, seed: int = 0, method: str = "cluster") -> DataFrame:
    """Interval of a corrected class share: clusters of both frames resampled apart, or counts redrawn (parametric)."""
    k = CLASSES.index(target)
    counts = {f"q{i}": (F.col("auto_label") == c).cast("double") for i, c in enumerate(CLASSES)}
    cells = [(h, a) for h in CLASSES for a in CLASSES]
    pairs = {f"m{i}": ((F.col("human") == h) & (F.col("auto") == a)).cast("double") for i, (h, a) in enumerate(cells)}
    if method == "cluster":
        sums = []
        for i, (frame, terms) in enumerate(((cohort, counts), (validated, pairs))):
            filled = {n: F.coalesce(c, F.lit(0.0)) for n, c in terms.items()}
            metric = rs.Metric(tuple(terms), filled, lambda _, s: [v.sum(1) for v in s.values()])
            sums.append(rs.bootstrap(frame, metric, (), "message_id", draws, seed + i))
        drawn = sums[0].join(sums[1], "draw").mapInPandas(_prevalence([*counts, *pairs], k), "draw long, value double")
        return drawn.agg(*rs.interval("value")).withColumn("method", F.lit(method))
    q, m = (np.array(f.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in t.values()]).first(), dtype=float) for f, t in ((cohort, counts), (validated, pairs)))
    share = lambda a, b: float(ag.solve_prevalence(a, b.reshape(3, 3))["corrected"][k])
    rng = np.random.default_rng(seed)
    out = [share(rng.multinomial(int(q.sum()), q / q.sum()).astype(float), rng.multinomial(int(m.sum()), m / m.sum()).astype(float)) for _ in range(draws)]
    return _interval(cohort, share(q, m), out, method=method)


def slopes_bootstrap(slopes: DataFrame, column: str = "slope", draws: int = 2000, seed: int = 0) -> DataFrame:
    """Bootstrap of the mean over models' slopes: few clusters, flagged."""
    v = np.array([r[0] for r in slopes.where(F.col(column).isNotNull()).orderBy("model").select(column).collect()], dtype=float)
    rng = np.random.default_rng(seed)
    return _interval(slopes, v.mean(), [float(v[rng.integers(0, len(v), len(v))].mean()) for _ in range(draws)], n_clusters=len(v), unstable=len(v) < 15)


def rate_bootstrap(df: DataFrame, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Row bootstrap of a drift rate: rows of a rate are two counts, so draws are binomial."""
    n, k = df.agg(F.count(F.lit(1)), F.sum(_drift())).first()
    rng = np.random.default_rng(seed)
    return _interval(df, k / n, (rng.binomial(int(n), k / n, size=draws) / n).tolist())


def paired_rate_bootstrap(df: DataFrame, arm: str, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of two arms' drift rates with its two-sided bootstrap p."""
    c = {r[0]: (r[1], r[2]) for r in df.where(F.col(arm).isin(a, b)).groupBy(arm).agg(F.count(F.lit(1)), F.sum(_drift())).collect()}
    rng = np.random.default_rng(seed)
    d = sum(s * rng.binomial(int(c[x][0]), c[x][1] / c[x][0], size=draws) / c[x][0] for x, s in ((a, 1), (b, -1)))
    p = float(2 * min((d <= 0).mean(), (d >= 0).mean()))
    return _interval(df, c[a][1] / c[a][0] - c[b][1] / c[b][0], d.tolist(), p=min(1.0, p))


def resample(df: DataFrame, terms: dict[str, Column], statistic: Callable[[dict[str, np.ndarray]], np.ndarray], draws: int = 2000, seed: int = 0) -> DataFrame:
    """Row bootstrap of a statistic of sums: ``statistic`` gets each term's sum over the rows, one value a draw.

    Rows of equal terms are counted first and picked together, n of n in all. A row with a null term is left out. Any other
    metric, with score cells or of several groups or clusters, goes through :mod:`emberlane.operators.resampling` itself.
    """
    return rs.bootstrap(df, rs.of_sums(terms, statistic), draws=draws, seed=seed).agg(*rs.interval("value"))


def curve_bootstrap(df: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Per model: interval of the drift curve's slope, messages resampled."""

    def slope(levels: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray]:
        some = sums["n"] > 0
        y = np.where(some, 100 * sums["k"] / np.where(some, sums["n"], 1), 0)
        n = some.sum(1, keepdims=True)
        off = np.where(some, levels - (some * levels).sum(1, keepdims=True) / n, 0)
        return ((off * y).sum(1) / (off**2).sum(1) / 10,)

    metric = rs.Metric(("slope",), {"n": F.lit(1.0), "k": _drift()}, slope, F.round("cer_target", 1))
    t = rs.bootstrap(df, metric, ["model"], "message_id", draws, seed).groupBy("model").agg(*rs.interval("slope"))
    return t.select("model", F.col("point").alias("slope_pp"), "lo", "hi")


def power(n_messages: int, replicates: int, slope: float, base: float, sd: float, n_sim: int, seed: int, spark, alpha: float = 0.05) -> DataFrame:  # noqa: ANN001
    """Share of simulated random-intercept data sets whose clustered slope is positive with p under alpha; failures count against."""
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                g = np.repeat(np.arange(n_messages), 5 * replicates)
                x = np.tile(np.repeat(np.arange(5) / 10, replicates), n_messages)
                eta = base + slope * x + np.repeat(rng.normal(0, sd, n_messages), 5 * replicates)
                y = (rng.random(len(x)) < 1 / (1 + np.exp(-eta))).astype(float)
                b, se, ok = glm.fit_counts(x, y, np.ones_like(y), g)
                rows.append((int(i), b, se, bool(ok and se > 0 and b > 0 and math.erfc(abs(b / se) / math.sqrt(2)) < alpha)))
            yield pd.DataFrame(rows, columns=["sim", "slope", "se", "hit"])

    sims = spark.range(0, n_sim, 1, max(1, min(n_sim, spark.sparkContext.defaultParallelism * 4))).mapInPandas(run, "sim long, slope double, se double, hit boolean")
    return sims.agg(F.avg(F.col("hit").cast("double")).alias("power"), F.count(F.lit(1)).alias("n_sim"))
