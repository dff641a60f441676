"""Matched comparison of critical and control messages: adjusted odds, excess by model and category, risk differences."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.contracts import assert_no_nulls, require_columns
from emberlane.functions.stats import share
from emberlane.operators import balance, glm
from emberlane.operators.inference import _frame, risk_difference_bootstrap
from emberlane.schema import Z_EXACT
from emberlane.scratch import Scratch

#: Prescribed adjusters of the matched fit, in order (fixed values).
ADJUSTERS = ("char_len", "n_errors", "corrupted_negation", "corrupted_numeral", "realized_cer")
#: A refit on the earlier panel reproduces the earlier odds ratio if it is nearer than this (fixed value).
ANCHOR_WITHIN = 0.05


def _columns(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}


def adjusted_effect(matched: DataFrame, stratum: Sequence[str], adjusters: Sequence[str] = ADJUSTERS, by: str | None = None, outcome: str = "drift") -> DataFrame:
    """Conditional logit of ``outcome`` on ``critical`` and the adjusters within strata, on all rows: one row per term (and value of ``by``).

    n_obs and n_pairs are what was fitted, concordant strata left out. Missing columns or values raise. A fit that does not
    settle, or whose errors are not finite, counts as not converged.
    """
    needed = ["critical", outcome, *adjusters, *stratum]
    assert_no_nulls(require_columns(matched, needed, "matched effect"), ["critical", outcome, *adjusters], "matched effect")
    fits = glm.conditional_by(matched, F.col(by) if by else F.lit("all"), list(stratum), F.col(outcome).cast("double"), _columns(["critical", *adjusters]))
    rows = []
    for k in sorted(fits, key=str):
        table = fits[k].table()
        ok = fits[k].converged and all(math.isfinite(r["se"]) and r["se"] > 0 for r in table)
        rows += [({by: k} if by else {}) | r | {"n_obs": int(fits[k].n), "n_pairs": fits[k].clusters["strata"], "converged": ok} for r in table]
    return _frame(matched, rows)


def excess(matched: DataFrame, stratum: Sequence[str], outcomes: Sequence[str], by: str | None = None) -> DataFrame:
    """Odds ratio of drift for critical against control messages, per outcome (and value of ``by``), on (stratum, arm) counts of all rows.

    One pass makes the counts of all outcomes; strata with the same counts are one cell (their number is the design's, not
    the corpus's), and each (by, outcome) is fitted in a task of its own. A group without a discordant stratum has no row; where
    every stratum leans one way as far as it can no estimate is finite: null, not converged.
    """
    arm, kind = F.col("critical").cast("int"), F.col(by).cast("string") if by else F.lit("all")
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("y")) for o in outcomes])).alias("o")
    rows = matched.select(kind.alias("k"), *stratum, arm.alias("arm"), each).select("k", *stratum, "arm", "o.*")
    counts = rows.groupBy("k", "outcome", *stratum).agg(*[f.alias(f"{n}{a}") for a in (1, 0) for n, f in (("n", F.count_if((F.col("arm") == a) & F.col("y").isNotNull())), ("k", F.count_if((F.col("arm") == a) & (F.col("y") == 1))))])
    t = counts.withColumn("m", F.col("k1") + F.col("k0")).where("n1 > 0 and n0 > 0 and m > 0 and m < n1 + n0")
    cells = t.groupBy("k", "outcome", "n1", "n0", "m").agg(F.sum("k1").alias("k1"), F.count(F.lit(1)).alias("c"))

    def fit(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int((pdf["n1"] + pdf["n0"]).max()) + 1)))))
        ways = [(np.arange(max(0, m - n0), min(n1, m) + 1), n1, n0, m, k1, c) for n1, n0, m, k1, c in pdf[["n1", "n0", "m", "k1", "c"]].itertuples(index=False)]
        w = [-logs[k] - logs[n1 - k] - logs[m - k] - logs[n0 - m + k] for k, n1, n0, m, _, _ in ways]

        def sums(b: float) -> tuple[float, float]:
            g = h = 0.0
            for (k, _, _, _, k1, c), v in zip(ways, w, strict=True):
                e = np.exp(v + k * b - (v + k * b).max())
                mean = float(k @ e / e.sum())
                g, h = g + k1 - c * mean, h + c * float((k - mean) ** 2 @ e / e.sum())
            return g, h

        edges = [sum(c * k[i] for k, *_, c in ways) for i in (0, -1)]
        apart = sum(k1 for *_, k1, _ in ways) in edges  # every stratum leans one way as far as it can: no finite estimate
        b, ok = 0.0, False
        for _ in range(0 if apart else 60):
            g, h = sums(b)
            if h <= 0 or abs(b) > 50:
                break
            step = max(-2.0, min(2.0, g / h))
            b += step
            if abs(step) < 1e-11:
                ok = True
                break
        h = sums(b)[1]
        se = 1 / math.sqrt(h) if h > 0 else math.nan
        good = ok and math.isfinite(se)
        ends = [math.exp(b + s * Z_EXACT * se) if good else None for s in (0, -1, 1)]
        return pd.DataFrame([[pdf["k"].iloc[0], pdf["outcome"].iloc[0], *ends, int(pdf["c"].sum()), int((pdf["c"] * (pdf["n1"] + pdf["n0"])).sum()), good]], columns=["k", "outcome", "odds_ratio", "lo", "hi", "n_pairs", "n_obs", "converged"])

    out = cells.groupBy("k", "outcome").applyInPandas(fit, "k string, outcome string, odds_ratio double, lo double, hi double, n_pairs long, n_obs long, converged boolean")
    return out.withColumnRenamed("k", by) if by else out.drop("k")


def excess_points(matched: DataFrame, outcome: str, by: str | None = None) -> DataFrame:
    """Risk difference in percentage points with its arms (and per value of ``by``), and how many critical messages stand behind it."""
    crit, y = F.col("critical") == 1, F.col(outcome).cast("int") == 1
    t = matched.groupBy(*([by] if by else [])).agg(
        F.count_if(crit).alias("n_crit"), F.count_if(~crit).alias("n_ctrl"), F.count_if(crit & y).alias("k1"), F.count_if(~crit & y).alias("k0"), F.count_distinct(F.when(crit, F.col("message_id"))).alias("n_crit_items")
    )
    a, b = share(F.col("k1"), F.col("n_crit")), share(F.col("k0"), F.col("n_ctrl"))
    return t.select(*([by] if by else []), "n_crit", "n_ctrl", "n_crit_items", a.alias("p_crit"), b.alias("p_ctrl"), (100 * (a - b)).alias("rd_pp"))


def anchor(matched: DataFrame, stratum: Sequence[str], outcome: str, models: Sequence[str], prior: float) -> DataFrame:
    """The pooled odds ratio on a fixed list of models against an earlier result: one row, with whether it reproduces."""
    t = excess(matched.where(F.col("model").isin(*models)), stratum, [outcome])
    return t.select("odds_ratio", "lo", "hi", "n_pairs", "n_obs", F.lit(float(prior)).alias("prior"), F.coalesce(F.abs(F.col("odds_ratio") - prior) < ANCHOR_WITHIN, F.lit(False)).alias("reproduces"))


def risk_difference_by_rate(matched: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """The risk difference within each target rate, ascending, with a pair-clustered bootstrap of seed + i for the i-th rate.

    The arms' sums by pair and rate are stored, so the attempts are read once for all rates.
    """
    sums = Scratch(matched.sparkSession).keep(balance.arm_sums(matched.withColumn("cer_target", F.round("cer_target", 1)), "cer_target"))
    rates = sorted(r[0] for r in sums.select("cer_target").distinct().collect())  # the levels of the design
    parts = [
        risk_difference_bootstrap(sums.where(F.col("cer_target") == c), (), draws, seed + i).select(
            F.lit(float(c)).alias("cer_target"), "*", (1000 * F.col("point")).alias("per_thousand"), F.lit(seed + i).alias("seed")
        )
        for i, c in enumerate(rates)
    ]
    return reduce(DataFrame.unionByName, parts)
