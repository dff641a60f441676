"""Calibration: binned error, reliability, rank AUROC, pooling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.contracts import ContractError
from emberlane.functions.stats import share
from emberlane.operators import ordered as od
from emberlane.schema import CONFIDENCE_CUTOFF, Z_ROUNDED

BINS = 10


def calibration_frame(df: DataFrame) -> DataFrame:
    """Rows with a confidence, on [0, 1] (always a hundredth), and whether the label is faithful."""
    return df.where(F.col("confidence").isNotNull()).select("model", "message_id", (F.col("confidence") / 100).alias("confidence"), (F.col("label") == "faithful").alias("correct"))


def left_closed(score: Column, bins: int = BINS) -> Column:
    """Bin 0 to bins - 1, [lo, hi) with the last closed, against the edges k / bins themselves."""
    out = F.lit(0)
    for k in range(1, bins):
        out = F.when(score >= k / bins, k).otherwise(out)
    return out


def right_closed(score: Column, bins: int = BINS) -> Column:
    """Bin 0 to bins - 1, (lo, hi] with the lowest edge included."""
    out = F.lit(bins - 1)
    for k in range(bins - 1, 0, -1):
        out = F.when(score <= k / bins, k - 1).otherwise(out)
    return out


def reliability(df: DataFrame, score: str, hit: str, *by: str, closed: str = "left") -> DataFrame:
    """Bins that hold rows: mean score, share of hits, n."""
    at = (left_closed if closed == "left" else right_closed)(F.col(score))
    return df.groupBy(*by, at.cast("long").alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(hit).cast("double")).alias("share_hit"), F.count(F.lit(1)).alias("n"))


def binned_error(df: DataFrame, score: str, hit: str, *by: str) -> DataFrame:
    """Expected calibration error over equal-width bins by any keys."""
    bins = reliability(df, score, hit, *by)
    gap = F.abs(F.col("share_hit") - F.col("mean_score"))
    return bins.groupBy(*by).agg(share(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def checked_scores(df: DataFrame, score: str) -> DataFrame:
    """``df`` as it is; null, NaN or a score outside 0 to 1 raises."""
    s = F.col(score)
    if df.where(s.isNull() | F.isnan(s) | (s < 0) | (s > 1)).limit(1).count():
        raise ContractError(f"{score} has nulls, NaN or values outside 0 to 1")
    return df


def expected_error(df: DataFrame, score: str, hit: str, equal_frequency: bool = False) -> DataFrame:
    """Second-layout calibration error: scores are checked, no rows give 0."""
    checked_scores(df, score)
    t = equal_frequency_error(df, score, hit) if equal_frequency else binned_error(df, score, hit)
    return t.agg(F.coalesce(F.max("ece"), F.lit(0.0)).alias("ece"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def equal_frequency_error(df: DataFrame, score: str, hit: str, bins: int = BINS) -> DataFrame:
    """The same over bins cut at exact quantiles, ends at 0 and 1, repeated edges dropped."""
    inner = [c for c in od.quantiles(df, F.col(score), [k / bins for k in range(1, bins)]) if c is not None]
    edges = sorted({0.0, *inner, 1.0})[1:-1]
    at = sum(((F.col(score) >= e).cast("int") for e in edges), F.lit(0))
    g = df.groupBy(at.alias("bin")).agg(F.avg(score).alias("c"), F.avg(F.col(hit).cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    return g.agg(share(F.sum(F.col("n") * F.abs(F.col("y") - F.col("c"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def auroc(df: DataFrame, score: str, positive: str, *by: str, ranges: int | None = None) -> DataFrame:
    """Rank AUROC with ties at one half, null with one class. Rows collapse to one per distinct score, which a scan by ranges ranks."""
    p = F.col(positive).cast("boolean")
    t = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(p).alias("pos"), F.count_if(~p).alias("neg"))
    t = od.scan(t, ["_s"], {"_below": od.Running("sum", "neg", before=True)}, by, ranges)
    u = F.col("pos") * (F.col("_below") + F.col("neg") / 2)
    return t.withColumn("u", u).groupBy(*by).agg(share(F.sum("u"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def drift_calibration(df: DataFrame, *by: str) -> DataFrame:
    """Drift-specific calibration per group: AUROC and ECE of 1 - confidence, review rule at the cutoff; null where undefined."""
    scale = df.agg(F.when(F.max("confidence") > 1, 100.0).otherwise(1.0).alias("scale"))
    rows = df.crossJoin(F.broadcast(scale)).withColumns({"score": 1 - F.col("confidence") / F.col("scale"), "is_drift": F.col("label") == "drift"})
    some = rows.where("confidence is not null")
    flag = F.col("confidence") < CONFIDENCE_CUTOFF * F.col("scale")
    d = F.col("is_drift")
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(d).alias("n_drift_all"), F.count_if(d & F.col("confidence").isNotNull()).alias("n_drift_scored"), F.count("confidence").alias("n_scored"), F.count_if(F.col("confidence").isNull()).alias("n_missing_conf"), F.count_if(d & flag).alias("tp"), F.count_if(~d & ~flag).alias("tn"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    rank = auroc(some, "score", "is_drift", *by).select(*by, "auroc", "n_neg")
    err = binned_error(some, "score", "is_drift", *by).select(*by, F.col("ece").alias("ece_drift"))
    t = n.join(rank, list(by), "left").join(err, list(by), "left")
    sens = share(F.col("tp"), F.col("n_drift_scored"))
    flat = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    area = F.when(~flat, F.col("auroc"))
    return t.select(*by, "n", "n_drift_all", "n_drift_scored", "n_scored", "n_missing_conf", area.alias("drift_auroc"), "ece_drift", (1 - sens).alias("fnr"), sens.alias("sens"), share(F.col("tn"), F.col("n_neg")).alias("spec"), area.isNull().alias("degenerate"))


def random_effects(df: DataFrame, value: str, lo: str, hi: str) -> DataFrame:
    """DerSimonian-Laird pool of k estimates; standard errors from interval widths, variances floored; one row.

    One estimate passes through, none gives nulls.
    """
    v = F.greatest(F.pow((F.col(hi) - F.col(lo)) / (2 * Z_ROUNDED), F.lit(2.0)), F.lit(1e-12))
    t = df.where(F.col(value).isNotNull()).select(F.col(value).alias("y"), v.alias("v")).withColumn("w", 1 / F.col("v"))
    a = t.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("y")).alias("swy"))
    q = t.crossJoin(F.broadcast(a)).groupBy("k", "sw", "sw2").agg(F.sum(F.col("w") * F.pow(F.col("y") - F.col("swy") / F.col("sw"), F.lit(2.0))).alias("q"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    q = q.withColumn("tau2", F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), c), F.lit(0.0)))).otherwise(0.0))
    r = t.crossJoin(F.broadcast(q)).withColumn("ws", 1 / (F.col("v") + F.col("tau2"))).groupBy("k", "q", "tau2").agg((F.sum(F.col("ws") * F.col("y")) / F.sum("ws")).alias("pooled"), (1 / F.sqrt(F.sum("ws"))).alias("se"))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q")) * 100).otherwise(0.0)
    return r.select("k", "pooled", "se", (F.col("pooled") - Z_ROUNDED * F.col("se")).alias("lo"), (F.col("pooled") + Z_ROUNDED * F.col("se")).alias("hi"), "tau2", "q", i2.alias("i2"))
