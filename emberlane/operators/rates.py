"""Drift rates, label mixes, weighting, confidence and missingness tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.contracts import require_columns
from emberlane.functions.stats import rate, share, wilson
from emberlane.schema import CLASSES, CONFIDENCE_CUTOFF


def _drift() -> Column:
    return F.col("label") == "drift"


def level() -> Column:
    """Rates as group keys: one decimal, so 0.1 + 0.2 and 0.3 are one level."""
    return F.round("cer_target", 1)


def drift_rate(df: DataFrame, *by: str) -> DataFrame:
    """n, drift count and rate by any keys; ``cer_target`` is grouped by level."""
    require_columns(df, ["label", *by], "drift_rate")
    keys = [level().alias(c) if c == "cer_target" else F.col(c) for c in by]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(_drift()).alias("n_drift"), rate(_drift()).alias("drift_rate"))


def critical_level(df: DataFrame, tolerance: float = 0.01, corpus: str = "CRIT") -> DataFrame:
    """One row: the smallest level whose drift rate in ``corpus`` exceeds the tolerance; null if none does."""
    return drift_rate(df.where(F.col("corpus") == corpus), "cer_target").agg(F.min(F.when(F.col("drift_rate") > tolerance, F.col("cer_target"))).alias("critical_level"))


def label_mix(df: DataFrame) -> DataFrame:
    """Class shares overall, by corpus and by model, in one pass; a class that is absent has share 0."""
    shares = [rate(F.col("label") == c).alias(f"share_{c}") for c in CLASSES]
    sets = df.groupingSets([[], ["corpus"], ["model"]], "corpus", "model").agg(F.count(F.lit(1)).alias("n"), *shares, F.grouping("corpus").alias("gc"), F.grouping("model").alias("gm"))
    scope = F.when((F.col("gc") == 1) & (F.col("gm") == 1), "overall").when(F.col("gc") == 0, "corpus").otherwise("model")
    return sets.select(scope.alias("scope"), F.coalesce("corpus", "model", F.lit("all")).alias("value"), "n", *[f"share_{c}" for c in CLASSES])


def weighting_sensitivity(df: DataFrame) -> DataFrame:
    """By corpus: percent drift over rows, and the mean of the models' percentages."""
    per = df.groupBy("corpus", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(_drift()).alias("k"))
    return per.groupBy("corpus").agg(
        (100 * share(F.sum("k"), F.sum("n"))).alias("generation_weighted"), (100 * F.avg(share(F.col("k"), F.col("n")))).alias("model_weighted"), F.count(F.lit(1)).alias("n_models")
    )


def confidence_scale(df: DataFrame) -> DataFrame:
    """One row: 100 if the largest confidence exceeds 1, else 1 (also where there is none)."""
    return df.agg(F.when(F.max("confidence") > 1, 100.0).otherwise(1.0).alias("scale"))


def confidently_wrong(df: DataFrame, cutoff: float = CONFIDENCE_CUTOFF) -> DataFrame:
    """Pooled and per model, rows with a confidence only: how much drift is confident, how much confidence is wrong."""
    known = df.where(F.col("confidence").isNotNull()).crossJoin(F.broadcast(confidence_scale(df)))
    high, drift = F.col("confidence") >= cutoff * F.col("scale"), _drift()
    n = known.groupingSets([[], ["model"]], "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(drift).alias("n_drift"), F.count_if(drift & high).alias("n_drift_high"), F.count_if(high).alias("n_high"),
        F.count_if(high & (F.col("label") != "faithful")).alias("n_high_not_faithful"),
    )
    return n.select(
        F.coalesce("model", F.lit("pooled")).alias("model"), "n", "n_drift", "n_drift_high", "n_high", "n_high_not_faithful",
        share(F.col("n_drift_high"), F.col("n_drift")).alias("frac_drift_at_high_confidence"), share(F.col("n_high_not_faithful"), F.col("n_high")).alias("confidently_wrong_rate"),
    )


def missing_confidence_grid(df: DataFrame) -> DataFrame:
    """Missing confidences in every model x level cell, empty cells included."""
    keyed = df.withColumn("cer_target", level())
    counts = keyed.groupBy("model", "cer_target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence").isNull()).alias("n_missing"))
    grid = counts.select("model").distinct().crossJoin(F.broadcast(counts.select("cer_target").distinct()))
    return grid.join(counts, ["model", "cer_target"], "left").fillna(0, ["n", "n_missing"])


def missingness_enrichment(df: DataFrame) -> DataFrame:
    """Drift rate among rows without confidence over the base rate, pooled and per model; null where undefined."""
    miss = F.col("confidence").isNull()
    n = df.groupingSets([[], ["model"]], "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("n_missing"), F.count_if(_drift()).alias("k"), F.count_if(miss & _drift()).alias("km"))
    base, among = share(F.col("k"), F.col("n")), share(F.col("km"), F.col("n_missing"))
    return n.select(F.coalesce("model", F.lit("pooled")).alias("model"), "n", "n_missing", base.alias("baseline"), among.alias("drift_among_missing"), F.try_divide(among, base).alias("enrichment"))


def corpus_overlap(df: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Distinct ids per corpus, their intersections and subset flags, from one flag row per id; no set is built."""
    has = {c: F.max(F.when(F.col("corpus") == c, 1).otherwise(0)).alias(c) for c in ("AUTH", "CRIT", "CTRL")}
    flags = df.groupBy(id_col).agg(*has.values())
    a, r, t = (F.col(c) == 1 for c in has)
    return flags.agg(
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(a).alias("n_auth"), F.count_if(r).alias("n_crit"), F.count_if(t).alias("n_ctrl"), F.count_if(a & r).alias("auth_crit"),
        F.count_if(a & t).alias("auth_ctrl"), F.count_if(r & t).alias("crit_ctrl"), (F.count_if(t & ~a) == 0).alias("ctrl_in_auth"), (F.count_if(r & ~a) == 0).alias("crit_in_auth"),
    )


def interface_rates(df: DataFrame, *more: str) -> DataFrame:
    """By condition (overall and by corpus): declines over all rows, classes over the rows not declined; null on empty."""
    declined = F.coalesce(F.col("abstained"), F.lit(False))
    n = df.groupingSets([["condition", *more], ["condition", "corpus", *more]], "condition", "corpus", *more).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(declined).alias("n_declined"), *[F.count_if(~declined & (F.col("label") == c)).alias(f"n_{c}") for c in CLASSES]
    )
    rest = F.col("n") - F.col("n_declined")
    return n.select(
        "condition", *more, F.coalesce("corpus", F.lit("all")).alias("corpus"), "n", "n_declined", share(F.col("n_declined"), F.col("n")).alias("declined_rate"),
        *[share(F.col(f"n_{c}"), rest).alias(f"{c}_rate") for c in CLASSES],
    )


def throughput(df: DataFrame) -> DataFrame:
    """By condition and level: faithful over all rows, declines kept in the denominator."""
    declined = F.coalesce(F.col("abstained"), F.lit(False))
    return df.groupBy("condition", level().alias("cer_target")).agg(F.count(F.lit(1)).alias("n"), rate(~declined & (F.col("label") == "faithful")).alias("faithful_throughput"))


def candidate_recovery(df: DataFrame) -> DataFrame:
    """Rows of the candidate list: primary faithful, any candidate faithful (null counts as not), and the lift; overall and by level."""
    rows = df.where("condition = 'candidate_list'").withColumn("cer_target", level())
    first = F.col("label") == "faithful"
    n = rows.groupingSets([[], ["cer_target"]], "cer_target").agg(F.count(F.lit(1)).alias("n"), rate(first).alias("primary_rate"), rate(F.coalesce(first | F.col("any_candidate_faithful"), first)).alias("any_rate"))
    return n.select(F.coalesce(F.col("cer_target").cast("string"), F.lit("all")).alias("scope"), "n", "primary_rate", "any_rate", (F.col("any_rate") - F.col("primary_rate")).alias("lift"))


def wilson_by_cell(df: DataFrame) -> DataFrame:
    """Drift percent by corpus and level with its Wilson interval."""
    rows = drift_rate(df, "corpus", "cer_target")
    lo, hi = wilson(F.col("n_drift"), F.col("n"), percent=True)
    return rows.select("corpus", "cer_target", "n", (100 * F.col("drift_rate")).alias("percent"), lo.alias("lo"), hi.alias("hi"))


def curve_slopes(df: DataFrame) -> DataFrame:
    """Per model: least-squares slope of the drift curve, percentage points per 0.1 of the rate; null under two levels."""
    curve = drift_rate(df, "model", "cer_target")
    return curve.groupBy("model").agg((10 * F.regr_slope(100 * F.col("drift_rate"), 100 * F.col("cer_target"))).alias("slope_pp"), F.count(F.lit(1)).alias("n_levels"))


def slope_summary(slopes: DataFrame, column: str = "slope_pp") -> DataFrame:
    return slopes.agg(F.min(column).alias("min"), F.percentile(column, 0.5).alias("median"), F.max(column).alias("max"), F.count(column).alias("k"))


def realised_rates(df: DataFrame) -> DataFrame:
    """Realised against target rate: mean, sample deviation, n; four decimals."""
    return df.groupBy(level().alias("cer_target")).agg(F.round(F.avg("realized_cer"), 4).alias("mean"), F.round(F.stddev_samp("realized_cer"), 4).alias("sd"), F.count(F.lit(1)).alias("n"))


def rows_per_message(df: DataFrame, drop_corpus: str = "CTRL") -> DataFrame:
    """Without one corpus: how many messages have how many rows."""
    per = df.where(F.col("corpus") != drop_corpus).groupBy("message_id").agg(F.count(F.lit(1)).alias("rows"))
    return per.groupBy("rows").agg(F.count(F.lit(1)).alias("n_messages"))


def message_counts(df: DataFrame) -> DataFrame:
    """Grouped binomial per message: n, drift count, mean realised rate."""
    return df.groupBy("message_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_drift()).alias("k"), F.avg("realized_cer").alias("mean_rate"))


def panel_coverage(df: DataFrame, strata: tuple[str, ...] = ("model", "corpus", "cer_target", "label")) -> DataFrame:
    """Distinct values of each stratum column, and how many strata exist of all possible ones."""
    one = df.withColumn("cer_target", level()).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in strata], F.count_distinct(F.struct(*strata)).alias("nonempty"))
    possible = F.lit(1).cast("long")
    for c in strata:
        possible = possible * F.col(f"n_{c}")
    return one.withColumn("possible", possible)


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~F.col(a).eqNullSafe(F.col(b))).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
