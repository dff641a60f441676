"""What a model makes of the raw decode: transitions, net metric, rankings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlane.functions.stats import share
from emberlane.schema import ATTEMPT_KEY

#: Named cells of (raw label, output label): fixed values.
NAMED = {
    ("faithful", "faithful"): "no_benefit", ("degraded", "faithful"): "rescue", ("degraded", "drift"): "silent_failure", ("faithful", "drift"): "llm_induced_harm", ("degraded", "degraded"): "no_correction",
}
NET = "faithful_gained_per_drift_introduced"


def transition(raw: Column, out: Column) -> Column:
    """Name of a cell; other pairs are named by their ends."""
    name = F.concat(F.lit("other__"), raw, F.lit("_to_"), out)
    for (a, b), known in NAMED.items():
        name = F.when((raw == a) & (out == b), known).otherwise(name)
    return name


def net_metric(rescues: Column, harm: Column, silent: Column) -> Column:
    """Rescues per bad change: infinite with rescues alone, null where nothing happened."""
    bad = harm + silent
    return F.when(bad > 0, F.try_divide(rescues.cast("double"), bad.cast("double"))).when(rescues > 0, float("inf"))


def joined(attempts: DataFrame, raw: DataFrame, key: tuple[str, ...] = ATTEMPT_KEY) -> DataFrame:
    """Attempts with the raw label of their exposure; a key that repeats on the raw side counts once, rows without one go."""
    one = raw.groupBy(*key).agg(F.min("raw_label").alias("raw_label"))
    return attempts.join(one, list(key), "left")


def transition_counts(attempts: DataFrame, raw: DataFrame, *by: str) -> DataFrame:
    """Long table: rows, and share of the group, of each transition by any keys."""
    rows = joined(attempts, raw).where("raw_label is not null").withColumn("cer_target", F.round("cer_target", 1))
    n = rows.groupBy(*by, transition(F.col("raw_label"), F.col("label")).alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", share(F.col("n"), F.sum("n").over(W.partitionBy(*by))))


def net_by(attempts: DataFrame, raw: DataFrame, *by: str) -> DataFrame:
    """Matched and unmatched rows, the named cells and the net metric by any keys."""
    rows = joined(attempts, raw).withColumn("cer_target", F.round("cer_target", 1)).withColumn("t", transition(F.col("raw_label"), F.col("label")))
    n = rows.groupBy(*by).agg(
        F.count("raw_label").alias("n_matched"), F.count_if(F.col("raw_label").isNull()).alias("n_unmatched"), *[F.count_if(F.col("t") == c).alias(c) for c in NAMED.values()]
    )
    return n.withColumn(NET, net_metric(F.col("rescue"), F.col("llm_induced_harm"), F.col("silent_failure")))


def net_ranking(attempts: DataFrame, raw: DataFrame, by: str = "condition") -> DataFrame:
    """Conditions by net metric, best first, undefined last; declined rows stay out and are counted."""
    declined = F.coalesce(F.col("abstained"), F.lit(False))
    gone = attempts.groupBy(by).agg(F.count_if(declined).alias("n_declined"))
    rows = net_by(attempts.where(~declined), raw, by).join(F.broadcast(gone), by)
    order = [F.desc_nulls_last(F.when(~F.isnan(NET), F.col(NET))), F.col(by)]
    return rows.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"), by, "n_matched", "n_declined", "rescue", "llm_induced_harm", "silent_failure", NET)


def benefit_harm_by_condition(attempts: DataFrame, raw: DataFrame) -> DataFrame:
    """Net table by condition x corpus x level and by condition alone, declined rows out."""
    rows = attempts.where(~F.coalesce(F.col("abstained"), F.lit(False)))
    fine = net_by(rows, raw, "condition", "corpus", "cer_target")
    pooled = net_by(rows, raw, "condition").withColumn("corpus", F.lit("all")).withColumn("cer_target", F.lit(None).cast("double"))
    return fine.unionByName(pooled)
