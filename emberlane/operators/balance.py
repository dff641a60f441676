"""Covariate balance and matched-pair tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.stats import share, smd
from emberlane.operators import ordered as od


def balance_table(df: DataFrame, arm: str, covariates: list[str]) -> DataFrame:
    """Standardised mean difference of each covariate between arm true and arm false, in one scan."""
    x = [F.col(c).cast("double") for c in covariates]
    on = lambda v, t: F.when(F.col(arm) == t, v)
    aggs = []
    for c, v in zip(covariates, x, strict=True):
        for t, tag in ((True, "a"), (False, "b")):
            aggs += [F.avg(on(v, t)).alias(f"{c}__m{tag}"), F.var_pop(on(v, t)).alias(f"{c}__v{tag}")]
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("covariate"), *[F.col(f"{c}__{k}").alias(k) for k in ("ma", "mb", "va", "vb")]) for c in covariates])
    t = one.select(F.explode(each).alias("_c")).select("_c.*")
    return t.select("covariate", F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), smd(F.col("ma"), F.col("mb"), F.col("va"), F.col("vb")).alias("smd"))


def pair_mapping(pairs: DataFrame) -> DataFrame:
    """Each pair as two rows: (pair_id, message_id, critical)."""
    return pairs.select(F.col("crit_message_id").alias("pair_id"), F.expr("stack(2, crit_message_id, 1, message_id, 0) as (message_id, critical)"))


def matched_rows(attempts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attempts of paired messages with their pair and arm; Spark broadcasts the pairs if they turn out small."""
    return attempts.join(pair_mapping(pairs), "message_id")


def arm_sums(matched: DataFrame, *by: str) -> DataFrame:
    """Per pair (and key): drift and n in each arm."""
    crit, drift = F.col("critical") == 1, F.col("label") == "drift"
    return matched.groupBy("pair_id", *by).agg(F.count_if(crit).alias("n_crit"), F.count_if(crit & drift).alias("k_crit"), F.count_if(~crit).alias("n_ctrl"), F.count_if(~crit & drift).alias("k_ctrl"))


def risk_difference(sums: DataFrame, *by: str) -> DataFrame:
    """Drift risk of the critical arm less the control arm, and per thousand."""
    t = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_crit", "k_crit", "n_ctrl", "k_ctrl")])
    rd = share(F.col("k_crit"), F.col("n_crit")) - share(F.col("k_ctrl"), F.col("n_ctrl"))
    return t.select(*by, "n_crit", "n_ctrl", rd.alias("rd"), (1000 * rd).alias("per_thousand"))


def distance_summary(df: DataFrame, column: str) -> DataFrame:
    (median,) = od.quantiles(df, F.col(column), [0.5])
    return df.agg(F.min(column).alias("min"), F.lit(median).cast("double").alias("median"), F.avg(column).alias("mean"), F.max(column).alias("max"))


def pair_candidates(attempts: DataFrame, pairs: DataFrame, order: Sequence[str] = ("replicate_idx", "model", "label")) -> DataFrame:
    """Pair x rate cells with a row of each arm: the critical half joined to the control half, the first row of each by ``order``, by pivoted aggregation."""
    rows = matched_rows(attempts, pairs).withColumn("cer_target", F.round("cer_target", 1))
    key = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], "label")
    first = lambda a: F.min(F.when(F.col("critical") == a, key))
    t = rows.groupBy("pair_id", "cer_target").agg(first(1).alias("c"), first(0).alias("o")).where("c is not null and o is not null")
    return t.select("pair_id", "cer_target", F.col("c.label").alias("crit_label"), F.col("o.label").alias("ctrl_label"))


def reference_arm(attempts: DataFrame, auth: DataFrame, probes: DataFrame, max_replicate: int = 10) -> DataFrame:
    """Forced-condition arm: rows whose (message_id, corpus) pair is wanted, never the id alone, with few replicates."""
    key = ["message_id", "corpus"]
    rows = attempts.where(F.col("replicate_idx") < max_replicate)
    out = rows.join(auth.select(*key), key, "left_semi").unionByName(rows.join(probes.select(*key), key, "left_semi"), allowMissingColumns=True)
    return out.withColumn("condition", F.lit("forced"))


def resume(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return todo.join(done.select(*key), key, "left_anti")
