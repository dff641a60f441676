"""Zero-error drift: causes, unresolved rows, scope."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlane.operators import label as lb


def zero_error_drift(df: DataFrame, cause) -> DataFrame:  # noqa: ANN001
    """Rows with no realised error that drifted, with their cause."""
    return df.where((F.col("realized_cer") == 0) & (F.col("label") == "drift")).withColumn("cause", cause)


def cause_counts(rows: DataFrame) -> DataFrame:
    """Counts overall, by model and by corpus in one pass; the residual is named after what is left."""
    named = rows.withColumn("cause", F.when(F.col("cause") == "other", "unresolved_or_mixed").otherwise(F.col("cause")))
    n = named.groupingSets([["cause"], ["cause", "model"], ["cause", "corpus"]], "cause", "model", "corpus").agg(F.count(F.lit(1)).alias("n"), F.grouping("model").alias("gm"), F.grouping("corpus").alias("gc"))
    scope = F.when(F.col("gm") == 0, "model").when(F.col("gc") == 0, "corpus").otherwise("overall")
    return n.select(scope.alias("scope"), F.coalesce("model", "corpus", F.lit("all")).alias("value"), "cause", "n")


def cause_examples(rows: DataFrame, order: tuple[str, ...], limit: int = 10) -> DataFrame:
    """Up to ``limit`` message ids per cause in row order."""
    at = F.row_number().over(W.partitionBy("cause").orderBy(*order))
    first = rows.withColumn("place", at.cast("long")).where(F.col("place") <= limit)
    return first.select("cause", "place", "message_id")


def unresolved(rows: DataFrame) -> DataFrame:
    """The residual's exclusive split with overlay flags."""
    rest = rows.where("cause = 'other'").withColumn("reason", lb.unresolved_reason())
    flags = [F.count_if(lb.borderline()).alias("n_borderline"), F.count_if(lb.low_cosine()).alias("n_low_cosine"), F.count_if(lb.bidirectional("deberta")).alias("n_deberta_entails")]
    return rest.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), *flags)


def scope_split(rows: DataFrame) -> DataFrame:
    zero = F.col("cer_target") == 0
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("n_target_zero"), F.try_divide(F.count_if(zero).cast("double"), F.count(F.lit(1)).cast("double")).alias("share_target_zero"))
