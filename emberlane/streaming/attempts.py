"""Streaming counterparts (an addition: the batch operators as they apply to arriving attempts)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.schema import ATTEMPTS


def attempts_stream(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.readStream.schema(schema or ATTEMPTS).json(path)


def unique_attempts(stream: DataFrame, time: str, key: tuple[str, ...], delay: str = "1 hour") -> DataFrame:
    """Each attempt once, with state bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def running_rates(stream: DataFrame) -> DataFrame:
    """Drift rate by corpus and level, for complete output: state is one row per cell."""
    return stream.groupBy("corpus", F.round("cer_target", 1).alias("cer_target")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == "drift").cast("double")).alias("drift_rate"))


def windowed_rates(stream: DataFrame, time: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Event counts per tumbling window and type, late rows within the delay included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
