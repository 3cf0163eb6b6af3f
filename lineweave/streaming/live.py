"""Streaming counterparts (survey 2.12): votes as they arrive, sessions and token counts; see incremental and stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def votes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only vote files as a stream."""
    return spark.readStream.schema(schema).option("header", True).csv(path)


def earliest_votes(stream: DataFrame, keys: list[str], time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """The first vote of each key within the watermark; later repeats are dropped without unbounded state."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_segments(stream: DataFrame, key: str, time: str, silence: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Gap-based segments of a note stream: sessions by key that end after `silence`."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(key, F.session_window(time, silence).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_notes")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_notes")
    )


def token_counts(stream: DataFrame, time: str, token: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens counted by tumbling windows of event time."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), token).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), token, "n")
