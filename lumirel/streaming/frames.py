"""Windows, late frames and sessions over a stream of frames (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frames(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, sums and extremes by window and type; frames later than the watermark are left out of a stream."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    by = seen.groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.col("window.start").alias("start"), "event_type", "n", "low", "high")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's frames with less than a gap between neighbours."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    by = seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("session_window.start").alias("start"), "n")


def running_mean(events: DataFrame) -> DataFrame:
    """Mean value and count by type so far, for update mode."""
    return events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
