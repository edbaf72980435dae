"""Event-time windows over particle streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream of Parquet events; ``ts`` becomes the event time."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_mass(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mass and count per window and type; rows later than the watermark are dropped."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.sum("value").alias("mass"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", F.round("mass", 4).alias("mass"), "n")


def sliding_mass(events: DataFrame, length: str = "6 hours", slide: str = "3 hours", late: str = "6 hours") -> DataFrame:
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", length, slide).alias("w")).agg(F.sum("value").alias("mass"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.round("mass", 4).alias("mass"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Tracks end after ``gap`` without a row: one row per user and session."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("mass"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", F.round("mass", 4).alias("mass"))
