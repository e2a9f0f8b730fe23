"""Structured Streaming over event files: extensions of the engine, and R01 as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema, files: int = 10) -> DataFrame:
    """Events of a folder of Parquet files as they come; ts as an instant, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; what comes later than `late` is left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def terminals(events: DataFrame) -> DataFrame:
    """By stream, records and ends so far; a stream is confirmed by one end (complete mode)."""
    own = events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("records"), F.count_if(F.col("event_type") == "purchase").alias("ends"))
    return own.withColumn("status", F.when(F.col("ends") == 1, "confirmed").when(F.col("ends") == 0, "unconfirmed").otherwise("invalid"))
