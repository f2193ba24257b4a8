"""Structured Streaming forms of the event operators; the reference has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: list[str], late: str, length: str, slide: str | None = None) -> DataFrame:
    """Rows per key and event-time window; rows later than ``late`` are dropped by the watermark."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = stream.withWatermark(time, late).groupBy(*key, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(stream: DataFrame, time: str, key: list[str], late: str, gap: str) -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    grouped = stream.withWatermark(time, late).groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def valid_rows(stream: DataFrame, error: Column) -> DataFrame:
    """Rows without an error; stateless, so it runs in any output mode."""
    return stream.where(error.isNull())
