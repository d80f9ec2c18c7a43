"""Totals by event time. The same expressions run on tables and on streams; late events count up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """events with a watermark on a stream; its column becomes a timestamp with a zone, as watermarks ask for."""
    rows = events.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, late) if events.isStreaming else rows


def daily_totals(events: DataFrame, keys: list[str], value: str, column: str = "ts") -> DataFrame:
    """day, keys, n and total by day."""
    day = F.window(column, "1 day")
    sums = timed(events, column).groupBy(day, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.to_date("window.start").alias("day"), *keys, "n", "total")


def sliding_counts(events: DataFrame, keys: list[str], length: str, every: str, column: str = "ts") -> DataFrame:
    counts = timed(events, column).groupBy(F.window(column, length, every), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("from"), F.col("window.end").alias("until"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str, column: str = "ts") -> DataFrame:
    """Runs of events of a key with less than the gap between them."""
    counts = timed(events, column).groupBy(F.session_window(column, gap), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("from"), F.col("session_window.end").alias("until"), *keys, "n")


def first_seen(events: DataFrame, keys: list[str], column: str = "ts") -> DataFrame:
    """Each key once: on a stream within the watermark, on a table at all."""
    rows = timed(events, column)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)
