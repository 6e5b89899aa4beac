"""Structured Streaming forms: rates, sessions, ledgers, ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and sums of each key in tumbling windows; works on streams and tables."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.groupBy(F.window(at, width).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("_w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.groupBy(F.session_window(at, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def over_limit(events: DataFrame, at: str, key: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Windows in which a key exceeds a rate limit."""
    return rates(events, at, key, width).filter(F.col("n") > limit)


def once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each signature once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def ingest(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run ``store`` (an idempotent upsert) on every micro-batch."""
    w = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
