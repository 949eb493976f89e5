"""Event-time aggregations; each works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Count and sum by window and key; rows later than ``late`` are dropped in a stream."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), key, "n")


def first_of_content(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """One row a key; in a stream the memory of keys ends with the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
