"""Windowed counts over event streams; the same plan runs on a batch table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, group: list[str], *aggregates: Column, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates a window of event time and group; ``late`` is the watermark on a stream, ``slide`` makes windows overlap."""
    rows = events.withWatermark(at, late) if late and events.isStreaming else events
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.groupBy(window.alias("w"), *group).agg(*aggregates).withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def sessions(events: DataFrame, at: str, gap: str, group: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """Aggregates a session: events of a group with less than ``gap`` between them."""
    rows = events.withWatermark(at, late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), *group).agg(*aggregates).withColumn("session_start", F.col("w.start")).withColumn("session_end", F.col("w.end")).drop("w")
