"""Windowed volumes of a stream, with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _volumes(stream: DataFrame, time: str, topic: str, record: str, window: Column, late: str) -> DataFrame:
    marked = stream.withWatermark(time, late)
    return marked.groupBy(window.alias("window"), topic).agg(F.approx_count_distinct(record).alias("records"), F.count("*").alias("rows"))


def windowed_volumes(stream: DataFrame, time: str, topic: str, record: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """window, topic, records (distinct, about), rows of tumbling windows, or of hopping ones
    with slide. Rows later than the watermark are dropped; state is bounded by it."""
    return _volumes(stream, time, topic, record, F.window(time, window, slide) if slide else F.window(time, window), late)


def session_volumes(stream: DataFrame, time: str, topic: str, record: str, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """The same for sessions: a topic's rows with no gap that long between them."""
    return _volumes(stream, time, topic, record, F.session_window(time, gap), late)
