"""Streaming form of the similar-line collapse: counts per normalized line in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def collapse_stream(lines: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``lines`` (ts, text), a stream or a table, to (window, line, n_similar) with a watermark for late rows."""
    keyed = lines.withWatermark("ts", delay).groupBy(F.window("ts", window), T.normalized_line(F.col("text")).alias("line"))
    return keyed.agg(F.count(F.lit(1)).alias("n_similar"))
