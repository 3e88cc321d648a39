"""Windows over event time; the same function serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, time: str, late: str | None) -> DataFrame:
    # Watermarks need timestamps with a zone; those without one are read in the session's.
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """(start, keys, n): rows of each window; on a stream, ``late`` is how long a window waits."""
    events = _late(events, time, late)
    counts = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, time: str, width: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    """(start, keys, n): rows of each window; windows begin every ``step`` and overlap where they are wider."""
    events = _late(events, time, late)
    counts = events.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """(start, end, keys, n): rows of each session, which ends when nothing comes for ``gap``."""
    events = _late(events, time, late)
    counts = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
