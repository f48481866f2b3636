"""Rides as streams: sessions end after a gap without points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ride_sessions(points: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions per ride of a stream (or table) with ride_id and a timestamp column ``time``: start, end and number of points."""
    marked = points.withWatermark("time", late) if points.isStreaming else points
    out = marked.groupBy("ride_id", F.session_window("time", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("ride_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
