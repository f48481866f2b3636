"""State over streams of points: running distance and gaps of rides, and running means of a segment library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from rideframe.functions import geo
from rideframe.operators.matching import haversine_np

POINTS = "ride_id long, point_id long, time timestamp, lat double, lon double"
_TRACKED = "ride_id long, point_id long, us long, lat double, lon double, part long, step_mm long, cum_mm long"
#: Last point, parts and distance so far, and the points that wait for the watermark.
_STATE = "lat double, lon double, at long, part long, cum_mm long, ids array<long>, times array<long>, lats array<double>, lons array<double>"


def _advance(lat, lon, at, part, cum, us: np.ndarray, lats: np.ndarray, lons: np.ndarray, gap_us: int):
    """Parts and steps of points in order of time after a last one (at None: none); and what the next ones begin with."""
    new = us - np.r_[us[:1] if at is None else [at], us[:-1]] > gap_us
    parts, steps = part + np.cumsum(new), np.zeros(len(us), np.int64)
    # a point without a place leaves the last one of its part in force
    placed = np.flatnonzero(~(np.isnan(lats) | np.isnan(lons)))
    if len(placed):
        far = haversine_np(np.r_[np.nan if lat is None else lat, lats[placed[:-1]]], np.r_[np.nan if lon is None else lon, lons[placed[:-1]]], lats[placed], lons[placed])
        follows = (np.r_[part, parts[placed[:-1]]] == parts[placed]) & ~np.isnan(far)
        steps[placed[follows]] = np.rint(1000 * far[follows]).astype(np.int64)
        lat, lon, own = float(lats[placed[-1]]), float(lons[placed[-1]]), parts[placed[-1]]
    else:
        own = part
    if own != parts[-1]:
        lat = lon = None
    return parts, steps, (lat, lon, int(us[-1]), int(parts[-1]), int(cum + steps.sum()))


def tracked_stream(points: DataFrame, gap_s: float, late: str) -> DataFrame:
    """POINTS of a stream with part (a gap over ``gap_s`` begins one), step_mm and cum_mm, the running distance, of every point of its ride.

    Points may come in any order and up to ``late`` late: a ride's points wait in its state until
    the watermark has passed them and are then taken in order of time (ties: point_id). State holds the last
    point, the part and the distance so far, and what waits, so it grows with lateness, not
    with the ride. Later points than that, and points without a time or ride, are dropped by the watermark, as
    in every such stream. Append mode.
    """
    gap_us = round(gap_s * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lat, lon, at, part, cum, *held = state.get if state.exists else (None, None, None, 0, 0, [], [], [], [])
        waiting = [tuple(np.array(x, kind) for x, kind in zip(held, (np.int64, np.int64, float, float)))]
        for batch in batches:
            if len(batch):
                waiting.append(tuple(batch[c].to_numpy() for c in ("point_id", "us", "lat", "lon")))
        ids, us, lats, lons = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*waiting))
        order = np.lexsort((ids, us))
        ids, us, lats, lons = ids[order], us[order], lats[order].astype(float), lons[order].astype(float)
        n = int(np.searchsorted(us, state.getCurrentWatermarkMs() * 1000))  # points that the watermark has passed
        if n:
            before = cum
            parts, steps, (lat, lon, at, part, cum) = _advance(lat, lon, at, part, cum, us[:n], lats[:n], lons[:n], gap_us)
            yield pd.DataFrame({"ride_id": np.full(n, key[0]), "point_id": ids[:n], "us": us[:n], "lat": lats[:n], "lon": lons[:n], "part": parts, "step_mm": steps, "cum_mm": before + np.cumsum(steps)}, copy=False)
        state.update((lat, lon, at, part, cum, ids[n:].tolist(), us[n:].tolist(), lats[n:].tolist(), lons[n:].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(max(int(us[n]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    grouped = points.where("ride_id is not null and time is not null").withColumn("us", F.unix_micros("time")).withWatermark("time", late).groupBy("ride_id")
    out = grouped.applyInPandasWithState(run, _TRACKED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("time", F.timestamp_micros("us")).select("ride_id", "point_id", "time", "lat", "lon", "part", "step_mm", "cum_mm")


def tracked_table(points: DataFrame, gap_s: float) -> DataFrame:
    """The same of a table of POINTS, by windows."""
    w = Window.partitionBy("ride_id").orderBy("time", "point_id")
    rows = points.where("ride_id is not null and time is not null")
    apart = F.unix_micros("time") - F.lag(F.unix_micros("time")).over(w)
    rows = rows.withColumn("part", F.sum(F.when(apart > round(gap_s * 1e6), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("ride_id", "part").orderBy("time", "point_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    rows = rows.withColumn("last", F.last(placed, ignorenulls=True).over(own))
    step = F.round(1000 * geo.haversine(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon"))).cast("long")
    rows = rows.withColumn("step_mm", F.coalesce(step, F.lit(0).cast("long")))
    return rows.withColumn("cum_mm", F.sum("step_mm").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("ride_id", "point_id", "time", "lat", "lon", "part", "step_mm", "cum_mm")


LIBRARY = "segment_key string, hits long, mean_tss double, last_ride long"


def library_stream(scores: DataFrame) -> DataFrame:
    """LIBRARY of a stream of (segment_key, ride_id, tss): hits, running mean and last ride of every segment that a batch touches.

    The state of a segment is its sum, hits and last ride, as Spark's streaming aggregation keeps them, so Python is not
    called for each key; an entry comes out anew whenever it changes (update mode). Rows without a key or score don't count.
    """
    rows = scores.where("segment_key is not null and tss is not null and ride_id is not null")
    return rows.groupBy("segment_key").agg(F.count("*").alias("hits"), F.avg("tss").alias("mean_tss"), F.max("ride_id").alias("last_ride"))
