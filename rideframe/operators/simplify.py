"""Lines of fewer points, within a bound of the ride's own accuracy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideframe.operators.matching import _per_ride, haversine_np
from rideframe.operators.roads import DEGREE_M


def deviations(lat: np.ndarray, lon: np.ndarray, elv: np.ndarray, line_m: float, elv_m: float) -> np.ndarray:
    """How far the inner points are from the segment between first and last, in tolerances: the larger of place and elevation.

    Places are in the plane at the first point; the elevation is compared with that of the
    nearest place on the segment, and counts only where it is known.
    """
    kx = math.cos(math.radians(lat[0])) * DEGREE_M
    x, y = (lon[1:-1] - lon[0]) * kx, (lat[1:-1] - lat[0]) * DEGREE_M
    dx, dy = (lon[-1] - lon[0]) * kx, (lat[-1] - lat[0]) * DEGREE_M
    square = dx * dx + dy * dy
    share = np.clip((x * dx + y * dy) / square, 0.0, 1.0) if square > 0 else np.zeros(len(x))
    off = np.sqrt((x - share * dx) ** 2 + (y - share * dy) ** 2) / line_m
    rise = np.abs(elv[1:-1] - (elv[0] + share * (elv[-1] - elv[0]))) / elv_m
    return np.maximum(off, np.where(np.isnan(rise), 0.0, rise))


def simplified(points: DataFrame, line_m: Column | float, elv_m: Column | float) -> DataFrame:
    """ride_id, seq of the points that stay: all others are within ``line_m`` of the line through those, and within ``elv_m`` of its elevation.

    points: ride_id, seq, lat, lon, elv. Between two points that stay, the point that deviates
    most in tolerances stays too while it deviates by more than one (ties: the first), on both
    sides of it anew. First and last point of a ride stay; points without a place don't, and a
    missing elevation binds nothing. Tolerances may differ by ride: the ride's first row tells them.
    """
    column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    rows = points.where("lat is not null and lon is not null").select("ride_id", "seq", "lat", "lon", F.col("elv").cast("double").alias("elv"), column(line_m).alias("line_m"), column(elv_m).alias("elv_m"))

    def run(lat, lon, elv, line, rise) -> dict:
        keep = np.zeros(len(lat), bool)
        keep[[0, -1]] = True
        open_ = [(0, len(lat) - 1)]
        while open_:
            a, b = open_.pop()
            if b - a < 2:
                continue
            off = deviations(lat[a : b + 1], lon[a : b + 1], elv[a : b + 1], line[0], rise[0])
            k = int(off.argmax())
            if off[k] > 1:
                keep[a + 1 + k] = True
                open_ += [(a, a + 1 + k), (a + 1 + k, b)]
        return {"at": np.flatnonzero(keep)}

    return _per_ride(rows, ["lat", "lon", "elv", "line_m", "elv_m"], run, "ride_id long, seq long")


def by_accuracy(points: DataFrame, sigma: DataFrame, times: float, least_m: float) -> DataFrame:
    """``points`` with tolerance_m: ``times`` the accuracy of the ride (ride_id, sigma_m of ``matching.position_sigma``), at least ``least_m``; that alone where it is unknown."""
    told = points.join(sigma.select("ride_id", "sigma_m"), "ride_id", "left")
    return told.withColumn("tolerance_m", F.greatest(F.lit(float(least_m)), F.coalesce(times * F.col("sigma_m"), F.lit(float(least_m))))).drop("sigma_m")


def thinned(points: DataFrame, reach_m: Column) -> DataFrame:
    """ride_id, seq of points farther from the last one kept than the ride's own ``reach_m``; the first stays. Points without a place go."""
    rows = points.where("lat is not null and lon is not null").select("ride_id", "seq", "lat", "lon", reach_m.alias("reach_m"))

    def run(lat, lon, reach) -> dict:
        kept, at, size = [0], 1, 16
        while at < len(lat):
            k, end = kept[-1], min(at + size, len(lat))
            far = np.flatnonzero(haversine_np(lat[k], lon[k], lat[at:end], lon[at:end]) > reach[0])
            if len(far):
                kept.append(at + int(far[0]))
                at, size = kept[-1] + 1, 16
            else:
                at, size = end, 2 * size
        return {"at": np.array(kept)}

    return _per_ride(rows, ["lat", "lon", "reach_m"], run, "ride_id long, seq long")
