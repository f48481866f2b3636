"""Geometry and unit functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null where a coordinate is null."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would take 1 for null


def wrap(angle: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial compass bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_change(a: Column, b: Column) -> Column:
    d = F.abs(b - a)
    return F.when(d > 180, 360 - d).otherwise(d)


def grade_class(percent: Column) -> Column:
    p = F.abs(percent)
    return F.when(p < 2, "flat").when(p < 5, "mild").when(p < 8, "steep").otherwise("wall")
