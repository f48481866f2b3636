"""Per-point signals of rides: windows over ride_id ordered by seq, one shuffle for all of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from rideframe.functions import geo
from rideframe.operators.rides import by_whole_rides


def ride():
    return Window.partitionBy("ride_id").orderBy("seq")


def so_far():
    return ride().rowsBetween(Window.unboundedPreceding, 0)


def with_distance(points: DataFrame) -> DataFrame:
    """step_mm to the previous point (first: 0) and its running sum cum_mm, in whole millimetres."""
    step = geo.haversine(F.lag("lat").over(ride()), F.lag("lon").over(ride()), F.col("lat"), F.col("lon"))
    out = points.withColumn("step_mm", F.coalesce(F.round(1000 * step).cast("long"), F.lit(0)))
    return out.withColumn("cum_mm", F.sum("step_mm").over(so_far()))


def with_heading(points: DataFrame) -> DataFrame:
    """heading to the next point from east, the last copies the one before; heading_delta is 0 at both ends."""
    own = F.atan2(F.lead("lat").over(ride()) - F.col("lat"), F.lead("lon").over(ride()) - F.col("lon"))
    out = points.withColumn("own_heading", own)
    before = F.lag("own_heading").over(ride())
    delta = F.when(F.col("own_heading").isNull() | before.isNull(), 0.0).otherwise(geo.wrap(F.col("own_heading") - before))
    return out.withColumns({"heading": F.coalesce("own_heading", before, F.lit(0.0)), "heading_delta": delta}).drop("own_heading")


@F.pandas_udf(BooleanType())
def _jumps(y1: pd.Series, x1: pd.Series, y2: pd.Series, x2: pd.Series) -> pd.Series:
    """Whether two headings differ by more than pi, by the C library's atan2; null where a part is."""
    known = (y1.notna() & x1.notna() & y2.notna() & x2.notna()).to_numpy()
    out = pd.Series(None, index=y1.index, dtype="boolean")
    for i in np.flatnonzero(known):
        out.iloc[i] = abs(math.atan2(y2.iloc[i], x2.iloc[i]) - math.atan2(y1.iloc[i], x1.iloc[i])) > math.pi
    return out


def with_jumps(points: DataFrame) -> DataFrame:
    """jump: whether the heading (``with_heading``) differs by more than pi from that of the point before, unwrapped; false at the first point.

    On the way straight back the difference is pi up to the last digit of atan2, in which the JVM and the C library
    (DuckDB's) differ; those few points are told by the latter.
    """
    dy, dx = F.lead("lat").over(ride()) - F.col("lat"), F.lead("lon").over(ride()) - F.col("lon")
    zero = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))
    out = points.withColumn("own", F.when(dy.isNotNull() & dx.isNotNull(), F.struct(dy.alias("y"), dx.alias("x"))))
    out = out.withColumn("way", F.coalesce("own", F.lag("own").over(ride()), zero))
    out = out.withColumn("was", F.lag("way").over(ride()))
    gap = F.abs(F.atan2("way.y", "way.x") - F.atan2("was.y", "was.x"))
    near = F.abs(gap - F.pi()) < 1e-9
    told = _jumps(*[F.when(near, F.col(c)) for c in ("was.y", "was.x", "way.y", "way.x")])
    return out.withColumn("jump", F.coalesce(told, gap > F.pi(), F.lit(False))).drop("own", "way", "was")


def with_speed(points: DataFrame) -> DataFrame:
    """Metres a second since the previous point, over at least a millisecond; first: 0."""
    seconds = F.greatest(F.lit(1e-3), (F.col("t_us") - F.lag("t_us").over(ride())) / 1e6)
    return points.withColumn("speed_mps", F.coalesce(F.col("step_mm") / 1000.0 / seconds, F.lit(0.0)))


def with_gradient(points: DataFrame, reach_m: int) -> DataFrame:
    """Percent between the first and last point within reach_m of cumulative distance; 0 without a base."""
    w = Window.partitionBy("ride_id").orderBy("cum_mm").rangeBetween(-1000 * reach_m, 1000 * reach_m)
    rise = F.max_by("elv", "seq").over(w) - F.min_by("elv", "seq").over(w)
    base = (F.max("cum_mm").over(w) - F.min("cum_mm").over(w)) / 1000.0
    return points.withColumn("gradient_pct", F.when(base > 1e-6, 100 * rise / base).otherwise(0.0))


def route_signal(points: DataFrame, reach_m: int = 2000) -> DataFrame:
    out = with_gradient(with_speed(with_heading(with_distance(points))), reach_m)
    return out.withColumn("rel_us", F.col("t_us") - F.first("t_us").over(so_far()))


def dynamic_radius(points: DataFrame, chunk: int = 200, window: int = 5, base: int = 10, most: int = 50) -> DataFrame:
    """Search radius from the centred mean of bearing changes, inside chunks of a ride."""
    points = points.withColumn("chunk_id", F.floor(F.col("seq") / chunk).cast("long"))
    w = Window.partitionBy("ride_id", "chunk_id").orderBy("seq")
    points = points.withColumn("bearing", geo.bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))
    points = points.withColumn("turn", geo.bearing_change(F.lag("bearing").over(w), F.col("bearing")))
    half = window // 2
    mean = F.coalesce(F.round(F.avg("turn").over(w.rowsBetween(-half, half)), 6), F.lit(0.0))
    return points.withColumn("radius", F.least(F.lit(most), base + F.ceil(mean * 2)).cast("long"))


def split_on_gaps(points: DataFrame, gap_us: int) -> DataFrame:
    """track_id counts the gaps before a point."""
    late = F.coalesce((F.col("t_us") - F.lag("t_us").over(ride()) > gap_us).cast("long"), F.lit(0))
    return points.withColumn("late", late).withColumn("track_id", F.sum("late").over(so_far())).drop("late")


def curvature(points: DataFrame) -> DataFrame:
    """kappa: absolute change of direction over the chord between the neighbours, in a local plane."""
    at = lambda c, o: F.col(c) if not o else F.lag(c, 1).over(ride()) if o < 0 else F.lead(c, 1).over(ride())
    x = lambda a, b: F.radians(at("lon", b) - at("lon", a)) * F.cos(F.radians(F.col("lat"))) * geo.EARTH_M
    y = lambda a, b: F.radians(at("lat", b) - at("lat", a)) * geo.EARTH_M
    turn = geo.wrap(F.atan2(y(0, 1), x(0, 1)) - F.atan2(y(-1, 0), x(-1, 0)))
    chord = F.hypot(x(-1, 1), y(-1, 1))
    return points.withColumn("kappa", F.when(chord > 1e-6, F.abs(turn) / chord).otherwise(0.0))


def curvature_burden(points: DataFrame, critical: float) -> DataFrame:
    """pct_twisty: the share of the way that bends by more than ``critical`` a metre; cbi: the mean of what is over it, by length."""
    over = F.greatest(F.col("kappa") - critical, F.lit(0.0))
    total = F.nullif(F.sum("step_mm"), F.lit(0))
    return points.groupBy("ride_id").agg((F.sum(F.when(F.col("kappa") > critical, F.col("step_mm")).otherwise(0)) / total).alias("pct_twisty"), (F.sum(over * F.col("step_mm")) / total).alias("cbi"))


def smoothed_gradient(points: DataFrame, reach_m: float, boost: float = 0.6, full: float = 10.0) -> DataFrame:
    """ride_id, seq, smoothed: Gaussian mean of gradient_pct within reach_m of cumulative distance (sigma a third of it), steep points weighing up to 1 + boost.

    Weights depend on the centre, so numpy takes whole rides: one pass for each distance in
    rows, up to the longest frame, over all rides of a batch at once.
    """

    def run(rows: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        n, at, g = len(rows), rows["cum_mm"].to_numpy() / 1000.0, rows["gradient_pct"].to_numpy()
        ride = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, n]))
        own = 1.0 + boost * np.minimum(np.abs(g) / full, 1.0)
        total, weight = own * g, own.copy()
        for k in range(1, n):
            near = (ride[k:] == ride[:-k]) & (at[k:] - at[:-k] <= reach_m)
            i = np.flatnonzero(near)
            if not len(i):
                break  # distances grow along a ride: farther rows are farther away
            w = np.exp(-0.5 * ((at[i + k] - at[i]) / (reach_m / 3.0)) ** 2)
            np.add.at(total, i, w * own[i + k] * g[i + k])
            np.add.at(weight, i, w * own[i + k])
            np.add.at(total, i + k, w * own[i] * g[i])
            np.add.at(weight, i + k, w * own[i])
        return pd.DataFrame({"ride_id": rows["ride_id"], "seq": rows["seq"], "smoothed": total / weight})

    return by_whole_rides(points.select("ride_id", "seq", "cum_mm", "gradient_pct"), "seq", run, "ride_id long, seq long, smoothed double")


def fill_gaps(points: DataFrame, column: str) -> DataFrame:
    """Zeros, NaN and nulls of a column become the mean of the nearest good values before and after, or the one there is."""
    good = F.when(~F.isnan(column) & (F.col(column) != 0), F.col(column))
    before = F.last(good, ignorenulls=True).over(so_far())
    after = F.first(good, ignorenulls=True).over(ride().rowsBetween(0, Window.unboundedFollowing))
    return points.withColumn(column, F.coalesce(good, (before + after) / 2, before, after))


def rolling_power(points: DataFrame, seconds: int) -> DataFrame:
    w = Window.partitionBy("ride_id").orderBy("t_us").rangeBetween(-1_000_000 * seconds, 0)
    return points.withColumn("rolling_w", F.avg("power_w").over(w))


def normalized_power(points: DataFrame, seconds: int) -> DataFrame:
    return rolling_power(points, seconds).groupBy("ride_id").agg(F.pow(F.avg(F.pow("rolling_w", F.lit(4.0))), F.lit(0.25)).alias("np_w"))


def step_stats(points: DataFrame) -> DataFrame:
    """Steps of a ride: count, least, median, 95th percentile, most, mean; quantiles are sorted[floor((n - 1) p)]."""
    steps = with_distance(points).where("seq > 0")
    w = Window.partitionBy("ride_id").orderBy("step_mm", "seq")
    ranked = steps.select("ride_id", "step_mm", (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy("ride_id")).alias("n"))
    q = lambda p: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * F.lit(p)), F.col("step_mm")))
    return ranked.groupBy("ride_id").agg(F.count("*").alias("n"), F.min("step_mm").alias("min_mm"), q(0.5).alias("p50_mm"), q(0.95).alias("p95_mm"), F.max("step_mm").alias("max_mm"), F.round(F.avg("step_mm"), 3).alias("avg_mm"))


def asof_attach(points: DataFrame, matched) -> DataFrame:
    """Every point goes to the last matched point at or before it; those before the first stay out."""
    anchor = F.last(F.when(matched, F.col("seq")), ignorenulls=True).over(so_far())
    return points.withColumn("anchor", anchor).where("anchor is not null")
