"""Runs, edges and checks of node paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def path_order():
    return Window.partitionBy("ride_id").orderBy("pos")


def run_lengths(rows: DataFrame, keys: list[str], within: tuple[str, ...] = ("ride_id",)) -> DataFrame:
    """Consecutive rows of equal keys, by a change flag and its running sum: the columns of ``within``, run_idx, keys, start_pos, n, length_m."""
    w = Window.partitionBy(*within).orderBy("pos")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    flagged = rows.withColumn("new", F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1))
    runs = flagged.withColumn("run_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*within, "run_idx", *keys).agg(F.min("pos").alias("start_pos"), F.count("*").alias("n"), F.coalesce(F.sum("len_m"), F.lit(0.0)).alias("length_m"))


def pairs(path: DataFrame) -> DataFrame:
    """Steps (u, v) of a path, without those that stay at a node."""
    return path.withColumn("v", F.lead("node_id").over(path_order())).where("v <> node_id").withColumnRenamed("node_id", "u")


def edge_index(path: DataFrame) -> DataFrame:
    """Distinct directed edges, both ways."""
    p = pairs(path).select("u", "v", "way_id", "len_m")
    both = p.select(F.explode(F.array(F.struct("u", "v", "way_id", F.lit(1).alias("dir"), "len_m"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "way_id", F.lit(-1).alias("dir"), "len_m"))).alias("e"))
    return both.select("e.*").distinct()


def edge_lookup(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge of least (way, dir, length) of every step, else nulls."""
    best = edges.groupBy("u", "v").agg(F.min(F.struct("way_id", "dir", "len_m")).alias("e"))
    return steps.select("ride_id", "pos", "u", "v").join(best, ["u", "v"], "left").select("ride_id", "pos", "u", "v", "e.way_id", F.coalesce("e.dir", F.lit(0)).alias("dir"), "e.len_m")


def junctions(edges: DataFrame, least: int = 3) -> DataFrame:
    return edges.groupBy(F.col("u").alias("node_id")).agg(F.count_distinct("v").alias("degree")).where(F.col("degree") >= least)


def overlap(a, b, most: int):
    """Largest k <= most such that a ends with the first k elements of b."""
    top = F.least(F.size(a), F.size(b), F.lit(most))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda k: (k <= top) & (F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def assign_runs(points, runs):
    """The run of every point by distance along the ride: the last run that starts at or before it.

    points: ride_id, seq, at_mm; runs: ride_id, run_idx, start_mm. Starts and points are
    ordered together and each point takes the latest start, so no point meets more than one
    run; points of rides without runs have null. A point at a seam belongs to the later run.
    """
    starts = runs.select("ride_id", F.col("start_mm").alias("at_mm"), F.lit(0).alias("kind"), "run_idx", F.lit(None).cast("long").alias("seq"))
    both = starts.unionByName(points.select("ride_id", "at_mm", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("run_idx"), "seq"))
    w = Window.partitionBy("ride_id").orderBy("at_mm", "kind", "run_idx", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("run_idx", F.last("run_idx", ignorenulls=True).over(w)).where("kind = 1").select("ride_id", "seq", "at_mm", "run_idx")
