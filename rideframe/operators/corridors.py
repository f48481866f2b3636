"""Corridors that many rides share: dense cells joined into components, and an ordered path through each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.operators.routes import connector_nodes
from rideframe.storage import dropped, written

#: A cell is one long: row and column, each of 31 bits around zero.
_SHIFT, _BIAS = 1 << 31, 1 << 30


def cell_id(cy, cx):
    return (cy + _BIAS) * _SHIFT + cx + _BIAS


def dense_cells(points: DataFrame, high: float, wide: float, least: int) -> DataFrame:
    """cell, cy, cx, n_rides of the grid cells of ``high`` by ``wide`` degrees that ``least`` rides or more pass; points without a place don't count."""
    cells = points.where("lat is not null and lon is not null").select("ride_id", F.floor(F.col("lat") / high).cast("long").alias("cy"), F.floor(F.col("lon") / wide).cast("long").alias("cx")).distinct()
    dense = cells.groupBy("cy", "cx").agg(F.count("*").alias("n_rides")).where(F.col("n_rides") >= least)
    return dense.select(cell_id(F.col("cy"), F.col("cx")).alias("cell"), "cy", "cx", "n_rides")


def neighbours(cells: DataFrame) -> DataFrame:
    """u, v: pairs of cells side by side or corner to corner, both ways."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    around = F.explode(F.array(*[cell_id(F.col("cy") + a, F.col("cx") + b) for a, b in steps]))
    return cells.select(F.col("cell").alias("u"), around.alias("v")).join(cells.select(F.col("cell").alias("v")), "v").select("u", "v")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the least node that each can reach; nodes: node, edges: u, v, both ways.

    Every round a node takes the least root among its own and its neighbours', then the root's
    own root, so the rounds grow with the logarithm of a chain, not with its length. A round
    keeps its own table only.
    """
    edges = written(edges, "pairs")
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        met = edges.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = written(roots.join(met, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root")), "roots")
        # a root that one of its nodes takes lower goes down with all of them
        lower = step.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("lower"))
        sunk = written(step.join(lower, "node", "left").select("node", "was", F.least("root", F.coalesce("lower", "root")).alias("root")), "roots")
        up = sunk.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = written(sunk.join(up, "root").select("node", "was", F.col("up").alias("root")), "roots")
        dropped(roots, step, sunk)
        roots = after.select("node", "root")
        roots.written_at = after.written_at
        if after.where("root <> was").isEmpty():
            dropped(edges)
            return roots


def corridors(points: DataFrame, high: float, wide: float, least: int, least_cells: int) -> DataFrame:
    """corridor, cell, cy, cx, n_rides: dense cells that hang together, ``least_cells`` or more; a corridor is named by its least cell."""
    cells = written(dense_cells(points, high, wide, least), "cells")
    roots = components(cells.select(F.col("cell").alias("node")), neighbours(cells))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least_cells).select("root")
    return cells.join(roots.withColumnRenamed("node", "cell"), "cell").join(sizes, "root").select(F.col("root").alias("corridor"), "cell", "cy", "cx", "n_rides")


def corridor_ends(cells: DataFrame) -> DataFrame:
    """corridor, u, v: the outermost cells along the main axis of each corridor (ties: least cell).

    The axis is that of the second moments of its cells, from sums alone.
    """
    y, x = F.col("cy").cast("double"), F.col("cx").cast("double")
    axis = cells.groupBy("corridor").agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    angle = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    at = F.round(x * F.cos(angle) + y * F.sin(angle), 6)
    placed = cells.join(axis, "corridor").withColumn("at", at)
    return placed.groupBy("corridor").agg(F.min(F.struct("at", "cell"))["cell"].alias("u"), F.min(F.struct(-F.col("at"), F.col("cell").alias("cell")))["cell"].alias("v"))


def corridor_paths(cells: DataFrame) -> DataFrame:
    """corridor, pos, cell, cy, cx: a path from end to end of each corridor as a segment candidate, over its busiest cells.

    A step costs its length in cells times one over the rides of the cell it enters, so the path keeps to
    where most rides go. A corridor of one cell is its own path.
    """
    cells = written(cells, "corridors")
    ends = written(corridor_ends(cells), "ends")
    place = cells.select(F.col("cell").alias("v"), F.col("cy").alias("vy"), F.col("cx").alias("vx"), "n_rides")
    steps = neighbours(cells).join(place, "v").join(cells.select(F.col("cell").alias("u"), "cy", "cx"), "u")
    length = F.hypot((F.col("vy") - F.col("cy")).cast("double"), (F.col("vx") - F.col("cx")).cast("double"))
    ways = connector_nodes(steps.select("u", "v", (length / F.col("n_rides")).alias("len_m")), ends)
    path = ends.join(ways, ["u", "v"]).select("corridor", F.posexplode("nodes").alias("pos", "cell"))
    return path.join(cells.select("cell", "cy", "cx"), "cell").select("corridor", "pos", "cell", "cy", "cx")
