"""Merge costs, segments and scores of road sections."""

from __future__ import annotations

import heapq
import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.operators.rides import by_whole_rides


def ride():
    return Window.partitionBy("ride_id").orderBy("pos")


#: Merge-cost weights, and barriers that control access.
HIGHWAY_RANK = {"trunk": 1.9, "primary": 1.8, "secondary": 1.5, "tertiary": 1.0, "unclassified": 1.0, "road": 1.0, "residential": 0.5, "living_street": 0.0}
SMOOTHNESS = {"excellent": 1.0, "good": 0.9, "intermediate": 0.7, "bad": 0.5, "horrible": 0.4, "very_horrible": 0.2}
PAVED = ["asphalt", "concrete", "paved", "paving_stones"]
BARRIERS = ["block", "bollard", "cattle_grid", "chain", "cycle_barrier", "debris", "gate", "jersey_barrier", "log", "rope", "yes"]
HIGHWAY_STEP, SMOOTHNESS_STEP, SPEED_STEP, PAVING_CHANGE, SURFACE_CHANGE, CYCLEWAY_CHANGE, CYCLEWAY_END = 0.5, 0.05, 0.02, 0.6, 0.1, 0.2, 1.0


def lookup(column: Column, table: dict[str, float]) -> Column:
    return reduce(lambda c, kv: F.when(column == kv[0], kv[1]).otherwise(c), table.items(), F.lit(None).cast("double"))


def merge_cost(rows: DataFrame) -> DataFrame:
    """cost of the boundary before each section, 0 to 1; null at the first of a ride.

    A change to, from or between classes without a rank costs 1, and so does a motorway. The
    columns cycleway, junction, barrier and mountain_pass are optional: a junction, an
    access barrier, a pass or an impassable surface on either side costs 1, a cycleway that
    begins or ends 1 and one that changes CYCLEWAY_CHANGE.
    """
    prev = lambda c: F.lag(c).over(ride())
    rank = lookup(F.col("highway"), HIGHWAY_RANK)
    rules = {"highway": F.col("highway") == "motorway", "smoothness": F.col("smoothness") == "impassable", "junction": F.col("junction").isNotNull(), "barrier": F.col("barrier").isin(BARRIERS), "mountain_pass": F.col("mountain_pass") == "yes"}
    hard = reduce(lambda a, b: a | b, [F.coalesce(rule, F.lit(False)) for c, rule in rules.items() if c in rows.columns])
    rows = rows.withColumns({"rank": rank, "smooth": lookup(F.col("smoothness"), SMOOTHNESS), "paved": F.col("surface").isin(PAVED), "hard": hard})
    changed = lambda c: ~F.col(c).eqNullSafe(prev(c))
    cost = F.when(changed("highway"), F.coalesce(HIGHWAY_STEP * F.abs(F.col("rank") - prev("rank")), F.lit(1.0))).otherwise(0.0)
    cost += F.when(changed("surface"), F.when(changed("paved"), PAVING_CHANGE).otherwise(SURFACE_CHANGE)).otherwise(0.0)
    cost += F.coalesce(SMOOTHNESS_STEP * F.abs(F.col("smooth") - prev("smooth")), F.lit(0.0))
    cost += F.coalesce(SPEED_STEP * F.abs(F.col("maxspeed") - prev("maxspeed")), F.lit(0.0))
    if "cycleway" in rows.columns:
        cost += F.when(changed("cycleway"), F.when(F.col("cycleway").isNull() | prev("cycleway").isNull(), CYCLEWAY_END).otherwise(CYCLEWAY_CHANGE)).otherwise(0.0)
    cost = F.when(F.col("hard") | prev("hard"), 1.0).otherwise(F.least(F.lit(1.0), F.round(cost, 6)))
    return rows.withColumn("cost", F.when(F.row_number().over(ride()) > 1, cost)).drop("rank", "smooth", "paved", "hard")


def threshold_segments(costed: DataFrame, threshold: float) -> DataFrame:
    """segment_id counts the boundaries at or above the threshold."""
    cut = F.when(F.col("cost") >= threshold, 1).otherwise(0)
    return costed.withColumn("cut", cut).withColumn("segment_id", F.sum("cut").over(ride().rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def segment_features(segments: DataFrame) -> DataFrame:
    return segments.groupBy("ride_id", "segment_id").agg(
        F.min("pos").alias("start_pos"), F.count("*").alias("n_sections"), F.round(F.sum("len_m"), 3).alias("length_m"), F.round(F.avg("maxspeed"), 6).alias("mean_maxspeed"),
        F.round(F.sum(F.when(F.col("surface").isin(PAVED), F.col("len_m")).otherwise(0.0)) / F.sum("len_m"), 6).alias("paved_share"), F.count_distinct("highway").alias("n_classes"),
    )


def boundary_cost(a: tuple, b: tuple) -> float:
    """``merge_cost`` of two sections (highway, surface, smoothness, maxspeed, cycleway) without tags that make a boundary hard.

    A section with such a tag is a part of its own, so that no merge refreshes its boundaries.
    """
    cost = 0.0
    if a[0] != b[0]:
        ranks = HIGHWAY_RANK.get(a[0]), HIGHWAY_RANK.get(b[0])
        cost += 1.0 if None in ranks else HIGHWAY_STEP * abs(ranks[1] - ranks[0])
    if a[1] != b[1]:
        paved = [None if x is None else x in PAVED for x in (a[1], b[1])]
        cost += PAVING_CHANGE if paved[0] != paved[1] else SURFACE_CHANGE
    smooth = SMOOTHNESS.get(a[2]), SMOOTHNESS.get(b[2])
    if None not in smooth:
        cost += SMOOTHNESS_STEP * abs(smooth[1] - smooth[0])
    if not (math.isnan(a[3]) or math.isnan(b[3])):
        cost += SPEED_STEP * abs(b[3] - a[3])
    if a[4] != b[4]:
        cost += CYCLEWAY_END if None in (a[4], b[4]) else CYCLEWAY_CHANGE
    return min(1.0, round(cost, 6))


def merge_part(costs: list[float], lengths: list[float], tags: list[tuple], threshold: float) -> list[int]:
    """Segment of each section of one part; costs[i] is that of the boundary before section i, for i > 0.

    The cheapest boundary goes first (ties: the first of them), by a heap whose stale entries
    are skipped. A merged section has the tags of its longer side (ties: the first side).
    """
    n = len(costs)
    before, after, cost = [*range(-1, n - 1)], [*range(1, n), -1], list(costs)
    heap = [(cost[i], i) for i in range(1, n) if cost[i] < threshold]
    heapq.heapify(heap)
    head = [True] * n
    while heap:
        c, i = heapq.heappop(heap)
        if not head[i] or c != cost[i]:
            continue
        a, z = before[i], after[i]
        head[i] = False
        after[a] = z
        if lengths[i] > lengths[a]:
            tags[a] = tags[i]
            if before[a] >= 0:
                cost[a] = boundary_cost(tags[before[a]], tags[a])
                heapq.heappush(heap, (cost[a], a)) if cost[a] < threshold else None
        elif z >= 0:
            cost[z] = boundary_cost(tags[a], tags[z])
            heapq.heappush(heap, (cost[z], z)) if cost[z] < threshold else None
        if z >= 0:
            before[z] = a
        lengths[a] += lengths[i]
    return [x - 1 for x in itertools.accumulate(head)]


def _merge_rides(threshold: float):
    def settle(rows: pd.DataFrame, _) -> pd.DataFrame:
        ride, part = rows["ride_id"].to_numpy(), rows["part"].to_numpy()
        begin = np.flatnonzero(np.r_[True, (ride[1:] != ride[:-1]) | (part[1:] != part[:-1])])
        end = np.r_[begin[1:], len(rows)]
        segment = np.arange(len(rows)) - np.repeat(begin, end - begin)  # every section its own
        low = rows["cost"].to_numpy() < threshold
        low[begin] = False
        merges, size = np.add.reduceat(low.astype(int), begin) > 0, end - begin
        segment[np.repeat(merges & (size == 2), size)] = 0  # its only boundary goes
        # the rows of longer parts leave numpy together, once for all of them
        merges &= size > 2
        busy = np.repeat(merges, size)
        own = {c: rows[c].to_numpy()[busy].tolist() for c in ("cost", "len_m", "highway", "surface", "smoothness", "cycleway")}
        tags = list(zip(own["highway"], own["surface"], own["smoothness"], rows["maxspeed"].to_numpy(float)[busy].tolist(), own["cycleway"]))
        told, at = [], 0
        for n in size[merges].tolist():
            told += merge_part(own["cost"][at : at + n], own["len_m"][at : at + n], tags[at : at + n], threshold)
            at += n
        segment[busy] = told
        return pd.DataFrame({"ride_id": ride, "part": part, "pos": rows["pos"], "segment_id": segment})

    return settle


def greedy_merge(sections: DataFrame, threshold: float) -> DataFrame:
    """Merge the cheapest boundary, refresh its neighbours by all terms of ``merge_cost``, until none is under the threshold: ride_id, part, pos, segment_id.

    Boundaries of cost 1 never merge: they part a ride, and segments count from 0 in each
    part. The order depends on the data, so one Python pass a task settles whole rides; parts
    without a boundary under the threshold never leave numpy.
    """
    costed = merge_cost(sections)
    hard = F.when(F.col("cost") >= 1, 1).otherwise(0)
    parts = costed.withColumn("part", F.sum(hard).over(ride().rowsBetween(Window.unboundedPreceding, 0)))
    narrow = parts.select("ride_id", "part", "pos", F.col("len_m").cast("double").alias("len_m"), "cost", "highway", "surface", "smoothness", F.col("maxspeed").cast("double").alias("maxspeed"), (F.col("cycleway") if "cycleway" in sections.columns else F.lit(None)).cast("string").alias("cycleway"))
    return by_whole_rides(narrow, "pos", _merge_rides(threshold), "ride_id long, part long, pos long, segment_id long")


#: Our own bins and weights of the five zones, as none are published: trait -> weight, a minus before a trait means its absence.
ZONES = {
    "endurance": [("long", 0.4), ("smooth", 0.2), ("free", 0.2), ("steady", 0.2)],
    "tempo": [("long", 0.3), ("smooth", 0.2), ("free", 0.3), ("climb", 0.2)],
    "threshold": [("climb", 0.4), ("steady", 0.3), ("free", 0.3)],
    "vo2max": [("climb", 0.5), ("-long", 0.3), ("free", 0.2)],
    "anaerobic": [("-long", 0.5), ("climb", 0.3), ("-free", 0.2)],
}


def ride_features(points: DataFrame, segment: str) -> DataFrame:
    """Features of each segment of a ride from its points (seq, elv, step_mm, gradient_pct, kappa, speed_mps).

    length_m, gain_m (sum of rises), mean_grade, var_grade (sample), mean_kappa, stops (points
    under 0.5 m/s after the first) and stops a kilometre. One shuffle serves the rise and the sums.
    """
    w = Window.partitionBy("ride_id").orderBy("seq")
    rise = F.greatest(F.col("elv") - F.lag("elv").over(w), F.lit(0.0))
    own = points.withColumn("rise", F.when(F.col(segment) == F.lag(segment).over(w), rise).otherwise(0.0))
    stop = (F.col("speed_mps") < 0.5) & (F.col("seq") > 0)
    out = own.groupBy("ride_id", segment).agg(
        (F.sum("step_mm") / 1000.0).alias("length_m"), F.sum("rise").alias("gain_m"), F.avg("gradient_pct").alias("mean_grade"), F.var_samp("gradient_pct").alias("var_grade"), F.avg("kappa").alias("mean_kappa"), F.count_if(stop).alias("stops"),
    )
    return out.withColumn("stops_per_km", F.col("stops") / F.greatest(F.col("length_m") / 1000.0, F.lit(0.1)))


def complete_features(points: DataFrame, segment: str, junctions: DataFrame, roads: DataFrame) -> DataFrame:
    """``ride_features`` of each segment with its junctions and its road, in one table.

    junctions: ride_id, seq, node_id, a row for each junction that a point is near, or for each place of some, with n_nodes,
    how many it has; n_junctions counts the different ones a segment meets, and junctions_per_km takes them by its length. roads: ride_id, seq,
    highway, surface, maxspeed of the road under a point, if any: on_road, paved_share and
    mean_maxspeed weigh points by their step, n_classes counts classes. A segment without a
    road has nulls there and on_road 0.
    """
    own = points.select("ride_id", "seq", segment, "step_mm")
    share = F.col("n_nodes") if "n_nodes" in junctions.columns else F.lit(1)
    met = own.join(junctions, ["ride_id", "seq"]).groupBy("ride_id", segment, "node_id").agg(F.max(share).cast("long").alias("n"))
    met = met.where("node_id is not null").groupBy("ride_id", segment).agg(F.sum("n").alias("n_junctions"))
    under = own.join(roads, ["ride_id", "seq"], "left").withColumn("found", F.col("highway").isNotNull())
    weight = lambda c: F.sum(F.when(c, F.col("step_mm")).otherwise(0))
    road = under.groupBy("ride_id", segment).agg(
        (weight(F.col("found")) / F.nullif(F.sum("step_mm"), F.lit(0))).alias("on_road"), (weight(F.col("surface").isin(PAVED)) / F.nullif(weight(F.col("found")), F.lit(0))).alias("paved_share"),
        (F.sum(F.col("maxspeed") * F.col("step_mm")) / F.nullif(weight(F.col("maxspeed").isNotNull()), F.lit(0))).alias("mean_maxspeed"), F.count_distinct("highway").alias("n_classes"),
    )
    out = ride_features(points, segment).join(road, ["ride_id", segment], "left").join(met, ["ride_id", segment], "left")
    out = out.withColumn("n_junctions", F.coalesce("n_junctions", F.lit(0)))
    return out.withColumn("junctions_per_km", F.col("n_junctions") / F.greatest(F.col("length_m") / 1000.0, F.lit(0.1)))


def zone_scores(features: DataFrame, long_m: float = 5000.0, steep: float = 8.0) -> DataFrame:
    """A score from 0 to 1 for each of the five training zones, by binned traits and the weights of ZONES."""
    binned = lambda c, edges: sum((F.when(c >= e, 1.0).otherwise(0.0) for e in edges), F.lit(0.0)) / len(edges)
    t = {
        "long": binned(F.col("length_m"), [long_m / 4, long_m / 2, long_m, 2 * long_m]),
        "climb": binned(F.col("mean_grade"), [steep / 4, steep / 2, steep]),
        "smooth": 1.0 - binned(F.col("mean_kappa"), [0.001, 0.01, 0.1]),
        "free": 1.0 - binned(F.col("stops_per_km"), [0.1, 0.5, 2.0]),
        "steady": 1.0 - binned(F.coalesce("var_grade", F.lit(0.0)), [1.0, 10.0, 100.0]),
    }
    return features.withColumns({zone: sum((w * (1.0 - t[k[1:]] if k[0] == "-" else t[k]) for k, w in parts), F.lit(0.0)) for zone, parts in ZONES.items()})


def propose_boundaries(points: DataFrame, turn: float, stop_mps: float, least_m: float, attributes: list[str] = ()) -> DataFrame:
    """Points where a way begins, one of its ``attributes`` changes, the heading turns by more than ``turn`` radians or the rider stops, at least ``least_m`` after the boundary before.

    points: ride_id, seq, cum_mm, heading_delta, speed_mps, way_id, attributes. An attribute that becomes known or unknown changes. The guard compares with the
    last boundary that stays, so close candidates thin out to one every ``least_m`` and no long
    piece is left without one. Only candidates reach Python, many rides in one pass a task.
    """
    w = Window.partitionBy("ride_id").orderBy("seq")
    way = ~F.col("way_id").eqNullSafe(F.lag("way_id").over(w))
    why = F.when(way, "way")
    for c in attributes:
        why = why.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), c)
    why = why.when(F.abs("heading_delta") > turn, "turn").when(F.col("speed_mps") < stop_mps, "stop")
    cuts = points.withColumn("why", F.when(F.row_number().over(w) > 1, why)).where("why is not null")
    least = round(1000 * least_m)

    def settle(rows: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        at, kept = rows["cum_mm"].to_numpy(), []
        for a, z in zip(begin, [*begin[1:], len(rows)]):
            while a < z:
                kept.append(a)
                a += max(1, int(np.searchsorted(at[a:z], at[a] + least)))
        return rows.iloc[kept][["ride_id", "seq", "cum_mm", "why"]]

    return by_whole_rides(cuts.select("ride_id", "seq", "cum_mm", "why"), "seq", settle, "ride_id long, seq long, cum_mm long, why string")


#: Our own weights of the suitability score, as none are published: length, paving, calm, unity.
SUITABILITY = (0.4, 0.3, 0.2, 0.1)


def suitability(features: DataFrame) -> DataFrame:
    """tss, 0 to 1: long, paved, slow and uniform segments score high."""
    a, b, c, d = SUITABILITY
    score = a * F.least(F.lit(1.0), F.col("length_m") / 100) + b * F.col("paved_share") + c * (1.0 - F.col("mean_maxspeed") / 50) + d / F.col("n_classes")
    return features.withColumn("tss", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def set_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """jaccard of two sets of (ride_id, pos) per ride that is in either."""
    both = a.distinct().withColumn("x", F.lit(1)).unionByName(b.distinct().withColumn("x", F.lit(2))).groupBy("ride_id", "pos").agg(F.sum("x").alias("x"))
    return both.groupBy("ride_id").agg((F.count_if(F.col("x") == 3) / F.count("*")).alias("jaccard"))


def wavelet_footprint(values: DataFrame, key: str, levels: int, gamma: float) -> DataFrame:
    """key, level, k, d: Haar details over gamma times the standard deviation of their level; values: key, i, x.

    Each level pairs the means of the one before, so it has half its rows; a value without a
    partner ends there. Details and deviations are compared to nine places.
    """
    w, out = Window.partitionBy(key), None
    for level in range(1, levels + 1):
        pick = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("x")))
        pairs = values.groupBy(key, F.floor(F.col("i") / 2).cast("long").alias("k")).agg(pick(0).alias("a"), pick(1).alias("b"), F.count("*").alias("n")).where("n = 2")
        root = F.sqrt(F.lit(2.0))
        d = pairs.select(key, F.lit(level).alias("level"), "k", ((F.col("a") - F.col("b")) / root).alias("d")).withColumn("s", F.stddev_pop("d").over(w))
        d = d.where(F.abs(F.round("d", 9)) > gamma * F.round("s", 9)).drop("s")
        out = d if out is None else out.unionByName(d)
        values = pairs.select(key, F.col("k").alias("i"), ((F.col("a") + F.col("b")) / root).alias("x"))
    return out


def upsert_library(library: DataFrame, more: DataFrame) -> DataFrame:
    """(segment_key, hits, mean_tss, last_ride) of a library with those of new rides: hits add up, the mean runs on, the last ride is the later one."""
    return merged_library(library.unionByName(more))


def merged_library(both: DataFrame) -> DataFrame:
    """One entry per segment_key of entries of a library and of new rides."""
    return both.groupBy("segment_key").agg((F.sum(F.col("mean_tss") * F.col("hits")) / F.sum("hits")).alias("mean_tss"), F.sum("hits").alias("hits"), F.max("last_ride").alias("last_ride"))


def prune_library(library: DataFrame, least_hits: int, before: int) -> DataFrame:
    """Entries of few hits go once they have not been seen since ``before``."""
    return library.where((F.col("hits") >= least_hits) | (F.col("last_ride") >= before))


def library(segments: DataFrame) -> DataFrame:
    """Segments of equal way sequences as one entry: segment_key, hits, mean_length_m."""
    ways = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "way_id"))), lambda x: x["way_id"].cast("string")), ">")
    each = segments.groupBy("ride_id", "segment_id").agg(ways.alias("ways"), F.sum("len_m").alias("length_m"))
    return each.groupBy(F.md5("ways").alias("segment_key")).agg(F.count("*").alias("hits"), F.avg("length_m").alias("mean_length_m"))
