"""Bands of duration, polarity of features, confidence and alternative scores of segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.operators.segments import lookup

#: Pluses by class of road; classes that void a segment.
POLARITY = {"cycleway": 4.0, "unclassified": 2.0, "secondary": 1.0, "residential": 1.0, "primary": 0.0, "tertiary": 0.0}
FEATURE_POLARITY = {
    ("amenity", "cafe"): 1, ("amenity", "pub"): 0, ("amenity", "bicycle_repair_station"): 1, ("amenity", "fuel"): 0, ("amenity", "drinking_water"): 2, ("amenity", "water_point"): 2, ("amenity", "toilets"): 1,
    ("landuse", "commercial"): -1, ("landuse", "construction"): -2, ("landuse", "industrial"): -1, ("landuse", "residential"): 1, ("landuse", "farmland"): 0, ("landuse", "forest"): 1, ("landuse", "meadow"): 0, ("landuse", "vineyard"): 1, ("landuse", "landfill"): -2,
    ("leisure", "common"): 1, ("leisure", "park"): 1, ("leisure", "track"): 1, ("barrier", "kerb"): -1, ("barrier", "cycle_barrier"): -1, ("barrier", "debris"): -1, ("route", "bicycle"): 4, ("route", "bus"): -1,
}
VOID = ["motorway", "trunk", "motorway_link", "trunk_link"]

#: Our own weights, as none are published: (feature, weight); a minus before a feature means its absence.
ALTERNATIVES = {
    "endurance": [("long", 0.6), ("paved", 0.2), ("uniform", 0.2)],
    "exploration": [("-paved", 0.7), ("-uniform", 0.3)],
    "interval": [("long", 0.5), ("uniform", 0.5)],
    "race": [("paved", 0.6), ("long", 0.4)],
    "safety": [("calm", 0.7), ("paved", 0.3)],
}


def mean_ranks(rows: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """(column, r<column>): the mean rank of every distinct value, nulls left out.

    Values are counted, dealt into ranges of equal size by sampled quantiles, ranked inside their
    range, and the totals of the ranges before (one row a range) are added, so no task sees
    more than its range.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))  # one row
    placed = counts.join(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(column)))).drop("cuts")
    totals = placed.groupBy("part").agg(F.sum("n").alias("m"))
    before = totals.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # one row a range
    own = F.sum("n").over(Window.partitionBy("part").orderBy(column)) - F.col("n") + 1 + (F.col("n") - 1) / 2.0
    return placed.join(F.broadcast(before), "part").select(column, (F.col("before") + own).alias(f"r{column}"))


def scale_band(seconds: Column) -> Column:
    """Band of a duration; the bands leave a hole between 8 and 10 minutes, which is null."""
    return F.when(seconds < 20, "sprint").when(seconds < 180, "short").when(seconds <= 480, "middle").when((seconds >= 600) & (seconds <= 3600), "long").when(seconds > 3600, "endless")


def polarity(sections: DataFrame) -> DataFrame:
    """Sum of pluses per ride; void if any section is of a class that voids."""
    plus = F.coalesce(lookup(F.col("highway"), POLARITY), F.lit(0.0)).cast("long")
    return sections.groupBy("ride_id").agg(F.sum(plus).alias("polarity"), F.some(F.col("highway").isin(VOID)).alias("void"))


def tag_polarity(tags: Column) -> Column:
    """Sum of the polarities of a map of tags; amenities of no known worth count -1."""
    known = F.create_map(*[F.lit(x) for (k, v), n in FEATURE_POLARITY.items() for x in (f"{k}={v}", n)])
    each = lambda k, v: F.coalesce(F.try_element_at(known, F.concat_ws("=", k, v)), F.when(k == "amenity", -1).otherwise(0))
    return F.aggregate(F.map_entries(tags), F.lit(0), lambda total, e: total + each(e["key"], e["value"]))


def traits(features: DataFrame) -> dict[str, Column]:
    """long, paved, calm and uniform, each about 0 to 1."""
    return {"long": F.least(F.lit(1.0), F.col("length_m") / 100), "paved": F.col("paved_share"), "calm": 1.0 - F.col("mean_maxspeed") / 50, "uniform": 1.0 / F.col("n_classes")}


def confidence(features: DataFrame) -> DataFrame:
    """1 / (1 + sample variance of the traits): segments whose traits agree score near 1."""
    t = list(traits(features).values())
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    mean = total(t) / len(t)
    spread = total([F.pow(x - mean, F.lit(2.0)) for x in t]) / (len(t) - 1)
    return features.withColumn("confidence", 1 / (1 + spread))


def alternatives(features: DataFrame) -> DataFrame:
    t = traits(features)
    t["calm"] = F.greatest(F.lit(0.0), t["calm"])
    for name, parts in ALTERNATIVES.items():
        score = [w * (1 - t[k[1:]] if k.startswith("-") else t[k]) for k, w in parts]
        features = features.withColumn(name, reduce(lambda a, b: a + b, score))
    return features
