"""Ride-shaped tables over the driver tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trackpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return e.select(F.col("user_id").alias("ride_id"), "event_id", seq.alias("seq"), (51.5 + F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 10000.0).alias("lat"), (-0.12 + F.col("value") / 10000.0).alias("lon"), F.col("value").alias("elv"), F.col("value").alias("power_w"), t.alias("t_us"))


#: So many rows of a table make a partition, however large the table is, so that no task sorts more.
PART_ROWS = 250_000


def by_ride(rows: DataFrame, n: int) -> DataFrame:
    """Rows of whole rides together, in partitions of about PART_ROWS of the ``n`` rows; few rows are left to what reads them."""
    parts = n // PART_ROWS
    return rows.repartition(parts, "ride_id") if parts > 2 else rows


def path_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """How many partitions of about PART_ROWS the rows of all paths make; None for few."""
    parts = read(spark, sf_dir, "lineitem").count() // PART_ROWS
    return parts if parts > 2 else None


_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def node_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("ride_id").orderBy(*_TIES)).cast("long") - 1
    items = read(spark, sf_dir, "lineitem")
    # named before it is shuffled, so that what follows by ride needs no other shuffle
    rows = by_ride(items.select(F.col("l_orderkey").alias("ride_id"), *_TIES), items.count())
    return rows.select("ride_id", pos.alias("pos"), F.col("l_suppkey").alias("node_id"), F.col("l_partkey").alias("way_id"), F.col("l_quantity").alias("len_m"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, pairs, rest: _case(F.col(c), pairs, rest)
    p = read(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("way_id"),
        pick("p_type", {"LARGE": "primary", "MEDIUM": "secondary", "STANDARD": "tertiary", "SMALL": "residential", "PROMO": "cycleway"}, "primary_link").alias("highway"),
        _case(size % 3, {0: "gravel", 1: "asphalt"}, "concrete").alias("surface"),
        _case(size % 4, {0: "bad", 1: "good"}, "excellent").alias("smoothness"),
        size.alias("maxspeed"),
    )


def _case(value, pairs: dict, rest: str):
    out = F.lit(rest)
    for k, v in reversed(pairs.items()):
        out = F.when(value == k, v).otherwise(out)
    return out


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = node_path(spark, sf_dir).join(ways(spark, sf_dir), "way_id", "left").select("ride_id", "pos", "way_id", "len_m", "highway", "surface", "smoothness", "maxspeed")
    return by_ride(rows, read(spark, sf_dir, "lineitem").count())


def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _case(F.col("event_type"), {"click": "gpxtpx:HR", "view": "ns3.Cad", "purchase": "power", "signup": "temp_f"}, "speed_kph")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ride_id"), key.alias("ext_key"), F.col("value").alias("ext_value"))


#: Null where a coordinate is null: least() alone would skip it and give half the way around the globe.
HAV = "case when {a} + {b} + {c} + {d} is not null then 2 * 6371000.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) end"

TRACK = """trackpoints as (
  select user_id as ride_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq,
    51.5e0 + cast(regexp_extract(props, '([0-9]+)', 1) as double) / 10000.0e0 as lat, -0.12e0 + value / 10000.0e0 as lon,
    value as elv, value as power_w, epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00') as t_us from events)"""

SIGNAL = TRACK + f""", prev as (
  select *, lag(lat) over w as plat, lag(lon) over w as plon, lead(lat) over w as nlat, lead(lon) over w as nlon, lag(t_us) over w as pt
  from trackpoints window w as (partition by ride_id order by seq)
), stepped as (select *, coalesce(cast(round(1000 * {HAV.format(a='plat', b='plon', c='lat', d='lon')}) as bigint), 0) as step_mm from prev
), sig as (select *, cast(sum(step_mm) over (partition by ride_id order by seq rows unbounded preceding) as bigint) as cum_mm from stepped)"""

HEADINGS = SIGNAL + """, own as (select *, atan2(nlat - lat, nlon - lon) as own from sig
), head as (select *, coalesce(own, lag(own) over w, 0.0e0) as heading,
  case when own is null or lag(own) over w is null then 0.0e0 else atan2(sin(own - lag(own) over w), cos(own - lag(own) over w)) end as delta
  from own window w as (partition by ride_id order by seq))"""
SPEED = "coalesce(step_mm / 1000.0e0 / greatest(1e-3, (t_us - pt) / 1e6), 0.0e0)"
GRADED = HEADINGS + """, graded as (select *, arg_max(elv, seq) over g - arg_min(elv, seq) over g as rise, (max(cum_mm) over g - min(cum_mm) over g) / 1000.0e0 as base
  from head window g as (partition by ride_id order by cum_mm range between 2000000 preceding and 2000000 following))"""
GRADIENT = "round(case when base > 1e-6 then 100 * rise / base else 0.0e0 end, 4)"

PATH = """node_path as (
  select l_orderkey as ride_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as pos,
    l_suppkey as node_id, l_partkey as way_id, l_quantity as len_m from lineitem)"""

WAYS = """ways as (select p_partkey as way_id,
  case p_type when 'LARGE' then 'primary' when 'MEDIUM' then 'secondary' when 'STANDARD' then 'tertiary' when 'SMALL' then 'residential' when 'PROMO' then 'cycleway' else 'primary_link' end as highway,
  case when p_size % 3 = 0 then 'gravel' when p_size % 3 = 1 then 'asphalt' else 'concrete' end as surface,
  case when p_size % 4 = 0 then 'bad' when p_size % 4 = 1 then 'good' else 'excellent' end as smoothness, p_size as maxspeed from part)"""

EDGES = PATH + """, pairs as (select *, lead(node_id) over (partition by ride_id order by pos) as nxt from node_path
), edges as (select distinct node_id as u, nxt as v, way_id, cast(1 as int) as dir, len_m from pairs where nxt <> node_id
  union select distinct nxt, node_id, way_id, cast(-1 as int), len_m from pairs where nxt <> node_id)"""

SECTIONS = PATH + ", " + WAYS + ", sections as (select ride_id, pos, way_id, len_m, highway, surface, smoothness, maxspeed from node_path left join ways using (way_id))"
