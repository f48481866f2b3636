"""Readers of raw ride and map files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.functions import geo, text

TRKSEG = "trkpt array<struct<_lat:double,_lon:double,ele:double,time:string>>"
NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"


def read_gpx(spark: SparkSession, path: str, name: str = r"([^/]*)\.(?i:gpx)$") -> DataFrame:
    """ride_id, segment, i, seq, lat, lon, elv, time of all track segments, in file order.

    ride_id is what the first group of ``name`` finds in the file's path: its stem. Segments are numbered from 0 in
    their file, by the block they were read in and their order there, which is the file's whatever
    the splits; i counts the points of a segment and seq those of a file.
    """
    raw = spark.read.format("xml").option("rowTag", "trkseg").option("ignoreNamespace", True).schema(TRKSEG).load(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "trkpt")
    order = Window.partitionBy("file").orderBy("block", "row")
    before = F.coalesce(F.sum(F.coalesce(F.size("trkpt"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    raw = raw.select(F.coalesce(F.nullif(F.regexp_extract("file", name, 1), F.lit("")), F.regexp_extract("file", r"([^/]*)$", 1)).alias("ride_id"), (F.row_number().over(order) - 1).cast("long").alias("segment"), before.cast("long").alias("before"), "trkpt")
    rows = raw.select("ride_id", "segment", "before", F.posexplode("trkpt").alias("i", "p"))
    return rows.select("ride_id", "segment", "i", (F.col("before") + F.col("i")).alias("seq"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("elv"), F.try_to_timestamp(F.col("p.time")).alias("time"))


def read_gpx_extensions(spark: SparkSession, path: str) -> DataFrame:
    """ride_id, lat, lon, time, key, value: the readings of every track point, whatever they are nested in, by the last part of their name.

    Points are read as XML text, as their extensions have no fixed shape; what is flattened
    goes through ``units.extension_maps`` to canonical names.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.gpx$", "").alias("ride_id"), "value")
    points = raw.select("ride_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(<trkpt\b.*?</trkpt>)"), 1)).alias("i", "x"))
    bare = F.regexp_replace(F.regexp_replace("x", r"<(/?)[A-Za-z0-9_.-]+:", "<$1"), r"\s[A-Za-z0-9_.-]+:([A-Za-z0-9_.-]+=)", " $1")
    told = points.withColumn("leaves", text.json_leaves(text.xml_json(F.regexp_extract(bare, r"(?s)(<extensions\b.*</extensions>)", 1))))
    number = lambda name: F.regexp_extract("x", name + r"\s*=\s*[\"']([^\"']*)", 1).try_cast("double")
    return told.select("ride_id", "i", number("lat").alias("lat"), number("lon").alias("lon"), F.posexplode("leaves").alias("place", "leaf")).select("ride_id", "i", "lat", "lon", "place", "leaf.key", "leaf.value")


def read_osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id, lat, lon of nodes whose place is on the globe."""
    raw = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return raw.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).where("abs(lat) <= 90 and abs(lon) <= 180")


def way_edges(ways: DataFrame, nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """u, v, way_id, dir, seq, len_m, both ways, of the ways all of whose nodes have a place; other ways keep their tags but have no edges.

    Whole ways are sorted in ``parts`` partitions, else in as many as Spark chooses.
    """
    placed = ways.select("way_id", F.posexplode("nodes").alias("seq", "node_id")).join(nodes, "node_id", "left")
    if parts:
        placed = placed.repartition(parts, "way_id")
    w = Window.partitionBy("way_id").orderBy("seq")
    step = placed.withColumns({"v": F.lead("node_id").over(w), "vlat": F.lead("lat").over(w), "vlon": F.lead("lon").over(w), "whole": F.every(F.col("lat").isNotNull()).over(Window.partitionBy("way_id"))})
    step = step.where("whole and v is not null").withColumn("len_m", geo.haversine(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon")))
    ahead, back = F.struct(F.col("node_id").alias("u"), F.col("v").alias("v"), F.lit(1).alias("dir")), F.struct(F.col("v").alias("u"), F.col("node_id").alias("v"), F.lit(-1).alias("dir"))
    return step.select("way_id", "seq", "len_m", F.explode(F.array(ahead, back)).alias("e")).select("e.u", "e.v", "way_id", "e.dir", "seq", "len_m").distinct()


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, nodes and tags of ways of two nodes or more."""
    raw = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path).where(F.size("nd") >= 2)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"])))
    return raw.select(F.col("_id").alias("way_id"), F.transform("nd", lambda x: x["_ref"]).alias("nodes"), tags.alias("tags"))


def chunk_index(name: F.Column) -> F.Column:
    """The number that ends a file name; a name without one is an error, as its place in the ride is unknown."""
    digits = F.regexp_extract(name, r"_(\d+)\.json$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no index in the name "), name)).cast("int"))


def read_match_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Match chunks with their index from the file name."""
    return spark.read.schema(schema).json(path).withColumn("chunk_idx", chunk_index(F.col("_metadata.file_name")))
