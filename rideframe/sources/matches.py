"""Match results: JSON files or strings into tables, and the writers of requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideframe.storage import write_folders

#: Numbers of elevations, times and lengths may come as strings, so those are read as text and cast.
RUN = "struct<way_id:long,dir:int,edge_count:long,length_m:double>"
LEG = f"struct<annotation:struct<nodes:array<long>,distance:array<double>>,weight:double,duration:double,distance:double,runs:array<{RUN}>>"
MATCHING = f"struct<confidence:double,geometry:struct<type:string,coordinates:array<array<double>>>,legs:array<{LEG}>,weight_name:string,weight:double,duration:double,distance:double,route_nodes:array<long>>"
POINT = "struct<index:long,lat:double,lon:double,elv:string,elevation:string,ele:string,time:string,time_iso:string,extensions:array<struct<key:string,value:string>>>"
TRACEPOINT = f"struct<alternatives_count:int,waypoint_index:int,matchings_index:int,location:array<double>,name:string,gpx_list:array<{POINT}>>"
RESULT = f"struct<code:string,matchings:array<{MATCHING}>,tracepoints:array<{TRACEPOINT}>,route_nodes:array<long>>"


def parse_results(texts: DataFrame) -> DataFrame:
    """ride_id, code ('Error' where it is missing), matching (the first, or null), tracepoints, route_nodes of JSON texts (ride_id, json).

    route_nodes falls back to those of the first matching. Text that is no JSON gives nulls.
    """
    r = texts.withColumn("r", F.from_json("json", RESULT))
    first = F.get("r.matchings", F.lit(0))
    nodes = F.coalesce(F.when(F.size("r.route_nodes") > 0, F.col("r.route_nodes")), first["route_nodes"])
    return r.select("ride_id", F.coalesce("r.code", F.lit("Error")).alias("code"), first.alias("matching"), F.coalesce("r.tracepoints", F.array().cast(f"array<{TRACEPOINT}>")).alias("tracepoints"), nodes.alias("route_nodes"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``parse_results`` of every file of a folder; a ride is named by its file, or by what stands before a chunk's index."""
    raw = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.json$", "")
    return parse_results(raw.select(stem.alias("ride_id"), F.col("value").alias("json")))


def elevation(point: Column) -> Column:
    """The first of elv, elevation and ele that is there, as a number; 0 if it is none."""
    raw = F.coalesce(point["elv"], point["elevation"], point["ele"])
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def legs(results: DataFrame) -> DataFrame:
    """ride_id, leg_idx, distance, duration, weight, nodes, edge_dist of the first matching; missing numbers are 0."""
    x = results.select("ride_id", F.posexplode("matching.legs").alias("leg_idx", "l"))
    number = lambda c: F.coalesce(f"l.{c}", F.lit(0.0)).alias(c)
    return x.select("ride_id", "leg_idx", number("distance"), number("duration"), number("weight"), F.col("l.annotation.nodes").alias("nodes"), F.col("l.annotation.distance").alias("edge_dist"), F.col("l.runs").alias("runs"))


def runs(results: DataFrame) -> DataFrame:
    """ride_id, leg_idx, run_idx, way_id, dir, edge_count, length_m."""
    return legs(results).select("ride_id", "leg_idx", F.posexplode("runs").alias("run_idx", "r")).select("ride_id", "leg_idx", "run_idx", "r.*")


def tracepoints(results: DataFrame) -> DataFrame:
    """ride_id, seq, matched, waypoint_index, matchings_index, lon, lat, name, n_gpx; a null tracepoint is a row that isn't matched, with nulls."""
    x = results.select("ride_id", F.posexplode("tracepoints").alias("seq", "t"))
    return x.select("ride_id", "seq", F.col("t").isNotNull().alias("matched"), "t.waypoint_index", "t.matchings_index", F.get("t.location", F.lit(0)).alias("lon"), F.get("t.location", F.lit(1)).alias("lat"), "t.name", F.coalesce(F.size("t.gpx_list"), F.lit(0)).alias("n_gpx"))


def gpx_points(results: DataFrame) -> DataFrame:
    """ride_id, tracepoint_seq, i, lat, lon, elv, time of the points attached to tracepoints."""
    x = results.select("ride_id", F.posexplode("tracepoints").alias("tracepoint_seq", "t")).select("ride_id", "tracepoint_seq", F.posexplode("t.gpx_list").alias("i", "p"))
    return x.select("ride_id", "tracepoint_seq", "i", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), elevation(F.col("p")).alias("elv"), F.col("p.time").try_cast("long").alias("time"))


def missing_rides(results: DataFrame, rides: DataFrame) -> DataFrame:
    """ride_id of results without a ride of the same name, in whatever case."""
    low = lambda df: df.withColumn("k", F.lower(F.col("ride_id").cast("string")))
    return low(results).join(low(rides).select("k").distinct(), "k", "left_anti").select("ride_id").distinct()


#: What a matching service is asked for besides the chunk itself.
PARAMETERS = {"geometries": "geojson", "overview": "full", "steps": "false", "gaps": "ignore", "tidy": "true", "annotations": "nodes,distance"}
#: Columns of written payloads; ride_id is in the folder's name.
PAYLOAD = "chunk string, n long, coordinates_e6 string, timestamps string, radiuses string, ride_id long"


def match_requests(payloads: DataFrame, polyline: Column) -> DataFrame:
    """What a matching service is asked for each chunk: polyline6, parameters, timestamps and radiuses."""
    fixed = F.create_map(*[F.lit(x) for kv in PARAMETERS.items() for x in kv])
    own = F.create_map(F.lit("timestamps"), F.col("timestamps"), F.lit("radiuses"), F.col("radiuses"))
    return payloads.withColumns({"polyline6": polyline, "parameters": F.map_filter(F.map_concat(fixed, own), lambda _, v: v.isNotNull())})


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One folder a ride, JSON lines by chunk; rides are spread over tasks."""
    line = F.to_json(F.struct(*[c for c in payloads.columns if c != "ride_id"]))
    write_folders(payloads, path, "ride_id", line, ["chunk"], "json")


def read_payloads(spark: SparkSession, path: str, schema: str = PAYLOAD) -> DataFrame:
    """What ``write_payloads`` wrote."""
    return spark.read.schema(schema).json(path)


def write_matches(results: DataFrame, path: str) -> None:
    """Results with a matching under status=matched, the others under status=gap."""
    status = F.when(F.col("matching").isNull(), "gap").otherwise("matched")
    results.withColumn("status", status).write.partitionBy("status").mode("overwrite").json(path)


def read_matches(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What ``write_matches`` wrote, with status; ``columns`` is the schema of what was written."""
    return spark.read.schema(f"{columns}, status string").json(path)


def upsert_ways(ways: DataFrame) -> DataFrame:
    """(way_id, tags) of the last version of every way."""
    return ways.groupBy("way_id").agg(F.max_by("tags", "version").alias("tags"))
