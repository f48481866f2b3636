"""Registered queries over match results, raw text, way rules, proposals, features, zones, libraries and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.catalogue import COSTS, FEATURES, GRADED, KAPPA, SPEED, segment_features
from rideframe.catalogue_routes import CHUNK, NODES, OVERLAP, chunks, listed, nodes
from rideframe.catalogue_rules import tagged, tagged_sql
from rideframe.functions import text, units
from rideframe.operators import access, matching, network, profile, routes, scoring, segments, signal
from rideframe.plans import adapters as A
from rideframe.registry import query
from rideframe.sources import matches, readers
from rideframe.storage import written_files


# ---- files: rides and maps are written as XML to the shared folder, then scanned

def xml_files(lines: DataFrame, root: str, name: str) -> str:
    """Files of one root element around the elements of a group: lines of (part, line)."""
    whole = F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("line"), ""), F.lit(f"</{root}>"))
    return written_files(lines.groupBy("part").agg(whole.alias("text")).select("text"), name)


@query(f"with {A.TRACK} select cast(seq % 50 as int) as i, lat, lon, elv, 1704067200 + cast(floor(t_us / 1e6) as bigint) as epoch_s from trackpoints")
def gpx_scan(spark, d):
    """Points of track segments of 50 points, by their place in the segment; the written files have no ride's name."""
    stamp = F.expr("date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, floor(t_us / 1e6)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    point = F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele><time>%s</time></trkpt>', *[F.col(c).cast("string") for c in ("lat", "lon", "elv")], stamp)
    segment = F.concat(F.lit("<trkseg>"), F.array_join(routes.ordered("seq", point), ""), F.lit("</trkseg>"))
    lines = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 50)).agg(segment.alias("line"))
    back = readers.read_gpx(spark, xml_files(lines.withColumn("part", F.floor(F.col("ride_id") / 10)), "gpx", "gpx"))
    return back.select("i", "lat", "lon", "elv", F.unix_timestamp("time").alias("epoch_s"))


def osm_nodes(spark, d) -> DataFrame:
    line = F.format_string('<node id="%d" lat="%s" lon="%s"><tag k="a" v="b"/></node>', "node_id", F.col("nlat").cast("string"), F.col("nlon").cast("string"))
    placed = nodes(spark, d).where("node_id % 97 <> 0").select(F.floor(F.col("node_id") / 1000).alias("part"), line.alias("line"))
    return readers.read_osm_nodes(spark, xml_files(placed, "osm", "nodes"))


@query(f"with {NODES} select node_id, nlat as lat, nlon as lon from nodes where node_id % 97 <> 0")
def osm_nodes_scan(spark, d):
    return osm_nodes(spark, d)


def osm_ways(spark, d) -> DataFrame:
    refs = F.array_join(routes.ordered("pos", F.format_string('<nd ref="%d"/>', "node_id")), "")
    line = F.format_string('<way id="%d">%s<tag k="highway" v="kind%d"/></way>', "ride_id", "refs", F.col("ride_id") % 3)
    lines = A.node_path(spark, d).groupBy("ride_id").agg(refs.alias("refs")).select(F.floor(F.col("ride_id") / 1000).alias("part"), line.alias("line"))
    return readers.read_osm_ways(spark, xml_files(lines, "osm", "ways"))


@query(f"with {A.PATH} select ride_id as way_id, array_to_string(list(node_id order by pos), ';') as nodes, 'kind' || (ride_id % 3) as highway from node_path group by ride_id having count(*) >= 2")
def osm_ways_scan(spark, d):
    return osm_ways(spark, d).select("way_id", listed(F.col("nodes")).alias("nodes"), F.col("tags")["highway"].alias("highway"))


@query(f"""with {NODES}, {A.PATH}, l as (select p.ride_id as way_id, cast(pos as int) as seq, p.node_id as a, lead(p.node_id) over w as b, nlat as alat, nlon as alon, lead(nlat) over w as blat, lead(nlon) over w as blon, bool_and(p.node_id % 97 <> 0) over (partition by ride_id) as whole from node_path p left join nodes n using (node_id) window w as (partition by ride_id order by pos)
), e as (select *, round({A.HAV.format(a='alat', b='alon', c='blat', d='blon')}, 3) as len_m from l where whole and b is not null) select a as u, b as v, way_id, 1::int as dir, seq, len_m from e union select b, a, way_id, (-1)::int, seq, len_m from e""")
def osm_way_edges(spark, d):
    """Edges both ways of scanned ways all of whose nodes have a place."""
    return readers.way_edges(osm_ways(spark, d), osm_nodes(spark, d), A.path_parts(spark, d)).withColumn("len_m", F.round("len_m", 3))


# ---- match results: written as JSON from the rides, then read back

def results(spark, d) -> DataFrame:
    """Match results of every ride as a service would send them: legs of 20 points, every fifth ride without a matching, odd elevations."""
    p = signal.with_distance(A.trackpoints(spark, d)).withColumn("leg", F.floor(F.col("seq") / 20).cast("long"))
    leg = p.groupBy("ride_id", "leg").agg((F.sum("step_mm") / 1000.0).alias("distance"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("duration"), F.count("*").alias("n"), F.min("seq").alias("first"))
    run = F.array(F.struct(F.col("leg").alias("way_id"), F.lit(1).alias("dir"), F.col("n").alias("edge_count"), F.col("distance").alias("length_m")))
    legs = leg.withColumn("l", F.struct(F.struct(F.sequence("first", F.col("first") + F.col("n") - 1).alias("nodes")).alias("annotation"), "distance", "duration", F.col("duration").alias("weight"), run.alias("runs")))
    legs = legs.groupBy("ride_id").agg(routes.ordered("leg", F.col("l")).alias("legs"))
    value = F.round(F.col("elv"), 2).cast("string")
    point = F.struct("lat", "lon", F.when(F.col("seq") % 4 == 0, value).alias("elv"), F.when(F.col("seq") % 4 == 1, value).alias("elevation"), F.when(F.col("seq") % 4 == 2, value).when(F.col("seq") % 8 == 3, "none").alias("ele"), F.floor(F.col("t_us") / 1e6).alias("time"))
    at = F.when(F.col("elv") > 100, F.struct(F.lit(0).alias("alternatives_count"), (F.sum(F.when(F.col("elv") > 100, 1).otherwise(0)).over(signal.so_far()) - 1).alias("waypoint_index"), F.lit(0).alias("matchings_index"), F.array("lon", "lat").alias("location"), F.lit("road").alias("name"), F.array(point).alias("gpx_list")))
    points = p.withColumn("t", at).groupBy("ride_id").agg(routes.ordered("seq", F.col("t")).alias("tracepoints"))
    found = F.when(F.col("ride_id") % 5 != 0, F.array(F.struct(F.lit(0.5).alias("confidence"), "legs", F.lit("duration").alias("weight_name"), F.array(F.col("ride_id"), F.lit(7)).alias("route_nodes"))))
    r = legs.join(points, "ride_id").select("ride_id", F.to_json(F.struct(F.when(F.col("ride_id") % 7 != 0, "Ok").alias("code"), found.alias("matchings"), "tracepoints", F.when(F.col("ride_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("route_nodes")), {"ignoreNullFields": "false"}).alias("json"))
    return matches.parse_results(r)


@query(f"with {A.TRACK} select distinct ride_id, case when ride_id % 7 <> 0 then 'Ok' else 'Error' end as code, ride_id % 5 <> 0 as matched, case when ride_id % 2 = 0 then '1;2' when ride_id % 5 <> 0 then ride_id::varchar || ';7' end as route_nodes from trackpoints")
def match_results(spark, d):
    """Code, first matching and route nodes of JSON results, with their fallbacks."""
    return results(spark, d).select("ride_id", "code", F.col("matching").isNotNull().alias("matched"), listed(F.col("route_nodes")).alias("route_nodes"))


LEGS = A.SIGNAL + ", legs as (select ride_id, cast(seq // 20 as int) as leg_idx, sum(step_mm) / 1000.0e0 as distance, (max(t_us) - min(t_us)) / 1e6 as duration, count(*) as n from sig where ride_id % 5 <> 0 group by all)"


@query(f"with {LEGS} select ride_id, leg_idx, round(distance, 3) as distance, round(duration, 3) as duration, n as n_nodes from legs")
def match_legs(spark, d):
    return matches.legs(results(spark, d)).select("ride_id", "leg_idx", F.round("distance", 3).alias("distance"), F.round("duration", 3).alias("duration"), F.size("nodes").cast("long").alias("n_nodes"))


@query(f"with {LEGS} select ride_id, leg_idx, 0::int as run_idx, leg_idx::bigint as way_id, 1::int as dir, n as edge_count, round(distance, 3) as length_m from legs")
def match_runs(spark, d):
    return matches.runs(results(spark, d)).withColumn("length_m", F.round("length_m", 3))


@query(f"with {LEGS} select ride_id, round(sum(distance), 3) as distance, round(sum(duration), 3) as duration, round(sum(duration), 3) as weight, count(*) as n_legs from legs group by ride_id")
def leg_totals(spark, d):
    """Distance, duration and weight of a route, summed over its legs."""
    total = [F.round(F.sum(c), 3).alias(c) for c in ("distance", "duration", "weight")]
    return matches.legs(results(spark, d)).groupBy("ride_id").agg(*total, F.count("*").alias("n_legs"))


MATCHED = A.TRACK + ", tp as (select *, elv > 100 as matched, case when elv > 100 then sum((elv > 100)::int) over (partition by ride_id order by seq) - 1 end as wp from trackpoints)"


@query(f"with {MATCHED} select ride_id, cast(seq as int) as tracepoint_seq, lat, lon, case when seq % 4 < 3 then round(elv, 2) else 0.0e0 end as elv, cast(floor(t_us / 1e6) as bigint) as time from tp where matched")
def match_gpx_points(spark, d):
    """Points attached to tracepoints; the elevation is the first spelling that is there, and 0 if it is no number."""
    return matches.gpx_points(results(spark, d)).select("ride_id", "tracepoint_seq", "lat", "lon", "elv", "time")


@query(f"with {MATCHED}, l as (select distinct ride_id, cast(seq // 20 as int) as leg from trackpoints where ride_id % 5 <> 0) select tp.ride_id, cast(seq as int) as seq, l.leg as leg_idx from tp left join l on l.ride_id = tp.ride_id and l.leg = tp.wp where matched")
def tracepoint_leg(spark, d):
    """The leg that starts at a matched tracepoint: the one of its waypoint index, or null past the last."""
    r = results(spark, d)
    t = matches.tracepoints(r).where("matched").select("ride_id", "seq", F.col("waypoint_index").alias("leg"))
    legs = matches.legs(r).select("ride_id", F.col("leg_idx").alias("leg"), "leg_idx")
    return t.join(legs, ["ride_id", "leg"], "left").select("ride_id", "seq", "leg_idx")


@query(f"with {MATCHED}, s as (select ride_id, count(*) as points, count(*) filter (not matched) as unmatched, count(*) filter (matched) as with_gpx, count(*) filter (matched) as gpx_total, string_agg(case when matched then wp::varchar else '-' end, ';' order by seq) filter (seq < 3) as samples from tp group by ride_id), l as (select ride_id, count(distinct seq // 20) as legs from trackpoints where ride_id % 5 <> 0 group by ride_id) select s.*, coalesce(legs, 0) as legs from s left join l using (ride_id)")
def result_summary(spark, d):
    """Legs, points, unmatched ones, attached points and the first three tracepoints of every result; counts cover all tracepoints."""
    r = results(spark, d)
    t = matches.tracepoints(r).groupBy("ride_id").agg(F.count("*").alias("points"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if(F.col("n_gpx") > 0).alias("with_gpx"), F.sum(F.col("n_gpx").cast("long")).alias("gpx_total"), F.array_join(routes.ordered("seq", F.when(F.col("seq") < 3, F.coalesce(F.col("waypoint_index").cast("string"), F.lit("-")))), ";").alias("samples"))
    return t.join(r.select("ride_id", F.coalesce(F.size("matching.legs"), F.lit(0)).cast("long").alias("legs")), "ride_id")


@query(f"with {A.TRACK} select distinct ride_id from trackpoints where ride_id % 6 = 0")
def missing_rides(spark, d):
    """Results without a ride file of their name."""
    r = A.trackpoints(spark, d).select("ride_id").distinct()
    return matches.missing_rides(r, r.where("ride_id % 6 <> 0"))


@query(f"with {MATCHED}, m as (select *, sum(case when t_us - pt > 3600000000 then 1 else 0 end) over (partition by ride_id order by seq) as matching from (select *, lag(t_us) over (partition by ride_id order by seq) as pt from tp)), k as (select *, row_number() over (partition by ride_id, matching order by seq) - 1 as own from m where matched), n as (select *, lead(seq) over w as seq1, lead(matching) over w as m1, lead(own) over w as own1 from k window w as (partition by ride_id order by seq)) select ride_id, own::bigint as leg_idx, seq, seq1::bigint as next_seq from n where m1 = matching and own1 = own + 1")
def waypoint_pairs(spark, d):
    """Neighbours among the matched tracepoints that are of one matching and follow each other: the ends of a leg."""
    p = signal.split_on_gaps(A.trackpoints(spark, d), 3_600_000_000).where("elv > 100")
    p = p.withColumn("own", F.row_number().over(Window.partitionBy("ride_id", "track_id").orderBy("seq")).cast("long") - 1)
    ahead = lambda c: F.lead(c).over(signal.ride())
    p = p.withColumns({"next_seq": ahead("seq"), "m1": ahead("track_id"), "own1": ahead("own")})
    return p.where("m1 = track_id and own1 = own + 1").select("ride_id", F.col("own").alias("leg_idx"), "seq", "next_seq")


# ---- raw text

_RAW = "case event_id % 6 when 0 then '  ' || event_id || ' ' when 1 then '-' || (event_id % 50) || '.5' when 2 then ' ' when 3 then 'abc ' || event_id when 4 then '1e' || (event_id % 5) end"


def raw_text(spark, d) -> DataFrame:
    i = F.col("event_id")
    made = F.when(i % 6 == 0, F.concat(F.lit("  "), i, F.lit(" "))).when(i % 6 == 1, F.concat(F.lit("-"), i % 50, F.lit(".5"))).when(i % 6 == 2, " ").when(i % 6 == 3, F.concat(F.lit("abc "), i)).when(i % 6 == 4, F.concat(F.lit("1e"), i % 5))
    return A.read(spark, d, "events").select("event_id", made.alias("raw"))


@query(f"with r as (select event_id, nullif(trim({_RAW}), '') as t from events) select event_id, case when t is null then 'null' when event_id % 6 = 0 then 'int' when event_id % 6 = 3 then 'text' else 'float' end as kind, case when event_id % 6 = 0 then t::bigint end as whole, case when event_id % 6 in (1, 4) then t::double end as real, case when event_id % 6 = 3 then t end as word from r")
def xml_coerce(spark, d):
    return raw_text(spark, d).select("event_id", text.coerced(F.col("raw")).alias("x")).select("event_id", "x.*")


@query("""select event_id, '{"hr": [' || (event_id % 90) || ', 7], "ext": {"power": ' || (event_id % 300) || '.5, "note": "' || event_type || '", "none": null}}' as json from events""")
def xml_dict(spark, d):
    """An XML element of any shape as JSON: names without their name space, repeated ones as lists, text coerced."""
    i = F.col("event_id")
    xml = F.concat(F.lit('<e xmlns:g="u"><g:hr> '), i % 90, F.lit(" </g:hr><hr>7</hr><ext><g:power>"), i % 300, F.lit(".5</g:power><note>"), F.col("event_type"), F.lit("</note><none> </none></ext></e>"))
    return A.read(spark, d, "events").select("event_id", text.xml_json(xml).alias("json"))


@query("select event_id, unnest(['0=' || (event_id % 90), '1=7', 'power=' || (event_id % 300) || '.5', 'note=' || event_type]) as leaf from events")
def json_leaves(spark, d):
    """Leaves at any depth by the last part of their path, without nulls."""
    leaves = text.leaf_rows(xml_dict(spark, d), ["event_id"], "json")
    return leaves.select("event_id", F.concat_ws("=", "key", "value").alias("leaf"))


@query("select event_id, case when event_id % 3 = 0 then 1::int end as line, case when event_id % 3 = 0 then cast(length(props) as int) end as col from events")
def json_errors(spark, d):
    """Where JSON that lost its last character stops to parse; nulls where it is whole."""
    e = A.read(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 3 == 0, F.col("props").substr(F.lit(1), F.length("props") - 1)).otherwise(F.col("props")))
    return e.select("event_id", text.json_error(F.col("t")).alias("x")).select("event_id", "x.line", "x.col")


@query("select event_id, case event_id % 4 when 0 then epoch_us(ts) // 1000000 when 1 then epoch_us(ts) // 1000000 - 7200 when 2 then epoch_us(ts) // 1000000 end as epoch_s from events")
def iso_offsets(spark, d):
    """ISO times with Z, with an offset, with none, and text that is no time."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("event_id") % 4
    made = F.when(i == 0, F.concat(stamp, F.lit("Z"))).when(i == 1, F.concat(stamp, F.lit("+02:00"))).when(i == 2, stamp).otherwise("yesterday")
    return A.read(spark, d, "events").select("event_id", text.iso_epoch(made).alias("epoch_s"))


_CANON = "case event_type when 'click' then 'hr_bpm' when 'view' then 'cad_rpm' when 'purchase' then 'power_w' when 'signup' then 'temp_c' else 'speed_mps' end"
_VALUE = "case event_type when 'click' then trunc(value) when 'view' then trunc(value) when 'signup' then (value - 32.0e0) * 5.0e0 / 9.0e0 when 'purchase' then value else value / 3.6e0 end"


@query(f"with f as (select user_id as ride_id, {_CANON} as c, min_by({_VALUE}, event_id) as v from events group by all) select ride_id, string_agg(c || '=' || cast(floor(v * 100) as bigint), ';' order by c) as extensions from f group by ride_id")
def extension_maps(spark, d):
    """One map of canonical readings per ride; the first reading of a name wins."""
    m = units.extension_maps(A.extensions(spark, d), units.rules_table(spark), "ride_id", "event_id", "ext_key", "ext_value")
    told = F.transform(F.map_entries("extensions"), lambda e: F.concat_ws("=", e["key"], F.floor(e["value"] * 100).cast("string")))
    return m.select("ride_id", F.array_join(F.array_sort(told), ";").alias("extensions"))


@query(f"select event_id, {_CANON} as canonical from events where not coalesce(({_CANON} = 'power_w' and abs({_VALUE}) > 90) or ({_CANON} = 'cad_rpm' and abs({_VALUE}) > 80) or ({_CANON} = 'hr_bpm' and abs({_VALUE}) > 70), false)")
def sensor_ceilings(spark, d):
    """Readings at or under the ceiling of their sensor (here low ones, as the values of the table are)."""
    r = units.canonical_readings(A.extensions(spark, d), units.rules_table(spark), "ext_key", "ext_value")
    return units.under_ceilings(r, {"power_w": 90.0, "cad_rpm": 80.0, "hr_bpm": 70.0}).select("event_id", "canonical")


@query(f"with {A.TRACK}, g as (select *, case when event_id % 9 = 0 then 0.0e0 when event_id % 9 = 1 then null else power_w end as p from trackpoints), n as (select *, last_value(nullif(p, 0) ignore nulls) over (partition by ride_id order by seq rows unbounded preceding) as a, first_value(nullif(p, 0) ignore nulls) over (partition by ride_id order by seq rows between current row and unbounded following) as b from g) select ride_id, seq, round(coalesce(nullif(p, 0), (a + b) / 2, a, b), 6) as power_w from n")
def gap_fill(spark, d):
    i = F.col("event_id") % 9
    p = A.trackpoints(spark, d).withColumn("power_w", F.when(i == 0, 0.0).when(i == 1, F.lit(None)).otherwise(F.col("power_w")))
    return signal.fill_gaps(p, "power_w").select("ride_id", "seq", F.round("power_w", 6).alias("power_w"))


# ---- ways

ROAD_TAGS = {
    "bridge": ("p_partkey", 31, {0: "movable", 1: "yes"}), "route": ("p_partkey", 29, {0: "ferry", 1: "bus"}), "railway": ("p_partkey", 23, {0: "platform", 1: "tram", 2: "rail"}), "amenity": ("p_partkey", 19, {0: "parking", 1: "cafe"}),
    "man_made": ("p_partkey", 17, {0: "pier"}), "public_transport": ("p_partkey", 37, {0: "platform"}), "access": ("p_size", 6, {0: "private", 1: "permissive"}), "bicycle": ("p_partkey", 13, {0: "dismount", 1: "no", 2: "yes"}),
    "surface": ("p_size", 5, {0: "gravel", 1: "asphalt", 2: "mud"}), "maxspeed": ("p_size", 8, {0: "20", 1: "50 km"}), "foot": ("p_partkey", 5, {0: "no", 1: "yes"}), "width": ("p_size", 9, {0: "0.8", 1: "2.5 m"}), "cargo_bike": ("p_partkey", 11, {0: "no"}),
}
_CLASS = "case p_type when 'LARGE' then 'primary' when 'MEDIUM' then 'secondary' when 'STANDARD' then 'footway' when 'SMALL' then 'residential' when 'PROMO' then '' else 'motorway' end"


def roads(spark, d, tags: dict = ROAD_TAGS) -> DataFrame:
    kind = A._case(F.col("p_type"), {"LARGE": "primary", "MEDIUM": "secondary", "STANDARD": "footway", "SMALL": "residential", "PROMO": ""}, "motorway")
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("way_id"), kind.alias("highway"), tagged(tags))


def _roads_sql(tags: dict = ROAD_TAGS) -> str:
    return f"""r as (select p_partkey as way_id, {_CLASS} as highway, {tagged_sql(tags)} from part
), a as (select *, coalesce(bicycle, access) as acc, coalesce(coalesce(bicycle, access) in ('yes', 'permissive', 'designated'), false) as is_open from r where highway <> '' or route is not null or railway is not null or amenity is not null or man_made is not null or public_transport is not null or bridge is not null
), f as (select *, case when bridge = 'movable' then 'bridge' when route = 'ferry' then 'ferry' when railway = 'platform' or public_transport = 'platform' then 'platform' when is_open and railway = 'tram' then 'railway' when amenity = 'parking' then 'parking' when highway in ('primary', 'secondary', 'residential') then 'class' when is_open then 'open' end as rule from a where not coalesce(acc in ('no', 'private'), false)
), s as (select *, case rule when 'bridge' then 5.0e0 when 'ferry' then 5.0e0 when 'platform' then 4.0e0 when 'railway' then 10.0e0 when 'parking' then 10.0e0 when 'class' then case highway when 'primary' then 60.0e0 when 'secondary' then 37.5e0 else 27.5e0 end when 'open' then 25.0e0 end as raw,
  case rule when 'ferry' then 'ferry' when 'railway' then 'train' when null then null else 'cycling' end as base_mode, coalesce(rule not in ('ferry', 'railway'), false) as may_push, case surface when 'gravel' then 10.0e0 when 'asphalt' then 100.0e0 when 'mud' then 2.0e0 end as sv, case maxspeed when '20' then 20.0e0 when '50 km' then 50.0e0 end as mv from f
), v as (select *, case when rule in ('ferry', 'railway') then raw when rule is not null then least(raw, sv, mv) end as base_speed from s
), w as (select *, case when coalesce(foot, '') <> 'no' then case when highway = 'footway' then 4.0e0 when man_made = 'pier' then 4.0e0 when foot = 'yes' or may_push then 4.0e0 end end as walk from v)"""


@query(f"with {_roads_sql()} select way_id, rule, base_speed, may_push from w")
def way_speeds(spark, d):
    """Routability, access and the cascade of speeds with the ceilings of surface and maximum."""
    return access.way_speeds(roads(spark, d)).select("way_id", "rule", "base_speed", "may_push")


@query(f"with {_roads_sql()} select way_id, case when coalesce(width = '0.8', false) or coalesce(cargo_bike = 'no', false) then 'inaccessible' when bicycle = 'dismount' then 'pushing' when base_speed is not null then base_mode when walk is not null then 'pushing' else 'inaccessible' end as mode, case when bicycle = 'dismount' then 4.0e0 else coalesce(base_speed, walk, 0.0e0) end as speed from w")
def way_pushing(spark, d):
    """Pushing where riding is impossible, dismounting, and ways too narrow or shut to cargo bikes."""
    return access.pushed(access.way_speeds(roads(spark, d)), width=1.0, cargo=True).select("way_id", "mode", "speed")


@query(f"with {A.SIGNAL}, t as (select ride_id, seq, elv, case when plat is null or nlat is null then 0.0e0 else degrees(atan2(sin(atan2(nlat - lat, nlon - lon) - atan2(lat - plat, lon - plon)), cos(atan2(nlat - lat, nlon - lon) - atan2(lat - plat, lon - plon)))) end as angle from sig) select ride_id, seq, round({profile.turn_cost_sql('angle')} + case when seq % 4 = 0 then 2.0e0 else 0.0e0 end + case when seq % 3 = 0 and seq % 5 = 0 then 30.0e0 else 0.0e0 end, 4) as weight from t")
def turn_weight(spark, d):
    """Turn costs with traffic lights and changes of mode."""
    p = signal.with_heading(A.trackpoints(spark, d))
    mode = lambda c: F.when(c, "cycling").otherwise("pushing")
    cost = profile.turn_weight(F.degrees("heading_delta"), F.col("seq") % 4 == 0, mode(F.col("seq") % 3 == 0), mode(F.col("seq") % 5 != 0))
    return p.select("ride_id", "seq", F.round(cost, 4).alias("weight"))


@query("with r as (select p_partkey as way_id, case p_partkey % 4 when 0 then 'cafe' when 1 then 'drinking_water' when 2 then 'bank' end as amenity, case p_size % 3 when 0 then 'forest' when 1 then 'landfill' end as landuse from part) select way_id, (coalesce(case amenity when 'cafe' then 1 when 'drinking_water' then 2 when 'bank' then -1 end, 0) + coalesce(case landuse when 'forest' then 1 when 'landfill' then -2 end, 0))::int as polarity from r")
def tag_polarity(spark, d):
    tags = {"amenity": ("p_partkey", 4, {0: "cafe", 1: "drinking_water", 2: "bank"}), "landuse": ("p_size", 3, {0: "forest", 1: "landfill"})}
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("way_id"), tagged(tags)).select("way_id", scoring.tag_polarity(F.col("tags")).alias("polarity"))


@query("with v as (select l_partkey as way_id, l_shipdate as version, l_returnflag as tags from lineitem) select way_id, max(version) as version, (select min(tags) from v w where w.way_id = v.way_id and w.version = max(v.version)) as tags from v group by way_id")
def way_upsert(spark, d):
    """The last version of every way; of versions of one day the least tags."""
    v = A.read(spark, d, "lineitem").select(F.col("l_partkey").alias("way_id"), F.col("l_shipdate").alias("version"), F.col("l_returnflag").alias("tags"))
    least = v.groupBy("way_id", "version").agg(F.min("tags").alias("tags"))
    return matches.upsert_ways(least).join(v.groupBy("way_id").agg(F.max("version").alias("version")), "way_id").select("way_id", "version", "tags")


# ---- signals, proposals, features, zones

@query(f"with {KAPPA} select ride_id, round(sum(greatest(kappa - 0.01e0, 0.0e0) * step_mm) / nullif(sum(step_mm), 0)::double, 6) as cbi from kap group by ride_id")
def curvature_burden_index(spark, d):
    p = signal.curvature(signal.with_distance(A.trackpoints(spark, d)))
    return signal.curvature_burden(p, 0.01).select("ride_id", F.round("cbi", 6).alias("cbi"))


@query(f"""with {GRADED}, pts as (select ride_id, seq, cum_mm / 1000.0e0 as at, case when base > 1e-6 then 100 * rise / base else 0.0e0 end as g from graded), w as (select a.ride_id, a.seq, exp(-0.5e0 * pow((b.at - a.at) / (5000.0e0 / 3), 2)) * (1 + 0.6e0 * least(abs(b.g) / 10, 1)) as w, b.g from pts a join pts b on a.ride_id = b.ride_id and abs(a.at - b.at) <= 5000)
select ride_id, seq, round(sum(w * g) / sum(w), 4) as smoothed from w group by ride_id, seq""")
def smoothed_gradient(spark, d):
    """Gaussian mean of the gradient within reach, steep points weighing more."""
    p = signal.with_gradient(signal.with_distance(A.trackpoints(spark, d)), 2000)
    return signal.smoothed_gradient(p, 5000.0).withColumn("smoothed", F.round("smoothed", 4))


PROPOSED = f"""{GRADED}, ways as (select *, {SPEED} as speed, seq // 7 as way from graded), why as (select ride_id, seq, cum_mm, case when way is distinct from lag(way) over w then 'way' when abs(delta) > 3.0e0 then 'turn' when speed < 0.001e0 then 'stop' end as why, row_number() over w as n from ways window w as (partition by ride_id order by seq)
), cuts as (select ride_id, list([{{'seq': seq, 'at': cum_mm, 'why': why}}] order by seq) as c from why where why is not null and n > 1 group by ride_id
), kept as (select ride_id, unnest(list_reduce(c, lambda a, x: case when x[1].at - a[len(a)].at >= 1500000 then a || x else a end)) as k from cuts)"""


@query(f"with {PROPOSED} select ride_id, k.seq as seq, k.why as why from kept")
def guarded_proposals(spark, d):
    """Boundaries at ways, turns and stops, with a guard of 1500 m against trivial pieces."""
    p = signal.route_signal(A.trackpoints(spark, d)).withColumn("way_id", F.floor(F.col("seq") / 7))
    return segments.propose_boundaries(p, 3.0, 0.001, 1500.0).select("ride_id", "seq", "why")


RIDE_FEATURES = f"""{GRADED}, kp as (select ride_id, seq, kappa from (with {KAPPA} select * from kap)), pieces as (select g.*, case when base > 1e-6 then 100 * rise / base else 0.0e0 end as grade, {SPEED} as speed, kp.kappa, seq // 9 as segment from graded g join kp using (ride_id, seq)
), r as (select *, case when segment = lag(segment) over w then greatest(elv - lag(elv) over w, 0.0e0) else 0.0e0 end as up from pieces window w as (partition by ride_id order by seq)
), ft as (select ride_id, segment, sum(step_mm) / 1000.0e0 as length_m, sum(up) as gain_m, avg(grade) as mean_grade, var_samp(grade) as var_grade, avg(kappa) as mean_kappa, count(*) filter (speed < 0.5 and seq > 0) as stops from r group by ride_id, segment
), fx as (select *, stops / greatest(length_m / 1000.0e0, 0.1e0) as stops_per_km from ft)"""


def point_features(spark, d) -> DataFrame:
    p = signal.curvature(signal.route_signal(A.trackpoints(spark, d))).withColumn("segment", F.floor(F.col("seq") / 9).cast("long"))
    return segments.ride_features(p, "segment")


@query(f"with {RIDE_FEATURES} select ride_id, segment, round(length_m, 3) as length_m, round(gain_m, 4) as gain_m, round(mean_grade, 4) as mean_grade, round(var_grade, 3) as var_grade, round(mean_kappa, 5) as mean_kappa, stops, round(stops_per_km, 4) as stops_per_km from fx")
def ride_features(spark, d):
    """Length, gain, mean and spread of the grade, curvature and stops of every segment."""
    r = lambda c, n: F.round(c, n).alias(c)
    return point_features(spark, d).select("ride_id", "segment", r("length_m", 3), r("gain_m", 4), r("mean_grade", 4), r("var_grade", 3), r("mean_kappa", 5), "stops", r("stops_per_km", 4))


def _bins(c: str, edges: list[float]) -> str:
    return "(" + " + ".join(f"case when {c} >= {e!r}e0 then 1.0e0 else 0.0e0 end" for e in edges) + f") / {len(edges)}"


_TRAITS = f"""bt as (select ride_id, segment, {_bins('round(length_m, 3)', [1250.0, 2500.0, 5000.0, 10000.0])} as long, {_bins('round(mean_grade, 4)', [2.0, 4.0, 8.0])} as climb, 1.0e0 - {_bins('round(mean_kappa, 5)', [0.001, 0.01, 0.1])} as smooth, 1.0e0 - {_bins('round(stops_per_km, 4)', [0.1, 0.5, 2.0])} as free, 1.0e0 - {_bins('coalesce(round(var_grade, 3), 0)', [1.0, 10.0, 100.0])} as steady from fx)"""
_ZONE_SQL = ", ".join("round(" + " + ".join(f"{w!r}e0 * " + (f"(1.0e0 - {k[1:]})" if k[0] == "-" else k) for k, w in parts) + f", 6) as {zone}" for zone, parts in segments.ZONES.items())


@query(f"with {RIDE_FEATURES}, {_TRAITS} select ride_id, segment, {_ZONE_SQL} from bt")
def zone_scores(spark, d):
    """Suitability of every segment for each of five training zones, by binned features and weights of our own."""
    out = segments.zone_scores(ride_features(spark, d))
    return out.select("ride_id", "segment", *[F.round(z, 6).alias(z) for z in segments.ZONES])


@query(f"with {FEATURES}, scored as (select least(1.0e0, greatest(0.0e0, 0.4e0 * least(1.0e0, length_m / 100) + 0.3e0 * paved_share + 0.2e0 * (1.0e0 - mean_maxspeed / 50) + 0.1e0 / n_classes)) as tss, 0.6e0 * paved_share + 0.4e0 * least(1.0e0, length_m / 100) as race from feat) select round(avg(abs(tss - race)), 6) as mae from scored")
def score_error(spark, d):
    """Mean absolute error of one score against another."""
    s = scoring.alternatives(segments.suitability(segment_features(spark, d)))
    return s.agg(F.round(F.avg(F.abs(F.col("tss") - F.col("race"))), 6).alias("mae"))


@query(f"""with {A.SECTIONS}, l as (select *, lag(highway) over w as h, lag(surface) over w as s, row_number() over w as n from sections window w as (partition by ride_id order by pos)
), a as (select ride_id, pos from l where n > 1 and highway is distinct from h), b as (select ride_id, pos from l where n > 1 and surface is distinct from s), u as (select ride_id, a.pos is not null as x, b.pos is not null as y from a full join b using (ride_id, pos))
select ride_id, round(count(*) filter (x and y) / count(*)::double, 6) as jaccard from u group by ride_id""")
def breakpoint_sets(spark, d):
    """Agreement of two sets of break points, neither of which holds the other: changes of class and of surface."""
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(segments.ride()))
    p = A.sections(spark, d).withColumns({"x": changed("highway"), "y": changed("surface"), "n": F.row_number().over(segments.ride())}).where("n > 1")
    return segments.set_agreement(p.where("x").select("ride_id", "pos"), p.where("y").select("ride_id", "pos")).select("ride_id", F.round("jaccard", 6).alias("jaccard"))


LIB = COSTS + """, sg as (select ride_id, segment_id, md5(string_agg(way_id::varchar, '>' order by pos)) as segment_key from seg group by ride_id, segment_id
), tss as (select ride_id, segment_id, least(1.0e0, greatest(0.0e0, 0.4e0 * least(1.0e0, length_m / 100) + 0.3e0 * paved_share + 0.2e0 * (1.0e0 - mean_maxspeed / 50) + 0.1e0 / n_classes)) as tss from feat
), e as (select segment_key, count(*) as hits, avg(tss) as mean_tss, max(ride_id) as last_ride from sg join tss using (ride_id, segment_id) group by segment_key)"""


def scored_segments(spark, d) -> DataFrame:
    s = segments.threshold_segments(segments.merge_cost(A.sections(spark, d)), 0.8)
    keys = s.groupBy("ride_id", "segment_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "way_id"))), lambda x: x["way_id"].cast("string")), ">")).alias("segment_key"))
    return segments.suitability(segments.segment_features(s)).select("ride_id", "segment_id", "tss").join(keys, ["ride_id", "segment_id"])


def library_entries(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment_key").agg(F.count("*").alias("hits"), F.avg("tss").alias("mean_tss"), F.max("ride_id").alias("last_ride"))


@query(f"with {LIB.replace(', sg as', FEATURES.removeprefix(COSTS) + ', sg as')} select segment_key, hits, round(mean_tss, 8) as mean_tss, last_ride from e where hits >= 2 or last_ride >= (select max(last_ride) / 2 from e)")
def library_upsert(spark, d):
    """A library of the even rides, with the odd ones upserted: hits and running mean score; rare entries that are long unseen go."""
    scored = scored_segments(spark, d)
    both = segments.upsert_library(library_entries(scored.where("ride_id % 2 = 0")), library_entries(scored.where("ride_id % 2 = 1")))
    newest = F.broadcast(both.agg((F.max("last_ride") / 2).alias("before")))  # one row
    out = segments.prune_library(both.join(newest), 2, F.col("before"))
    return out.select("segment_key", "hits", F.round("mean_tss", 8).alias("mean_tss"), "last_ride")


HAAR = """l0 as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
""" + ",\n".join(f"p{j} as (select vec_id, i // 2 as i, max(case when i % 2 = 0 then x end) as a, max(case when i % 2 = 1 then x end) as b from l{j - 1} group by all having count(*) = 2), l{j} as (select vec_id, i, (a + b) / sqrt(2.0e0) as x from p{j}), d{j} as (select vec_id, {j} as level, i as k, (a - b) / sqrt(2.0e0) as d from p{j})" for j in (1, 2, 3))


@query(f"with {HAAR}, d as (select * from d1 union all select * from d2 union all select * from d3), s as (select *, stddev_pop(d) over (partition by vec_id, level) as s from d) select vec_id, level::int as level, k, round(d, 6) as d from s where abs(round(d, 9)) > 1.5e0 * round(s, 9)")
def wavelet_levels(spark, d):
    """Footprint over three levels of detail, each with its own threshold."""
    v = A.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return segments.wavelet_footprint(v, "vec_id", 3, 1.5).select("vec_id", "level", "k", F.round("d", 6).alias("d"))


# ---- merges

@query(f"""with {CHUNK}, {A.EDGES.removeprefix(A.PATH + ', ')}, st as (select u as node, v as nxt, min(coalesce(len_m, 1.0e0)) as step from (select u % 4 as u, v % 4 as v, len_m from edges where u % 4 <> v % 4) group by all
), b as (select *, lag(nodes) over (partition by ride_id order by chunk) as before from chunks), k as (select *, before[len(before)] as u, nodes[1] as v from b where before is not null and {OVERLAP.format(a='before', b='nodes', most=64)} = 0
), r1 as (select node as u, nxt as v, step as c from st), r2 as (select a.u, b.nxt as v, min(c + step) as c from r1 a join st b on a.v = b.node group by all), r3 as (select a.u, b.nxt as v, min(c + step) as c from r2 a join st b on a.v = b.node group by all
), best as (select u, v, min(c) as c from (select * from r1 union all select * from r2 union all select * from r3) group by all)
select ride_id, chunk, k.u, k.v, best.c as connector_m from k left join best on k.u = best.u and k.v = best.v""")
def stitched_seams(spark, d):
    """Connector legs of the seams that do not overlap: the cheapest way from the last node before to the first one after."""
    c = chunks(spark, d)
    e = network.edge_index(A.node_path(spark, d)).select((F.col("u") % 4).alias("u"), (F.col("v") % 4).alias("v"), "len_m").where("u <> v")
    return routes.stitched(c, e, 64).select("ride_id", "chunk", "u", "v", F.col("length_m").alias("connector_m"))


@query(f"""with {A.TRACK}, legs as (select ride_id, seq // 10 as leg, list(cast(round(lat * 1000) as bigint) || ',' || cast(round(lon * 100) as bigint) order by seq) as c from trackpoints group by all), prev as (select *, lag(c) over (partition by ride_id order by leg) as b from legs
), k as (select *, coalesce(case when b is not null then {OVERLAP.format(a='b', b='c', most=64)} end, 0) as k from prev) select ride_id, array_to_string(flatten(list(c[k + 1 : len(c)] order by leg)), ' ') as coordinates from k group by ride_id""")
def merged_coordinates(spark, d):
    """Coordinates of all legs end to end, each without the overlap with the leg before."""
    xy = F.concat_ws(",", F.round(F.col("lat") * 1000).cast("long"), F.round(F.col("lon") * 100).cast("long"))
    c = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 10).cast("long").alias("chunk")).agg(routes.ordered("seq", xy).alias("nodes"))
    return routes.merge_chunks(c, 64).select("ride_id", F.array_join("nodes", " ").alias("coordinates"))


@query(f"""with {A.PATH}, legs as (select ride_id, pos // 3 as chunk, list(node_id % 4 order by pos) as nodes, list(len_m order by pos) as m from node_path group by all), b as (select *, lag(nodes) over (partition by ride_id order by chunk) as before from legs
), k as (select *, coalesce(case when before is not null then {OVERLAP.format(a='before', b='nodes', most=50)} end, 0) as k from b)
select ride_id, chunk, len(nodes) - k as n_left, round(list_sum(m[k + 1 : len(m)]), 3) as distance from k where len(nodes) > k""")
def trimmed_distances(spark, d):
    """Legs without the nodes that the leg before ends with, and the length of what is left of them."""
    p = A.node_path(spark, d).withColumn("chunk", F.floor(F.col("pos") / 3).cast("long"))
    legs = p.groupBy("ride_id", "chunk").agg(routes.ordered("pos", F.col("node_id") % 4).alias("nodes"), routes.ordered("pos", F.col("len_m")).alias("metres"))
    return routes.trim_legs(legs, 50).select("ride_id", "chunk", F.size("nodes").cast("long").alias("n_left"), F.round("distance", 3).alias("distance"))


# ---- match diagnostics

@query(f"""with {NODES}, met as (select ride_id, seq, node_id, {A.HAV.format(a='lat', b='lon', c='nlat', d='nlon')} as m from trackpoints, nodes where abs(lat - nlat) < 0.0025e0), near as (select ride_id, seq, min(round(m, 3)) as distance_m from met where m <= 250.0e0 group by all
), t as (select *, case when t_us - lag(t_us) over (partition by ride_id order by seq) > 36000000000 then 1 else 0 end as cut from trackpoints), many as (select ride_id from t group by ride_id having sum(cut) > 0)
select t.ride_id, t.seq, n.distance_m from t join many using (ride_id) left join near n on n.ride_id = t.ride_id and n.seq = t.seq where n.distance_m is null or n.distance_m > 100""")
def bad_match_points(spark, d):
    """Points over 100 m from any node, or out of reach (250 m), of rides that fell into more than one matching."""
    p = signal.split_on_gaps(A.trackpoints(spark, d), 36_000_000_000)
    many = p.groupBy("ride_id").agg(F.max("track_id").alias("last")).where("last > 0").select("ride_id")
    near = matching.nearest(p.join(many, "ride_id", "left_semi"), nodes(spark, d), ["ride_id", "seq"], 250.0)
    return near.where("distance_m is null or distance_m > 100").select("ride_id", "seq", "distance_m")


@query(f"""with {A.SIGNAL}, parts as (select ride_id, seq // 10 as part, sum(case when seq % 10 > 0 then step_mm else 0 end) as length_mm from sig group by all
), met as (select s.ride_id, v.seq // 10 as part, s.seq from sig s join sig v on s.ride_id = v.ride_id and abs(s.lat - v.lat) < 0.0007e0 where ({A.HAV.format(a='s.lat', b='s.lon', c='v.lat', d='v.lon')}) <= 60.0e0
), hits as (select ride_id, part, count(distinct seq) as hits from met group by all) select ride_id, part, hits from hits join parts using (ride_id, part) where hits >= 12 and length_mm >= 50000""")
def spur_keep(spark, d):
    """Matched pieces that are long enough and near enough raw points of their ride, by distance to a vertex; the others are spurs."""
    p = signal.with_distance(A.trackpoints(spark, d)).withColumn("part", F.floor(F.col("seq") / 10).cast("long"))
    return matching.kept_pieces(p, p, 50.0, 12, 60.0).select("ride_id", "part", "hits")


@query(f"""with {NODES}, met as (select ride_id, seq, {A.HAV.format(a='lat', b='lon', c='nlat', d='nlon')} as m from trackpoints, nodes where abs(lat - nlat) < 0.001e0), near as (select ride_id, seq, min(round(m, 3)) as m from met where m <= 60.0e0 group by all)
select ride_id, round(1.4826e0 * median(m), 4) as sigma_m from near group by ride_id""")
def position_sigma(spark, d):
    """Noise of a ride's positions, by the median distance to the road: what thins its points."""
    near = matching.nearest(A.trackpoints(spark, d), nodes(spark, d), ["ride_id", "seq"], 60.0)
    return matching.position_sigma(near).select("ride_id", F.round("sigma_m", 4).alias("sigma_m"))
