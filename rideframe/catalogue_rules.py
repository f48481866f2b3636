"""Registered queries over access rules, run assignment, scores, geometry fallbacks, maps and raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.catalogue import FEATURES, HEADINGS, segment_features
from rideframe.catalogue_routes import CHUNK, OVERLAP, chunks, listed
from rideframe.functions import geo, text, units
from rideframe.operators import access, network, routes, scoring, signal
from rideframe.plans import adapters as A
from rideframe.registry import query

#: Tags that the driver's parts stand for: key, and a value for each remainder of a number.
WAY_TAGS = {
    "oneway": ("p_size", 5, {0: "yes", 1: "-1", 2: "no"}),
    "oneway:bicycle": ("p_partkey", 7, {0: "yes", 1: "no", 2: "-1"}),
    "cycleway": ("p_partkey", 4, {0: "lane"}),
    "cycleway:left": ("p_partkey", 6, {0: "opposite_lane", 1: "lane"}),
    "cycleway:right": ("p_size", 7, {0: "track", 1: "opposite"}),
    "junction": ("p_partkey", 11, {0: "roundabout"}),
    "width": ("p_size", 9, {0: "0.8", 1: "2.5 m"}),
    "foot": ("p_partkey", 5, {0: "no", 1: "yes"}),
    "bicycle": ("p_partkey", 13, {0: "dismount"}),
}
NODE_TAGS = {
    "bicycle": ("s_suppkey", 7, {0: "no", 1: "yes"}),
    "access": ("s_suppkey", 3, {0: "private", 1: "yes"}),
    "barrier": ("s_suppkey", 2, {0: "fence"}),
    "highway": ("s_suppkey", 5, {0: "crossing"}),
    "maxwidth:physical": ("s_suppkey", 4, {0: "0.9", 1: "1.5"}),
}


def tagged(rules: dict) -> F.Column:
    made = [F.struct(F.lit(key).alias("k"), A._case(F.col(c) % n, {**values, n: ""}, "").alias("v")) for key, (c, n, values) in rules.items()]
    return F.map_from_entries(F.filter(F.array(*made), lambda e: e["v"] != "")).alias("tags")


def tagged_sql(rules: dict) -> str:
    return ", ".join(f"case {c} % {n} " + " ".join(f"when {i} then '{v}'" for i, v in values.items()) + f' end as "{key}"' for key, (c, n, values) in rules.items())


def tagged_ways(spark, d) -> DataFrame:
    kind = A._case(F.col("p_type"), {"LARGE": "primary", "MEDIUM": "secondary", "STANDARD": "tertiary", "SMALL": "residential", "PROMO": "steps"}, "motorway")
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("way_id"), kind.alias("highway"), tagged(WAY_TAGS))


@query(f"with n as (select s_suppkey as node_id, {tagged_sql(NODE_TAGS)} from supplier) select node_id, case when coalesce(bicycle, access) is not null then coalesce(bicycle, access) in ('no', 'private') and highway is distinct from 'crossing' else coalesce(barrier = 'fence', false) end or coalesce(\"maxwidth:physical\"::double < 1.0e0, false) as barrier from n")
def profile_access(spark, d):
    n = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), tagged(NODE_TAGS))
    return n.select("node_id", access.node_barrier(width=1.0).alias("barrier"))


_KIND = "case p_type when 'LARGE' then 'primary' when 'MEDIUM' then 'secondary' when 'STANDARD' then 'tertiary' when 'SMALL' then 'residential' when 'PROMO' then 'steps' else 'motorway' end"
_SPEEDS = "case highway when 'primary' then 60.0e0 when 'secondary' then 37.5e0 when 'tertiary' then 50.0e0 when 'residential' then 27.5e0 end"
_FLOW = "case {c} when 'yes' then 'forward' when 'no' then 'both' when '-1' then 'backward' end"
MODES = f"""w as (select p_partkey as way_id, {_KIND} as highway, {tagged_sql(WAY_TAGS)} from part
), f as (select *, junction is not null or highway = 'motorway' as implied, {_SPEEDS} as own, coalesce(try_cast(split_part(width, ' ', 1) as double) >= 1.0e0, true) as wide from w
), g as (select *, coalesce({_FLOW.format(c='"oneway:bicycle"')}, {_FLOW.format(c='oneway')}, case when implied then 'forward' end, 'both') as flow,
  coalesce(cycleway = 'lane', false) as la, coalesce("cycleway:left" = 'lane', false) as ll, coalesce("cycleway:right" = 'track', false) as lr, coalesce("cycleway:left" = 'opposite_lane', false) as ol, coalesce("cycleway:right" = 'opposite', false) as opr from f
), h as (select *, flow = 'both' and not implied as two_way from g
), i as (select *, case when two_way then la or lr or ol else ol or opr or ((la or ll or lr) and flow <> 'backward') end as cf, case when two_way then la or ll or opr else ol or opr or ((la or ll or lr) and flow = 'backward') end as cb from h
), j as (select *, case when wide then case when cf then 30.0e0 when flow <> 'backward' then own end end as rf, case when wide then case when cb then 30.0e0 when flow <> 'forward' then own end end as rb,
  case when foot is distinct from 'no' then case when highway = 'steps' then 2.0e0 when foot = 'yes' then 4.0e0 end end as pf, case when foot is distinct from 'no' then case when highway = 'steps' then 2.0e0 when foot = 'yes' and not implied then 4.0e0 end end as pb, bicycle is not null as dis from i
), m as (select way_id, highway, flow, two_way, wide, cf as cycleway_forward, cb as cycleway_backward,
  case when dis then 'pushing' when rf is not null then 'cycling' when pf is not null then 'pushing' else 'inaccessible' end as forward_mode, case when dis then 4.0e0 else coalesce(rf, pf, 0.0e0) end as forward_speed,
  case when dis then 'pushing' when rb is not null then 'cycling' when pb is not null then 'pushing' else 'inaccessible' end as backward_mode, case when dis then 4.0e0 else coalesce(rb, pb, 0.0e0) end as backward_speed from j)"""


@query(f"with {MODES} select way_id, flow, cycleway_forward, cycleway_backward from m")
def profile_directions(spark, d):
    return access.way_modes(tagged_ways(spark, d)).select("way_id", "flow", "cycleway_forward", "cycleway_backward")


@query(f"with {MODES} select way_id, forward_mode, backward_mode, forward_speed, backward_speed from m")
def profile_push(spark, d):
    return access.way_modes(tagged_ways(spark, d), width=1.0).select("way_id", "forward_mode", "backward_mode", "forward_speed", "backward_speed")


@query(f"with {MODES} select way_id, highway from m where not wide")
def profile_width(spark, d):
    return tagged_ways(spark, d).where(access.metres(access.tag("width")) < 1.0).select("way_id", "highway")


_PENALTY = "case highway when 'primary' then 0.5e0 * case when two_way then 1.0e0 else 0.5e0 end when 'secondary' then 0.65e0 * case when two_way then 1.0e0 else 0.6e0 end when 'tertiary' then 0.8e0 else 1.0e0 end"


@query(f"with {MODES} select way_id, round(forward_speed / 3.6e0 * case when cycleway_forward then 1.0e0 else {_PENALTY} end, 6) as forward_rate, round(backward_speed / 3.6e0 * case when cycleway_backward then 1.0e0 else {_PENALTY} end, 6) as backward_rate from m")
def cyclability(spark, d):
    out = access.cyclability(access.way_modes(tagged_ways(spark, d), width=1.0))
    return out.select("way_id", F.round("forward_rate", 6).alias("forward_rate"), F.round("backward_rate", 6).alias("backward_rate"))


STARTS = A.SIGNAL + ", " + A.PATH + """, e as (select ride_id, pos as run_idx, cast(sum(len_m * 1000000) over (partition by ride_id order by pos) - len_m * 1000000 as bigint) as start_mm from node_path)"""


@query(f"with {STARTS} select p.ride_id, p.seq, p.cum_mm as at_mm, e.run_idx from sig p asof left join e on p.ride_id = e.ride_id and p.cum_mm >= e.start_mm")
def way_assignment(spark, d):
    w = Window.partitionBy("ride_id").orderBy("pos")
    starts = A.node_path(spark, d).select("ride_id", F.col("pos").alias("run_idx"), (F.sum(F.col("len_m") * 1_000_000).over(w) - F.col("len_m") * 1_000_000).cast("long").alias("start_mm"))
    points = signal.with_distance(A.trackpoints(spark, d)).withColumnRenamed("cum_mm", "at_mm")
    return network.assign_runs(points, starts)


@query(f"with {HEADINGS} select ride_id, seq, round(delta, 6) as heading_delta from head")
def heading_delta(spark, d):
    return signal.with_heading(A.trackpoints(spark, d)).select("ride_id", "seq", F.round("heading_delta", 6).alias("heading_delta"))


@query(f"with {A.SIGNAL} select ride_id, seq, round(2 * 6371000.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians(51.5e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5e0)) * pow(sin(radians(-0.12e0 - lon) / 2), 2)))), 3) as from_centre_m from sig")
def haversine(spark, d):
    return A.trackpoints(spark, d).select("ride_id", "seq", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.12)), 3).alias("from_centre_m"))


@query("select event_id, round(atan2(sin(value), cos(value)), 6) as wrapped from events")
def angle_wrap(spark, d):
    return A.read(spark, d, "events").select("event_id", F.round(geo.wrap(F.col("value")), 6).alias("wrapped"))


@query(f"with {A.SIGNAL}, l as (select *, lag(elv) over (partition by ride_id order by seq) as pe from sig) select ride_id, seq, round(case when pe is not null and step_mm > 0 then (elv - pe) / (step_mm / 1000.0e0) else 0.0e0 end, 6) as gradient from l")
def point_gradient(spark, d):
    p = signal.with_distance(A.trackpoints(spark, d)).withColumn("pe", F.lag("elv").over(signal.ride()))
    rise = F.when(F.col("pe").isNotNull() & (F.col("step_mm") > 0), (F.col("elv") - F.col("pe")) / (F.col("step_mm") / 1000.0)).otherwise(0.0)
    return p.select("ride_id", "seq", F.round(rise, 6).alias("gradient"))


@query(f"with {A.SIGNAL} select ride_id, seq, round(sqrt(pow(lat - plat, 2) + pow(lon - plon, 2)), 9) as planar, round(atan2(lat - plat, lon - plon), 6) as heading from sig where plat is not null")
def planar_heading(spark, d):
    w = signal.ride()
    p = A.trackpoints(spark, d).withColumns({"dy": F.col("lat") - F.lag("lat").over(w), "dx": F.col("lon") - F.lag("lon").over(w)}).where("dy is not null")
    return p.select("ride_id", "seq", F.round(F.sqrt(F.pow("dy", F.lit(2.0)) + F.pow("dx", F.lit(2.0))), 9).alias("planar"), F.round(F.atan2("dy", "dx"), 6).alias("heading"))


@query("select event_id, round((value - 32.0e0) * 5.0e0 / 9.0e0, 6) as f_to_c, round(value / 3.6e0, 6) as kmh_to_mps, round(value * 0.44704e0, 6) as mph_to_mps, round(case when abs(value) <= 1 then value * 100.0e0 else value end, 6) as fraction_to_percent from events")
def unit_transforms(spark, d):
    return A.read(spark, d, "events").select("event_id", *[F.round(f(F.col("value")), 6).alias(name) for name, f in units.TRANSFORMS.items()])


@query(f"with {A.TRACK} select ride_id, seq, lon, lat from trackpoints")
def lonlat_swap(spark, d):
    pair = A.trackpoints(spark, d).select("ride_id", "seq", F.array("lat", "lon").alias("p")).withColumn("p", F.reverse("p"))
    return pair.select("ride_id", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query(f"with {A.TRACK} select ride_id, count(*) as points, count(*) filter (elv <= 100) as kept_nulls, string_agg(case when elv > 100 then seq::varchar else '-' end, ';' order by seq) as shown from trackpoints group by ride_id")
def null_preserving_filter(spark, d):
    """Unmatched points stay in place as nulls."""
    p = A.trackpoints(spark, d).withColumn("s", F.when(F.col("elv") > 100, F.col("seq").cast("string")))
    out = p.groupBy("ride_id").agg(F.count("*").alias("points"), F.count_if(F.col("s").isNull()).alias("kept_nulls"), routes.ordered("seq", F.col("s")).alias("s"))
    return out.select("ride_id", "points", "kept_nulls", F.array_join("s", ";", "-").alias("shown"))


@query(f"with {A.WAYS} select way_id, highway from ways where highway not in ('cycleway')")
def highway_filter(spark, d):
    w = A.ways(spark, d).withColumn("highway", F.when(F.col("highway") != "cycleway", F.col("highway")))
    return w.where("highway is not null").select("way_id", "highway")


@query("select event_id, coalesce(json_extract_string(props, '$.k.deep'), 'none') as deep, coalesce(json_extract_string(props, '$.k'), 'none') as k from events")
def safe_get(spark, d):
    got = lambda path: F.coalesce(F.get_json_object("props", path), F.lit("none"))
    return A.read(spark, d, "events").select("event_id", got("$.k.deep").alias("deep"), got("$.k").alias("k"))


@query("select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events")
def flatten_kv(spark, d):
    e = A.read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.where("value is not null")


@query(f"with {A.TRACK}, g as (select ride_id, count(*) as n from trackpoints group by ride_id) select t.ride_id, t.seq, t.lat, l.l_linenumber as line from trackpoints t join (select l_orderkey as ride_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as seq, l_linenumber from lineitem) l using (ride_id, seq)")
def positional_zip(spark, d):
    """Rows of two sequences of a ride at equal places; the longer one ends with the shorter."""
    w = Window.partitionBy("l_orderkey").orderBy(*A._TIES)
    lines = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ride_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("l_linenumber").alias("line"))
    return A.trackpoints(spark, d).select("ride_id", "seq", "lat").join(lines, ["ride_id", "seq"])


@query(f"""with {A.SIGNAL}, c as (select *, seq // 200 as chunk_id, cast(floor(abs(lon) * 1e6 + 0.5e0) as bigint) * sign(lon)::bigint as x, cast(floor(abs(lat) * 1e6 + 0.5e0) as bigint) * sign(lat)::bigint as y from sig
), b as (select *, degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) as deg from (select * replace (lead(lat) over w as nlat, lead(lon) over w as nlon) from c window w as (partition by ride_id, chunk_id order by seq))
), b2 as (select *, case when deg < 0 then deg + 360 else deg end as bear from b
), t as (select *, abs(bear - lag(bear) over (partition by ride_id, chunk_id order by seq)) as dd from b2
), m as (select *, coalesce(round(avg(case when dd > 180 then 360 - dd else dd end) over (partition by ride_id, chunk_id order by seq rows between 2 preceding and 2 following), 6), 0.0e0) as mean from t)
select ride_id, lpad(chunk_id::varchar, 6, '0') as chunk, count(*) as n, string_agg(x::varchar || ',' || y::varchar, ' ' order by seq) as coordinates_e6, string_agg((t_us // 1000000)::varchar, ';' order by seq) as timestamps, string_agg(least(50, 10 + cast(ceil(mean * 2) as bigint))::varchar, ';' order by seq) as radiuses from m group by ride_id, chunk_id""")
def chunk_payload(spark, d):
    """What a match request of a chunk carries; coordinates are whole millionths of a degree, so that no text depends on rounding."""
    p = signal.dynamic_radius(A.trackpoints(spark, d))
    whole = lambda c: (F.floor(F.abs(c) * 1e6 + 0.5) * F.signum(c)).cast("long").cast("string")
    p = p.withColumns({"c": F.concat_ws(",", whole("lon"), whole("lat")), "t": F.floor(F.col("t_us") / 1e6).cast("string"), "r": F.col("radius").cast("string")})
    join = lambda c, by: F.array_join(routes.ordered("seq", F.col(c)), by)
    out = p.groupBy("ride_id", "chunk_id").agg(F.count("*").alias("n"), join("c", " ").alias("coordinates_e6"), join("t", ";").alias("timestamps"), join("r", ";").alias("radiuses"))
    return out.withColumn("chunk", F.lpad(F.col("chunk_id").cast("string"), 6, "0")).drop("chunk_id")


BEST = A.EDGES + ", best as (select u, v, min({'w': way_id, 'd': dir, 'l': len_m}) as e from edges group by u, v)"


@query(f"with {BEST} select u, v, e.w as way_id, e.d as dir from best")
def edge_tiebreak(spark, d):
    """One edge per pair of nodes: of least way, direction and length."""
    best = network.edge_index(A.node_path(spark, d)).groupBy("u", "v").agg(F.min(F.struct("way_id", "dir")).alias("e"))
    return best.select("u", "v", "e.way_id", F.col("e.dir").cast("int").alias("dir"))


FOUND = BEST + """, st as (select *, row_number() over (partition by ride_id order by pos) - 1 as i from (select ride_id, pos, node_id as u, nxt as v, len_m from pairs where nxt <> node_id)
), lo as (select st.ride_id, st.i as pos, e.w % 3 as way_group, coalesce(case when e.l > 10 then e.l end, st.len_m) as len_m from st left join best using (u, v)
), fl as (select *, case when row_number() over w > 1 and way_group is not distinct from lag(way_group) over w then 0 else 1 end as new from lo window w as (partition by ride_id order by pos)
), gr as (select *, sum(new) over (partition by ride_id order by pos) - 1 as run_idx from fl)"""


def found_steps(spark, d) -> DataFrame:
    p = A.node_path(spark, d)
    edges = network.edge_index(p).groupBy("u", "v").agg(F.min(F.struct("way_id", "dir", "len_m")).alias("e"))
    steps = network.pairs(p).select("ride_id", (F.row_number().over(Window.partitionBy("ride_id").orderBy("pos")) - 1).cast("long").alias("pos"), "u", "v", "len_m")
    return steps.join(edges, ["u", "v"], "left").select("ride_id", "pos", "u", "v", (F.col("e.way_id") % 3).alias("way_group"), F.coalesce(F.when(F.col("e.len_m") > 10, F.col("e.len_m")), "len_m").alias("len_m"))


@query(f"with {FOUND} select ride_id, cast(run_idx as bigint) as run_idx, any_value(way_group) as way_group, count(*) as n, round(sum(len_m), 3) as length_m from gr group by ride_id, run_idx")
def runs_prefer_db_length(spark, d):
    """Runs of a slice; the map's length of a step goes before the given one."""
    return network.run_lengths(found_steps(spark, d), ["way_group"]).select("ride_id", "run_idx", "way_group", "n", F.round("length_m", 3).alias("length_m"))


@query(f"with {FOUND}, n as (select gr.ride_id, run_idx, count(*) as n, string_agg(st.v::varchar, ';' order by gr.pos) as nodes from gr join st on gr.ride_id = st.ride_id and gr.pos = st.i group by all) select ride_id, cast(run_idx as bigint) as run_idx, n, nodes from n")
def runs_from_flattened(spark, d):
    """Runs over a ride's nodes without equal neighbours, each with the nodes it reaches."""
    s = found_steps(spark, d)
    w = network.path_order()
    s = s.withColumn("new", F.when((F.row_number().over(w) > 1) & F.col("way_group").eqNullSafe(F.lag("way_group").over(w)), 0).otherwise(1))
    s = s.withColumn("run_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return s.groupBy("ride_id", "run_idx").agg(F.count("*").alias("n"), listed(routes.ordered("pos", F.col("v"))).alias("nodes"))


@query(f"""with {CHUNK}, b as (select *, lag(nodes) over (partition by ride_id order by chunk) as before from chunks
), k as (select *, coalesce(case when before is not null then {OVERLAP.format(a='before', b='nodes', most=50)} end, 0) as k from b)
select ride_id, chunk, k as trimmed, greatest(len(nodes) - k, 0) as n_left, array_to_string(nodes[k + 1 : len(nodes)], ';') as nodes from k where len(nodes) > k""")
def trim_legs(spark, d):
    """Legs without the nodes that the leg before ends with; legs that hold nothing else go."""
    return routes.trim_legs(chunks(spark, d), 50).select("ride_id", "chunk", F.col("k").cast("long").alias("trimmed"), F.size("nodes").cast("long").alias("n_left"), listed(F.col("nodes")).alias("nodes"))


COORDS = A.TRACK + ", legs as (select ride_id, seq // 10 as leg, list({'a': round(lat, 3), 'b': round(lon, 2)} order by seq) as c from trackpoints group by all), prev as (select *, lag(c) over (partition by ride_id order by leg) as b from legs)"


@query(f"with {COORDS}, k as (select *, coalesce(case when b is not null then {OVERLAP.format(a='b', b='c', most=64)} end, 0) as k from prev) select ride_id, sum(len(c) - k)::bigint as n_points, sum(k)::bigint as n_dropped from k group by ride_id")
def coord_merge(spark, d):
    """Points left and dropped where legs overlap in rounded places; whole thousandths and hundredths, as a half is rounded by its decimal digits otherwise."""
    c = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 10).alias("chunk")).agg(routes.ordered("seq", F.struct(F.round(F.col("lat") * 1000).alias("a"), F.round(F.col("lon") * 100).alias("b"))).alias("nodes"))
    own = F.size("nodes").cast("long")
    c = c.withColumn("before", F.lag("nodes").over(Window.partitionBy("ride_id").orderBy("chunk")))
    c = c.withColumn("k", F.when(F.col("before").isNotNull(), network.overlap(F.col("before"), F.col("nodes"), 64)).otherwise(0).cast("long"))
    return c.groupBy("ride_id").agg(F.sum(own - F.col("k")).alias("n_points"), F.sum("k").alias("n_dropped"))


@query(f"with {A.SIGNAL} select ride_id, string_agg(step_mm::varchar, ';' order by seq) as steps from sig where seq > 0 group by ride_id")
def edge_metric_concat(spark, d):
    """Step lengths of all legs of a ride, end to end."""
    legs = signal.with_distance(A.trackpoints(spark, d)).where("seq > 0").groupBy("ride_id", F.floor(F.col("seq") / 20).alias("leg")).agg(routes.ordered("seq", F.col("step_mm")).alias("m"))
    return legs.groupBy("ride_id").agg(listed(F.flatten(routes.ordered("leg", F.col("m")))).alias("steps"))


LEGS = A.TRACK + ", l as (select ride_id, seq // 5 as leg, list({'lat': lat, 'lon': lon} order by seq) as c from trackpoints group by all)"


@query(f"with {LEGS} select ride_id, leg, case leg % 6 when 0 then 'coordinates' when 1 then 'polyline' when 2 then 'steps' when 3 then 'slice' when 4 then 'line' else 'gpx_list' end as chosen, case leg % 6 when 4 then least(2, len(c)) when 3 then greatest(len(c) - 1, 1) else len(c) end as n_points, case when leg % 6 = 1 then round(c[1].lat, 6) when leg % 6 = 3 and len(c) > 1 then c[2].lat else c[1].lat end as first_lat from l")
def leg_geometry(spark, d):
    """Geometry of a leg from the first of six sources that has any."""
    legs = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 5).alias("leg")).agg(routes.ordered("seq", F.struct("lat", "lon")).alias("c"))
    kind = F.col("leg") % 6
    ends = F.concat(F.slice("c", 1, 1), F.when(F.size("c") > 1, F.slice("c", -1, 1)).otherwise(F.slice("c", 1, 0)))
    halves = F.array(F.slice("c", 1, 2), F.slice("c", 3, 9))
    named = F.transform("c", lambda p, i: F.when(i % 2 == 0, F.create_map(F.lit("latitude"), p["lat"], F.lit("lng"), p["lon"])).otherwise(F.create_map(F.lit("Lat"), p["lat"], F.lit("lon"), p["lon"])))
    cut = F.when(F.size("c") > 1, F.slice("c", 2, 9)).otherwise(F.col("c"))
    sources = {"coordinates": F.col("c"), "polyline": routes.polyline(F.col("c"), 6), "steps": halves, "slice": cut, "line": ends, "gpx_list": named}
    legs = legs.withColumns({name: F.when(kind == i, source) for i, (name, source) in enumerate(sources.items())})
    out = legs.withColumn("g", routes.leg_geometry(**{name: F.col(name) for name in sources}))
    return out.select("ride_id", "leg", "g.chosen", F.size("g.shape").cast("long").alias("n_points"), F.col("g.shape")[0]["lat"].alias("first_lat"))


@query(f"with {A.TRACK}, g as (select ride_id, seq // 7 as segment, min_by(lat, seq) as a, max_by(lat, seq) as b, count(*) filter (elv > 100) as n, min_by(lat, seq) filter (elv > 100) as f from trackpoints group by all) select ride_id, segment, case when n >= 2 then n else 2 end as n_points, case when n >= 2 then f else a end as first_lat from g")
def segment_geometry(spark, d):
    """Points of a segment that have a place, however it is spelled; with fewer than two, the straight line between its ends."""
    s = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 7).alias("segment")).agg(routes.ordered("seq", F.struct("lat", "lon", "elv")).alias("c"))
    place = F.transform("c", lambda p, i: F.when(p["elv"] > 100, F.when(i % 3 == 0, F.create_map(F.lit("Latitude"), p["lat"], F.lit("Longitude"), p["lon"])).otherwise(F.create_map(F.lit("lat"), p["lat"], F.lit("lon"), p["lon"]))).otherwise(F.create_map(F.lit("lat"), p["lat"])))
    had = routes.spelled_points(place)
    ends = F.transform(F.array(F.element_at("c", 1), F.element_at("c", -1)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    shape = F.when(F.size(had) >= 2, had).otherwise(ends)
    return s.select("ride_id", "segment", F.size(shape).cast("long").alias("n_points"), F.element_at(shape, 1)["lat"].alias("first_lat"))


@query(f"with {A.TRACK}, g as (select ride_id, seq // 50 as part, count(*) as n from trackpoints group by all) select ride_id, case when count(*) > 1 then 'MultiLineString' else 'LineString' end as type, sum(n)::bigint as n_points from g group by ride_id")
def geometry_point_count(spark, d):
    parts = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 50).alias("part")).agg(routes.ordered("seq", F.array("lon", "lat")).alias("line"))
    shape = parts.groupBy("ride_id").agg(F.collect_list("line").alias("lines"))
    n = F.aggregate(F.transform("lines", lambda x: F.size(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return shape.select("ride_id", F.when(F.size("lines") > 1, "MultiLineString").otherwise("LineString").alias("type"), n.alias("n_points"))


@query("with u as (select s_suppkey as id, s_acctbal as v from supplier where s_suppkey % 3 <> 0 union select s_suppkey, s_acctbal from supplier where s_suppkey % 2 = 0) select id, min(v) as v from u group by id")
def map_union_dedup(spark, d):
    """Two map fragments that share elements, as one; of unequal copies of an id the least stays."""
    s = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return s.where("id % 3 <> 0").unionByName(s.where("id % 2 = 0")).groupBy("id").agg(F.min("v").alias("v"))


@query(f"with {A.SIGNAL}, g as (select ride_id, seq, (t_us - pt) / 1e6 as s from sig where pt is not null) select ride_id, seq, case when s < 20 then 'sprint' when s < 180 then 'short' when s between 180 and 480 then 'middle' when s between 600 and 3600 then 'long' when s > 3600 then 'endless' end as band from g")
def scale_band(spark, d):
    p = A.trackpoints(spark, d).withColumn("s", (F.col("t_us") - F.lag("t_us").over(signal.ride())) / 1e6).where("s is not null")
    return p.select("ride_id", "seq", scoring.scale_band(F.col("s")).alias("band"))


_POL = "case highway when 'primary' then 0 when 'secondary' then 1 when 'tertiary' then 0 when 'residential' then 1 when 'cycleway' then 4 else 0 end"


@query(f"with {A.SECTIONS} select ride_id, sum({_POL})::bigint as polarity, bool_or(highway = 'primary_link') as void from sections group by ride_id")
def feature_polarity(spark, d):
    s = A.sections(spark, d).withColumn("highway", F.when(F.col("highway") == "primary_link", "trunk_link").otherwise(F.col("highway")))
    return scoring.polarity(s)


@query(f"with {FEATURES}, n as (select ride_id, segment_id, least(1.0e0, length_m / 100) as a, paved_share as b, 1.0e0 - mean_maxspeed / 50 as c, 1.0e0 / n_classes as d from feat), v as (select *, (a + b + c + d) / 4 as m from n) select ride_id, segment_id, round(1 / (1 + (pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2) + pow(d - m, 2)) / 3), 6) as confidence from v")
def tss_confidence(spark, d):
    return scoring.confidence(segment_features(spark, d)).select("ride_id", "segment_id", F.round("confidence", 6).alias("confidence"))


@query(f"with {FEATURES}, n as (select ride_id, segment_id, least(1.0e0, length_m / 100) as a, paved_share as b, greatest(0.0e0, 1.0e0 - mean_maxspeed / 50) as c, 1.0e0 / n_classes as d from feat) select ride_id, segment_id, round(0.6e0 * a + 0.2e0 * b + 0.2e0 * d, 10) as endurance, round(0.7e0 * (1 - b) + 0.3e0 * (1 - d), 10) as exploration, round(0.5e0 * a + 0.5e0 * d, 10) as interval, round(0.6e0 * b + 0.4e0 * a, 10) as race, round(0.7e0 * c + 0.3e0 * b, 10) as safety from n")
def alt_scores(spark, d):
    out = scoring.alternatives(segment_features(spark, d))
    return out.select("ride_id", "segment_id", *[F.round(k, 10).alias(k) for k in scoring.ALTERNATIVES])


@query("select event_id, 1 + len(substr(props, 1, 5)) - len(replace(substr(props, 1, 5), chr(10), '')) as line, 6 as col, substr(props, 1, 65) || chr(10) || '     ^' as snippet from events where len(props) >= 5")
def error_context(spark, d):
    e = A.read(spark, d, "events").where(F.length("props") >= 5).select("event_id", text.error_context(F.col("props"), F.lit(5)).alias("x"))
    return e.select("event_id", "x.line", "x.col", "x.snippet")
