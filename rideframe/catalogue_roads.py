"""Registered queries over road segments, network matching, spliced routes and what comes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe import catalogue_more, catalogue_rules, storage
from rideframe.catalogue import COSTS, FEATURES
from rideframe.catalogue_routes import NODES, OVERLAP, ends, listed, nodes
from rideframe.catalogue_rules import _FLOW, _PENALTY, WAY_TAGS, tagged, tagged_sql
from rideframe.operators import access, corridors, matching, network, roads, routes, segments, signal, simplify, turns
from rideframe.plans import adapters as A
from rideframe.registry import SQL, query
from rideframe.sources import matches, pbf, readers, stored
from rideframe.streaming import state

#: Roads of the driver's tables: steps of the paths, both ways, whose ends are this close.
ROAD_M = 400.0
ROADS = NODES + ", " + A.EDGES + f""", placed as (select distinct u, v, a.nlat as ulat, a.nlon as ulon, b.nlat as vlat, b.nlon as vlon, {A.HAV.format(a='a.nlat', b='a.nlon', c='b.nlat', d='b.nlon')} as len_m
  from (select distinct u, v from edges) e join nodes a on a.node_id = e.u join nodes b on b.node_id = e.v), roads as (select * from placed where len_m <= {ROAD_M}e0)"""


def road_edges(spark, d, longest: float | None = ROAD_M) -> DataFrame:
    """Directed roads (u, v, len_m, ulat, ulon, vlat, vlon), at most ``longest`` metres long, if given."""
    n = nodes(spark, d)
    # a pair of nodes once, whichever way it is gone and by whatever way
    e = network.pairs(A.node_path(spark, d)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    e = e.join(n.select(F.col("node_id").alias("u"), F.col("nlat").alias("ulat"), F.col("nlon").alias("ulon")), "u")
    e = e.join(n.select(F.col("node_id").alias("v"), F.col("nlat").alias("vlat"), F.col("nlon").alias("vlon")), "v")
    e = e.withColumn("len_m", roads.geo.haversine(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")))
    return e if longest is None else e.where(F.col("len_m") <= longest)


K = f"{roads.DEGREE_M!r}"
PROJECTED = ROADS + f""", t as (select ride_id, seq, lat, lon, cos(radians(lat)) * {K}e0 as kx from trackpoints
), p as (select t.ride_id, t.seq, u, v, len_m, (ulon - lon) * kx as ux, (ulat - lat) * {K}e0 as uy, (vlon - lon) * kx - (ulon - lon) * kx as dx, (vlat - lat) * {K}e0 - (ulat - lat) * {K}e0 as dy from t, roads
  where u < v and lat between least(ulat, vlat) - 0.001e0 and greatest(ulat, vlat) + 0.001e0 and lon between least(ulon, vlon) - 0.002e0 and greatest(ulon, vlon) + 0.002e0
), s as (select *, case when dx * dx + dy * dy > 0 then least(1.0e0, greatest(0.0e0, -(ux * dx + uy * dy) / (dx * dx + dy * dy))) else 0.0e0 end as share from p
), c as (select *, sqrt(pow(ux + share * dx, 2) + pow(uy + share * dy, 2)) as dist from s), near as (select ride_id, seq, min({{'d': round(dist, 3), 'u': u, 'v': v, 'o': share * len_m}}) as b from c where dist <= 60 group by all)"""


@query(f"with {PROJECTED} select t.ride_id, t.seq, b.u as u, b.v as v, round(b.o, 2) as offset_m, b.d as distance_m from trackpoints t left join near n on t.ride_id = n.ride_id and t.seq = n.seq")
def nearest_road(spark, d):
    """The nearest road within 60 m of every point, and the place on it."""
    near = roads.nearest_road(A.trackpoints(spark, d), road_edges(spark, d).where("u < v"), ["ride_id", "seq"], 60.0)
    return near.withColumn("offset_m", F.round("offset_m", 2))


@query()
def viterbi_roads(spark, d):
    """Points matched to directed roads of any length by the ways between them."""
    return roads.network_match(A.trackpoints(spark, d), road_edges(spark, d, None), 60.0, 20.0, 50.0, 400.0, 300.0)


def gapped_chunks(spark, d) -> DataFrame:
    """Chunks of three nodes; those of every third number of ride and chunk have failed."""
    p = A.node_path(spark, d).withColumn("chunk", F.floor(F.col("pos") / 3).cast("long"))
    nodes_ = routes.ordered("pos", F.col("node_id"))
    return p.groupBy("ride_id", "chunk").agg(nodes_.alias("nodes")).withColumn("nodes", F.when((F.col("ride_id") + F.col("chunk")) % 3 != 1, F.col("nodes")))


#: Cheapest ways between all nodes, up to eight edges, by squaring three times; the query has no such end.
SPLICED = A.EDGES + """, w1 as (select u, v, min(coalesce(len_m, 1.0e0))::double as c from edges group by u, v union all select distinct u, u, 0.0e0 from edges
), w2 as (select a.u, b.v, min(a.c + b.c) as c from w1 a join w1 b on a.v = b.u group by all), w4 as (select a.u, b.v, min(a.c + b.c) as c from w2 a join w2 b on a.v = b.u group by all
), w8 as (select a.u, b.v, min(a.c + b.c) as c from w4 a join w4 b on a.v = b.u group by all
), chunks as (select ride_id, pos // 3 as chunk, list(node_id order by pos) as nodes from node_path where (ride_id + pos // 3) % 3 <> 1 group by all
), b as (select *, lag(nodes) over (partition by ride_id order by chunk) as before from chunks
), k as (select *, case when before is null then 0 else """ + OVERLAP.format(a="before", b="nodes", most=64) + """ end as k from b
), steps as (select ride_id, nodes[i] as u, nodes[i + 1] as v from (select ride_id, nodes, unnest(range(greatest(k, 1), len(nodes))) as i from k)
), inside as (select ride_id, sum(c) as c from steps join w1 using (u, v) group by ride_id
), seams as (select ride_id, sum(c) as c, count(*) - count(c) as open_seams from k left join w8 on w8.u = before[len(before)] and w8.v = nodes[1] where before is not null and k = 0 group by ride_id)"""


@query(f"with {SPLICED} select r.ride_id, coalesce(s.open_seams, 0)::bigint as open_seams, round(coalesce(i.c, 0) + coalesce(s.c, 0), 3) as length_m from (select distinct ride_id from chunks) r left join inside i using (ride_id) left join seams s using (ride_id)")
def spliced_totals(spark, d):
    """Length and open seams of every ride as one route, failed chunks filled by ways."""
    route = routes.spliced(gapped_chunks(spark, d), network.edge_index(A.node_path(spark, d)), 64)
    return routes.spliced_totals(route).select("ride_id", "open_seams", F.round("length_m", 3).alias("length_m"))


@query()
def spliced_routes(spark, d):
    """The nodes of every ride as one route, failed chunks filled by ways."""
    return routes.spliced(gapped_chunks(spark, d), network.edge_index(A.node_path(spark, d)), 64)


# ---- one profile, and the turn graph

BOTH_TAGS = {**WAY_TAGS, **catalogue_more.ROAD_TAGS}
JUNCTION_TAGS = {"barrier": ("s_suppkey", 12, {0: "fence", 1: "gate"}), "cargo_bike": ("s_suppkey", 14, {0: "no"}), "highway": ("s_suppkey", 5, {0: "traffic_signals"})}
_SIDE = """case when narrow or cargo_bike = 'no' then 'inaccessible' when bicycle = 'dismount' then 'pushing' when {r} is not null then case when rides then 'cycling' else base_mode end when {p} is not null then 'pushing' else 'inaccessible' end"""
_PACE = """case when narrow or cargo_bike = 'no' then 0.0e0 when bicycle = 'dismount' then 4.0e0 else coalesce({r}, {p}, 0.0e0) end"""
PROFILE = catalogue_more._roads_sql(BOTH_TAGS) + f""", pf as (select *, junction is not null or highway = 'motorway' as implied, coalesce(base_mode, 'cycling') = 'cycling' as rides, coalesce(width = '0.8', false) as narrow from w
), pg as (select *, coalesce({_FLOW.format(c='"oneway:bicycle"')}, {_FLOW.format(c='oneway')}, case when implied then 'forward' end, 'both') as flow,
  coalesce(cycleway = 'lane', false) as la, coalesce("cycleway:left" = 'lane', false) as ll, coalesce("cycleway:right" = 'track', false) as lr, coalesce("cycleway:left" = 'opposite_lane', false) as ol, coalesce("cycleway:right" = 'opposite', false) as opr from pf
), ph as (select *, flow = 'both' and not implied as two_way from pg
), pi as (select *, case when two_way then la or lr or ol else ol or opr or ((la or ll or lr) and flow <> 'backward') end as cycleway_forward, case when two_way then la or ll or opr else ol or opr or ((la or ll or lr) and flow = 'backward') end as cycleway_backward from ph
), pj as (select *, case when rides and cycleway_forward then least(30.0e0, sv, mv) when flow <> 'backward' then base_speed end as rf, case when rides and cycleway_backward then least(30.0e0, sv, mv) when flow <> 'forward' then base_speed end as rb,
  case when coalesce(foot, '') <> 'no' then case when highway = 'footway' or man_made = 'pier' or foot = 'yes' or may_push then 4.0e0 end end as wf, case when coalesce(foot, '') <> 'no' then case when highway = 'footway' or man_made = 'pier' or (foot = 'yes' and not implied) or may_push then 4.0e0 end end as wb from pi
), pm as (select *, {_SIDE.format(r='rf', p='wf')} as forward_mode, {_PACE.format(r='rf', p='wf')} as forward_speed, {_SIDE.format(r='rb', p='wb')} as backward_mode, {_PACE.format(r='rb', p='wb')} as backward_speed from pj
), profiled as (select way_id, flow, forward_mode, backward_mode, forward_speed, backward_speed, forward_speed / 3.6e0 * case when cycleway_forward then 1.0e0 else {_PENALTY} end as forward_rate, backward_speed / 3.6e0 * case when cycleway_backward then 1.0e0 else {_PENALTY} end as backward_rate from pm)"""


@query(f"with {PROFILE} select way_id, flow, forward_mode, backward_mode, forward_speed, backward_speed, round(forward_rate, 6) as forward_rate, round(backward_rate, 6) as backward_rate from profiled")
def profile_ways(spark, d):
    """All rules of ways in one pipeline, with modes, speeds and rates of both directions."""
    out = access.profile_ways(catalogue_more.roads(spark, d, BOTH_TAGS), width=1.0, cargo=True)
    return out.select("way_id", "flow", "forward_mode", "backward_mode", "forward_speed", "backward_speed", F.round("forward_rate", 6).alias("forward_rate"), F.round("backward_rate", 6).alias("backward_rate"))


def profiled_edges(spark, d) -> DataFrame:
    """Roads with the way and direction of the steps that they come from, timed by the profile."""
    e = network.edge_index(A.node_path(spark, d)).select("u", "v", "way_id", "dir").distinct().join(road_edges(spark, d), ["u", "v"])
    return turns.timed_edges(e, access.profile_ways(catalogue_more.roads(spark, d, BOTH_TAGS), width=1.0, cargo=True))


def junction_nodes(spark, d) -> DataFrame:
    n = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), tagged(JUNCTION_TAGS))
    return n.select("node_id", access.node_barrier(cargo=True).alias("barrier"), (F.coalesce(access.tag("highway"), F.lit("")) == "traffic_signals").alias("signal"))


TURNS = ROADS + ", " + PROFILE + f""", te as (select distinct e.u, e.v, e.way_id, e.dir, r.ulat, r.ulon, r.vlat, r.vlon, r.len_m from edges e join roads r on e.u = r.u and e.v = r.v
), tm as (select te.*, case when dir > 0 then forward_mode else backward_mode end as mode, case when dir > 0 then forward_rate else backward_rate end as rate from te join profiled using (way_id)
), tb as (select u, v, min({{'s': len_m / rate, 'w': way_id, 'm': mode, 'a': ulat, 'b': ulon, 'c': vlat, 'd': vlon}}) as b from tm where mode <> 'inaccessible' and rate > 0 group by u, v
), timed as (select u, v, b.w as way_id, b.m as mode, b.s as seconds, degrees(atan2((b.d - b.b) * cos(radians(b.a)), b.c - b.a)) as bearing from tb
), jn as (select s_suppkey as node_id, {tagged_sql(JUNCTION_TAGS)} from supplier
), jj as (select node_id, coalesce(barrier = 'fence', false) or coalesce(cargo_bike = 'no', false) as shut, coalesce(highway = 'traffic_signals', false) as signal from jn
), tt as (select a.u, a.v as via, b.v as w, signal, a.mode as m1, b.mode as m2, b.seconds as s2, case when a.u = b.v then 180.0e0 else (b.bearing - a.bearing) - 360.0e0 * floor((b.bearing - a.bearing + 180.0e0) / 360.0e0) end as degrees from timed a join timed b on a.v = b.u join jj on jj.node_id = a.v where not shut
), turns as (select u, via, w, degrees, {catalogue_more.profile.turn_cost_sql('degrees')} + case when signal then 2.0e0 else 0.0e0 end + case when m1 = 'cycling' and m2 <> 'cycling' then 30.0e0 else 0.0e0 end as weight, s2 from tt)"""


@query(f"with {TURNS} select u, via, w, round(degrees, 4) as degrees, round(weight, 4) as weight, round(weight + s2, 4) as seconds from turns")
def turn_graph(spark, d):
    """Turns from edge to edge with their angles and costs."""
    t = turns.turn_edges(profiled_edges(spark, d), junction_nodes(spark, d))
    return t.select("u", "via", "w", *[F.round(c, 4).alias(c) for c in ("degrees", "weight", "seconds")])


#: The SQL walks so many edges, the query any number.
TURN_HOPS = 24
_WALK = ", ".join(f"h{i} as (select r.src, t.via as a, t.w as b, min(r.c + t.weight + t.s2) as c from h{i - 1} r join turns t on r.a = t.u and r.b = t.via group by all)" for i in range(1, TURN_HOPS))
TURN_ASKED = "asked as (select distinct u, v from (select ride_id, first(node_id order by pos) as u, last(node_id order by pos) as v from node_path group by ride_id) where u <> v)"


@query(f"with {TURNS}, {TURN_ASKED}, h0 as (select u as src, u as a, v as b, seconds as c from timed where u in (select u from asked)), {_WALK}, ha as ({' union all '.join(f'select * from h{i}' for i in range(TURN_HOPS))}), hb as (select src, b, min(c) as c from ha group by all) select k.u, k.v, round(hb.c, 3) as seconds from asked k left join hb on hb.src = k.u and hb.b = k.v")
def turn_paths(spark, d):
    """Quickest rides between the ends of every ride, turns included."""
    out = turns.turn_paths(profiled_edges(spark, d), junction_nodes(spark, d), ends(A.node_path(spark, d)).select("u", "v"))
    return out.select("u", "v", F.round("seconds", 3).alias("seconds"))


# ---- binary maps

def binary_map(spark, d) -> DataFrame:
    """The suppliers as nodes and the rides as ways, as data blobs."""
    n = nodes(spark, d).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("nlat").alias("lat"), F.col("nlon").alias("lon"), F.lit(None).cast("array<long>").alias("nodes"), F.when(F.col("node_id") % 3 == 0, F.create_map(F.lit("barrier"), F.lit("gate"), F.lit("name"), F.concat(F.lit("Straße "), "node_id"))).alias("tags"))
    w = A.node_path(spark, d).groupBy("ride_id").agg(routes.ordered("pos", F.col("node_id")).alias("nodes"))
    w = w.select(F.lit("way").alias("kind"), F.col("ride_id").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "nodes", F.create_map(F.lit("highway"), F.when(F.col("ride_id") % 2 == 0, "primary").otherwise("track")).alias("tags"))
    return pbf.table_blobs(n.unionByName(w), 500)


@query(f"with {NODES} select node_id, round(nlat, 7) as lat, round(nlon, 7) as lon, case when node_id % 3 = 0 then 'Straße ' || node_id end as name from nodes")
def pbf_nodes(spark, d):
    """Nodes of a binary map with their tags."""
    return pbf.map_nodes(pbf.blob_table(binary_map(spark, d), ("node",))).select("node_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.try_element_at("tags", F.lit("name")).alias("name"))


@query(f"with {A.PATH}, p as (select *, lead(node_id) over (partition by ride_id order by pos) as nxt from node_path), e as (select ride_id as way_id, node_id as u, nxt as v, 1 as dir from p where nxt <> node_id union all select ride_id, nxt, node_id, -1 from p where nxt <> node_id) select distinct u, v, way_id, dir::int as dir from e")
def pbf_way_edges(spark, d):
    """Edges of the ways of a binary map."""
    blobs = storage.written(binary_map(spark, d), "map")  # read once for its ways and once for its nodes
    edges = readers.way_edges(pbf.map_ways(pbf.blob_table(blobs, ("way",))), pbf.map_nodes(pbf.blob_table(blobs, ("node",))).drop("tags"), A.path_parts(spark, d))
    return edges.where("u <> v").select("u", "v", "way_id", "dir").distinct()


# ---- fewer points, stored tables

_OFF = """greatest(sqrt(pow(x - share * dx, 2) + pow(y - share * dy, 2)) / 400.0e0, coalesce(abs(elv - (ea + share * (eb - ea))) / 60.0e0, 0.0e0))"""
SIMPLE = A.TRACK + f""", t as (select ride_id, seq, lat, lon, elv from trackpoints where lat is not null and lon is not null), r as (select ride_id, count(*) - 1 as z, list([lat, lon, elv] order by seq) as p from t group by ride_id
), recursive_base as (select ride_id, 0::bigint as a, z as b from r
), walk(ride_id, a, b, k) as (
  select ride_id, a, b, null::bigint from recursive_base union all
  select ride_id, unnest([a, k]) as a, unnest([k, b]) as b, k from (
    select ride_id, a, b, arg_max(i, {{'o': off, 'i': -i}}) as k, max(off) as off from (
      select *, {_OFF} as off from (select *, case when dx * dx + dy * dy > 0 then least(1.0e0, greatest(0.0e0, (x * dx + y * dy) / (dx * dx + dy * dy))) else 0.0e0 end as share from (
        select w.ride_id, w.a, w.b, i, p[i + 1][3] as elv, p[a + 1][3] as ea, p[b + 1][3] as eb, (p[i + 1][2] - p[a + 1][2]) * cos(radians(p[a + 1][1])) * {K}e0 as x, (p[i + 1][1] - p[a + 1][1]) * {K}e0 as y, (p[b + 1][2] - p[a + 1][2]) * cos(radians(p[a + 1][1])) * {K}e0 as dx, (p[b + 1][1] - p[a + 1][1]) * {K}e0 as dy
        from (select *, unnest(range(a + 1, b)) as i from walk where b - a > 1) w join r using (ride_id)))) group by ride_id, a, b) where off > 1
), kept as (select distinct ride_id, unnest([a, b]) as i from walk), numbered as (select ride_id, seq, row_number() over (partition by ride_id order by seq) - 1 as i from t)"""


@query(f"with recursive {SIMPLE} select ride_id, seq from kept join numbered using (ride_id, i)")
def simplified_rides(spark, d):
    """Points that stay so that the others are within 400 m of the line and 60 m of its elevation."""
    return simplify.simplified(A.trackpoints(spark, d), 400.0, 60.0)


THINNED = PROJECTED + f""", sg as (select ride_id, 1.4826e0 * median(b.d) as sigma from near group by ride_id), tol as (select ride_id, greatest(100.0e0, coalesce(20 * sigma, 100.0e0)) as reach from (select distinct ride_id from trackpoints) left join sg using (ride_id)
), pr as (select ride_id, list([{{'seq': seq, 'lat': lat, 'lon': lon, 'r': reach}}] order by seq) as c from trackpoints join tol using (ride_id) group by ride_id)"""


@query(f"with {THINNED}, f as (select ride_id, unnest(list_reduce(c, lambda a, v: case when ({A.HAV.format(a='a[len(a)].lat', b='a[len(a)].lon', c='v[1].lat', d='v[1].lon')}) > a[1].r then a || v else a end)) as k from pr) select ride_id, k.seq as seq from f")
def thinned_by_accuracy(spark, d):
    """Points farther apart than twenty times the accuracy of their ride, told by its distances to the nearest roads."""
    p = A.trackpoints(spark, d)
    near = roads.nearest_road(p, road_edges(spark, d).where("u < v"), ["ride_id", "seq"], 60.0)
    told = simplify.by_accuracy(p, matching.position_sigma(near), 20.0, 100.0)
    return simplify.thinned(told, F.col("tolerance_m"))


@query("with v as (select l_partkey as way_id, l_shipdate as version, l_returnflag as tags from lineitem) select way_id, max(version) as version, (select min(tags) from v w where w.way_id = v.way_id and w.version = max(v.version)) as tags from v group by way_id")
def stored_ways(spark, d):
    """Versions of ways in three batches that come out of order, and one of them twice, merged into a stored table."""
    v = A.read(spark, d, "lineitem").select(F.col("l_partkey").alias("way_id"), F.col("l_shipdate").alias("version"), F.col("l_returnflag").alias("tags"), "l_linenumber")
    schema = ", ".join(f"{c} {t}" for c, t in v.drop("l_linenumber").dtypes)
    table = stored.StoredTable(spark, storage.new_folder(spark, "ways"), "way_id", schema, stored.last_version("way_id", "version"), 16)
    for batch, k in enumerate((1, 0, 0, 2)):
        table.upsert(v.where(F.col("l_linenumber") % 3 == k).drop("l_linenumber"), batch)
    return table.read()


@query(f"with {catalogue_more.LIB.replace(', sg as', FEATURES.removeprefix(COSTS) + ', sg as')} select segment_key, hits, round(mean_tss, 8) as mean_tss, last_ride from e")
def stored_library(spark, d):
    """The segment library as a stored table: the even rides, the odd ones, and the odd ones again, which changes nothing."""
    scored = storage.written(catalogue_more.scored_segments(spark, d), "scored")
    table = stored.StoredTable(spark, storage.new_folder(spark, "library"), "segment_key", "segment_key string, hits long, mean_tss double, last_ride long", segments.merged_library, 16)
    for batch, k in ((1, 0), (2, 1), (2, 1)):
        table.upsert(catalogue_more.library_entries(scored.where(F.col("ride_id") % 2 == k)), batch)
    storage.dropped(scored)
    return table.read().select("segment_key", "hits", F.round("mean_tss", 8).alias("mean_tss"), "last_ride")


# ---- corridors

CELLS = A.TRACK + """, cl as (select distinct ride_id, floor(lat / 0.0004e0)::bigint as cy, floor(lon / 0.0012e0)::bigint as cx from trackpoints where lat is not null and lon is not null
), dc as (select (cy + 1073741824) * 2147483648 + cx + 1073741824 as cell, cy, cx, count(*) as n_rides from cl group by cy, cx having count(*) >= 9
), nb as (select a.cell as u, b.cell as v from dc a join dc b on abs(a.cy - b.cy) <= 1 and abs(a.cx - b.cx) <= 1 and a.cell <> b.cell
), walk(cell, root) as (select cell, cell from dc union select nb.v, walk.root from walk join nb on nb.u = walk.cell
), comp as (select cell, min(root) as corridor from walk group by cell), big as (select corridor from comp group by corridor having count(*) >= 3)"""


@query(f"with recursive {CELLS} select corridor, cell, cy, cx, n_rides from dc join comp using (cell) join big using (corridor)")
def shared_corridors(spark, d):
    """Cells of nine rides or more that hang together, three or more of them."""
    return corridors.corridors(A.trackpoints(spark, d), 0.0004, 0.0012, 9, 3)


@query()
def corridor_paths(spark, d):
    """A path from end to end of every shared corridor."""
    return corridors.corridor_paths(corridors.corridors(A.trackpoints(spark, d), 0.0004, 0.0012, 9, 3))


# ---- streams

def stream_points(spark, d) -> DataFrame:
    e = A.trackpoints(spark, d).select("ride_id", F.col("event_id").alias("point_id"), F.timestamp_micros(F.col("t_us") + F.lit(1_704_067_200_000_000)).alias("time"), "lat", "lon")
    return e.select(*[F.col(c).cast(t) for c, t in (x.split() for x in state.POINTS.split(", "))])


DAY_US = 86_400_000_000
TRACKED = A.TRACK + f""", g as (select *, case when t_us - lag(t_us) over w > {DAY_US} then 1 else 0 end as cut from trackpoints window w as (partition by ride_id order by t_us, event_id)
), p as (select *, cast(sum(cut) over (partition by ride_id order by t_us, event_id rows unbounded preceding) as bigint) as part from g
), l as (select *, lag(lat) over w as plat, lag(lon) over w as plon from p window w as (partition by ride_id, part order by t_us, event_id)
), s as (select *, coalesce(cast(round(1000 * {A.HAV.format(a='plat', b='plon', c='lat', d='lon')}) as bigint), 0) as step_mm from l)"""


#: Files that the stream of points takes at a time.
FILES = 8


@query(f"with {TRACKED} select ride_id, event_id as point_id, part, step_mm, cast(sum(step_mm) over (partition by ride_id order by t_us, event_id rows unbounded preceding) as bigint) as cum_mm from s")
def streamed_rides(spark, d):
    """Parts and running distances of all rides, from a stream whose points come up to a day late and in any order within days.

    The points are written in the order of their arrival, a folder's files at a time, and
    followed by two points of a later year that move the watermark past all of them.
    """
    points = stream_points(spark, d)
    source, out, weeks = (storage.new_folder(spark, name) for name in ("points", "tracked", "weeks"))
    arrived = F.unix_micros("time") + F.pmod(F.xxhash64("point_id"), F.lit(DAY_US))
    points.withColumn("week", F.floor(arrived / (7 * DAY_US))).write.partitionBy("week").parquet(weeks)
    table = spark.read.schema(f"{state.POINTS}, week long").parquet(weeks)
    # a week is one batch of the stream, however many points it has
    for (week,) in table.select("week").distinct().orderBy("week").collect():
        table.where(F.col("week") == week).drop("week").coalesce(FILES).write.mode("append").parquet(source)
    for year in (2050, 2051):
        end = spark.range(1).select(F.lit(-1).alias("ride_id"), F.lit(-1).alias("point_id"), F.lit(f"{year}-01-01").cast("timestamp").alias("time"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
        end.select(*[F.col(c).cast(t) for c, t in (x.split() for x in state.POINTS.split(", "))]).write.mode("append").parquet(source)
    stream = spark.readStream.schema(state.POINTS).option("maxFilesPerTrigger", FILES).parquet(source)
    tracked = state.tracked_stream(stream, 86_400.0, "10 days")
    tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracked.schema).parquet(out).where("ride_id >= 0").select("ride_id", "point_id", "part", "step_mm", "cum_mm")


def most_hits(rows: DataFrame) -> DataFrame:
    """The latest state of each entry: that of most hits."""
    return rows.groupBy("segment_key").agg(F.max(F.struct("hits", "mean_tss", "last_ride")).alias("e")).select("segment_key", "e.*")


@query(f"with {catalogue_more.LIB.replace(', sg as', FEATURES.removeprefix(COSTS) + ', sg as')} select segment_key, hits, round(mean_tss, 8) as mean_tss, last_ride from e")
def streamed_library(spark, d):
    """The segment library from a stream of scored segments: running means in state, merged batch by batch into a stored table."""
    source, out = storage.new_folder(spark, "scores"), storage.new_folder(spark, "library")
    scored = catalogue_more.scored_segments(spark, d).select("segment_key", "ride_id", "tss")
    scored.repartition(8, "ride_id").write.parquet(source)
    table = stored.StoredTable(spark, out, "segment_key", state.LIBRARY, most_hits, 16)
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 3).parquet(source)
    entries = state.library_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state")
    entries.foreachBatch(lambda rows, batch: table.upsert(rows, batch) and None).trigger(availableNow=True).start().awaitTermination()
    return table.read().select("segment_key", "hits", F.round("mean_tss", 8).alias("mean_tss"), "last_ride")


# ---- proposals by attributes, complete features, rides of files

ATTRIBUTES = catalogue_more.GRADED + ", " + A.WAYS + f""", pw as (select g.*, {catalogue_more.SPEED} as speed, 1 + (ride_id + seq // 7) % 20 as way_id from graded g
), ax as (select pw.*, w.highway, w.surface from pw left join ways w using (way_id)
), why as (select ride_id, seq, cum_mm, case when highway is distinct from lag(highway) over w then 'highway' when surface is distinct from lag(surface) over w then 'surface' when abs(delta) > 3.0e0 then 'turn' when speed < 0.001e0 then 'stop' end as why, row_number() over w as n from ax window w as (partition by ride_id order by seq)
), cuts as (select ride_id, list([{{'seq': seq, 'at': cum_mm, 'why': why}}] order by seq) as c from why where why is not null and n > 1 group by ride_id
), kept as (select ride_id, unnest(list_reduce(c, lambda a, x: case when x[1].at - a[len(a)].at >= 1500000 then a || x else a end)) as k from cuts)"""


@query(f"with {ATTRIBUTES} select ride_id, k.seq as seq, k.why as why from kept")
def attribute_proposals(spark, d):
    """Boundaries where class or surface change, at turns and stops, with the guard of 1500 m; a change of way alone is none."""
    p = signal.route_signal(A.trackpoints(spark, d)).withColumn("way", 1 + (F.col("ride_id") + F.floor(F.col("seq") / 7)) % 20)
    p = p.join(A.ways(spark, d).select(F.col("way_id").alias("way"), "highway", "surface"), "way", "left").withColumn("way_id", F.lit(0))
    return segments.propose_boundaries(p, 3.0, 0.001, 1500.0, ["highway", "surface"]).select("ride_id", "seq", "why")


COMPLETE = PROJECTED + ", " + A.WAYS + ", " + catalogue_more.RIDE_FEATURES.removeprefix(A.TRACK + ", ") + f""", jc as (select u as node_id from edges group by u having count(distinct v) >= 3), jn as (select n.* from nodes n join jc using (node_id)
), jm as (select ride_id, seq // 9 as segment, count(distinct node_id) as n_junctions from (select ride_id, seq, node_id, {A.HAV.format(a='lat', b='lon', c='nlat', d='nlon')} as dist from trackpoints, jn where abs(lat - nlat) < 0.001e0) where dist <= 40 group by all
), ru as (select ride_id, seq, w.highway, w.surface, w.maxspeed from near left join ways w on w.way_id = 1 + (b.u + b.v) % 100
), rs as (select g.ride_id, g.seq // 9 as segment, g.step_mm, ru.* exclude (ride_id, seq) from graded g left join ru on g.ride_id = ru.ride_id and g.seq = ru.seq
), rr as (select ride_id, segment, sum(step_mm) filter (highway is not null) as road_mm, sum(step_mm) as all_mm, sum(step_mm) filter (surface in ('asphalt', 'concrete', 'paved', 'paving_stones')) as paved_mm, sum(maxspeed * step_mm) as speed_mm, sum(step_mm) filter (maxspeed is not null) as limit_mm, count(distinct highway) as n_classes from rs group by all)"""


@query(f"""with {COMPLETE} select ride_id, segment, round(length_m, 3) as length_m, round(gain_m, 4) as gain_m, round(mean_grade, 4) as mean_grade, stops, coalesce(n_junctions, 0) as n_junctions, round(coalesce(n_junctions, 0) / greatest(length_m / 1000.0e0, 0.1e0), 4) as junctions_per_km,
  round(coalesce(road_mm, 0) / nullif(all_mm, 0)::double, 6) as on_road, round(coalesce(paved_mm, 0) / nullif(coalesce(road_mm, 0), 0)::double, 6) as paved_share, round(speed_mm / nullif(coalesce(limit_mm, 0), 0)::double, 6) as mean_maxspeed, n_classes from fx left join rr using (ride_id, segment) left join jm using (ride_id, segment)""")
def complete_features(spark, d):
    """Features of the ride and of its road, with the junctions met, of every segment in one table."""
    track = A.trackpoints(spark, d)
    p = signal.curvature(signal.route_signal(track)).withColumn("segment", F.floor(F.col("seq") / 9).cast("long"))
    busy = network.junctions(network.edge_index(A.node_path(spark, d))).join(nodes(spark, d), "node_id")
    met = matching.candidates(track, matching.places(busy), ["ride_id", "seq"], 40.0).select("ride_id", "seq", "node_id", "n_nodes")
    near = roads.nearest_road(track, road_edges(spark, d).where("u < v"), ["ride_id", "seq"], 60.0)
    under = near.withColumn("way_id", 1 + (F.col("u") + F.col("v")) % 100).join(A.ways(spark, d), "way_id").select("ride_id", "seq", "highway", "surface", "maxspeed")
    out = segments.complete_features(p, "segment", met, under)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("ride_id", "segment", r("length_m", 3), r("gain_m", 4), r("mean_grade", 4), "stops", "n_junctions", r("junctions_per_km", 4), r("on_road", 6), r("paved_share", 6), r("mean_maxspeed", 6), "n_classes")


@query(f"with {A.TRACK} select ride_id, seq // 50 as segment, cast(seq % 50 as int) as i, seq, lat, lon, elv from trackpoints")
def gpx_rides(spark, d):
    """Rides of files of one ride each, in segments of 50 points, with ride, segment and order as read."""
    point = F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele></trkpt>', *[F.col(c).cast("string") for c in ("lat", "lon", "elv")])
    lines = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 50).alias("part")).agg(F.concat(F.lit("<trkseg>"), F.array_join(routes.ordered("seq", point), "\n"), F.lit("</trkseg>")).alias("line"))
    whole = lines.groupBy("ride_id").agg(F.concat(F.lit("<gpx>\n"), F.array_join(routes.ordered("part", F.col("line")), "\n"), F.lit("\n</gpx>")).alias("text"))
    folder = storage.new_folder(spark, "rides")
    storage.write_folders(whole.withColumnRenamed("ride_id", "ride"), folder, "ride", F.col("text"), [], "gpx")
    back = readers.read_gpx(spark, folder, r"/ride=(-?[0-9]+)/")
    return back.select(F.col("ride_id").cast("long").alias("ride_id"), "segment", "i", "seq", "lat", "lon", "elv")


@query(f"with n as (select s_suppkey as node_id, {tagged_sql(JUNCTION_TAGS)} from supplier) select node_id, coalesce(barrier = 'fence', false) or coalesce(cargo_bike = 'no', false) as barrier, coalesce(highway = 'traffic_signals', false) as signal from n")
def profile_nodes(spark, d):
    """Barriers of nodes, to cargo bikes too, and traffic lights."""
    return junction_nodes(spark, d)


# ---- files of chunks, requests and matches

@query(SQL["chunk_payload"])
def payload_files(spark, d):
    """Chunk payloads written as JSON, a folder a ride, and read back with their schema."""
    path = storage.new_folder(spark, "payloads")
    matches.write_payloads(catalogue_rules.chunk_payload(spark, d), path)
    return matches.read_payloads(spark, path).select("ride_id", "n", "coordinates_e6", "timestamps", "radiuses", "chunk")


@query(f"with p as ({SQL['chunk_payload']}) select ride_id, chunk, 'annotations=nodes,distance&gaps=ignore&geometries=geojson&overview=full&radiuses=' || radiuses || '&steps=false&tidy=true&timestamps=' || timestamps as parameters from p")
def match_requests(spark, d):
    """The parameters of the request of every chunk, by name."""
    asked = matches.match_requests(catalogue_rules.chunk_payload(spark, d), F.col("coordinates_e6"))
    told = F.transform(F.array_sort(F.map_entries("parameters")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return asked.select("ride_id", "chunk", F.array_join(told, "&").alias("parameters"))


@query(f"with m as ({SQL['match_results']}) select ride_id, code, route_nodes, case when matched then 'matched' else 'gap' end as status from m")
def match_files(spark, d):
    """Results written as JSON, those without a matching apart as gaps, and read back."""
    r = catalogue_more.results(spark, d)
    path = storage.new_folder(spark, "matches")
    matches.write_matches(r, path)
    back = matches.read_matches(spark, path, ", ".join(f"{c} {t}" for c, t in r.dtypes))
    return back.select("ride_id", "code", listed(F.col("route_nodes")).alias("route_nodes"), "status")
