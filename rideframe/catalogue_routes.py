"""Registered queries over routes: seams, runs, connectors, matching, profile, library and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.operators import matching, network, profile, routes, scoring, segments, signal
from rideframe.plans import adapters as A
from rideframe.registry import query

CHUNK = A.PATH + ", chunks as (select ride_id, pos // 3 as chunk, list(node_id % 4 order by pos) as nodes from node_path group by all)"
OVERLAP = "coalesce(list_max(list_filter(range(1, least(len({a}), len({b}), {most}) + 1), lambda k: {a}[len({a}) - k + 1 : len({a})] = {b}[1 : k])), 0)"
RUNS = """, f as (select *, case when row_number() over w > 1 and way_id % 3 is not distinct from lag(way_id % 3) over w then 0 else 1 end as new from node_path window w as (partition by ride_id order by pos)
), g as (select *, sum(new) over (partition by ride_id order by pos) - 1 as run_idx from f
), runs as (select ride_id, cast(run_idx as bigint) as run_idx, any_value(way_id % 3) as way_group, min(pos) as start_pos, count(*) as n, sum(len_m) as length_m from g group by ride_id, run_idx)"""


def chunks(spark, d) -> DataFrame:
    p = A.node_path(spark, d).withColumn("chunk", F.floor(F.col("pos") / 3).cast("long"))
    return p.groupBy("ride_id", "chunk").agg(routes.ordered("pos", F.col("node_id") % 4).alias("nodes"))


def runs(spark, d) -> DataFrame:
    return network.run_lengths(A.node_path(spark, d).withColumn("way_group", F.col("way_id") % 3), ["way_group"])


def listed(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ";")


def _flatten_sql(most: int) -> str:
    return f"""with {CHUNK}, legs as (select ride_id, list(nodes order by chunk) as legs from chunks group by ride_id
), joined as (select ride_id, list_reduce(legs, lambda a, x: a || x[{OVERLAP.format(a='a', b='x', most=most)} + 1 : len(x)]) as j from legs)
select ride_id, array_to_string(list_filter(j, lambda x, i: i = 1 or x <> j[i - 1]), ';') as nodes from joined"""


def _flatten(spark, d, most: int) -> DataFrame:
    legs = chunks(spark, d).groupBy("ride_id").agg(routes.ordered("chunk", F.col("nodes")).alias("legs"))
    return routes.flatten_nodes(legs, most).select("ride_id", listed(F.col("nodes")).alias("nodes"))


@query(_flatten_sql(1))
def flatten_nodes_k1(spark, d):
    return _flatten(spark, d, 1)


@query(_flatten_sql(8))
def flatten_nodes_k8(spark, d):
    return _flatten(spark, d, 8)


@query(_flatten_sql(16))
def flatten_nodes(spark, d):
    return _flatten(spark, d, 16)


def _seams_sql(most: int) -> str:
    return f"{CHUNK}, pairs as (select *, lead(nodes) over (partition by ride_id order by chunk) as b from chunks), seams as (select ride_id, chunk, {OVERLAP.format(a='nodes', b='b', most=most)}::int as k from pairs where b is not null)"


def _seams(spark, d, most: int) -> DataFrame:
    c = chunks(spark, d).withColumn("b", F.lead("nodes").over(Window.partitionBy("ride_id").orderBy("chunk"))).where("b is not null")
    return c.select("ride_id", "chunk", network.overlap(F.col("nodes"), F.col("b"), most).alias("k"))


@query(f"with {_seams_sql(200)} select ride_id, chunk, k as overlap from seams")
def seam_overlap_200(spark, d):
    return _seams(spark, d, 200).withColumnRenamed("k", "overlap")


@query(f"with {_seams_sql(50)} select least(10, k)::int as overlap, count(*) as seams, min(k)::int as least_k, max(k)::int as most_k from seams group by 1")
def overlap_histogram(spark, d):
    return _seams(spark, d, 50).groupBy(F.least(F.lit(10), "k").alias("overlap")).agg(F.count("*").alias("seams"), F.min("k").alias("least_k"), F.max("k").alias("most_k"))


@query(f"""with {CHUNK}, b as (select *, lag(nodes) over (partition by ride_id order by chunk) as before from chunks
), k as (select *, case when before is not null then {OVERLAP.format(a='before', b='nodes', most=64)} end as k from b)
select ride_id, array_to_string(flatten(list(nodes[coalesce(k, 0) + 1 : len(nodes)] order by chunk)), ';') as nodes, count(*) as n_chunks, count(*) filter (k = 0) as open_seams from k group by ride_id""")
def merge_chunks(spark, d):
    return routes.merge_chunks(chunks(spark, d), 64).withColumn("nodes", listed(F.col("nodes")))


@query(f"with {A.PATH}{RUNS} select ride_id, count(*) as n_runs, sum(n)::bigint as n_steps, sum(n) = max(start_pos + n) as consistent from runs group by ride_id")
def runs_consistency(spark, d):
    return runs(spark, d).groupBy("ride_id").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_steps"), (F.sum("n") == F.max(F.col("start_pos") + F.col("n"))).alias("consistent"))


@query(f"""with {A.PATH}{RUNS}, c as (select *, sum(n) over (partition by ride_id order by run_idx rows unbounded preceding) as upto from runs
), l as (select *, least(n, greatest(0, upto - 2))::bigint as left_n from c)
select ride_id, run_idx, way_group, left_n as n, round(length_m * left_n / n, 3) as length_m from l where left_n > 0""")
def trim_runs(spark, d):
    return routes.trim_runs(runs(spark, d), 2).select("ride_id", "run_idx", "way_group", "n", F.round("length_m", 3).alias("length_m"))


@query(f"with {A.PATH}{RUNS} select ride_id, run_idx, way_group, n, round(length_m, 3) as length_m from runs")
def merge_run_lists(spark, d):
    p = A.node_path(spark, d).withColumn("way_group", F.col("way_id") % 3)
    return routes.merge_run_lists(routes.chunk_runs(p, 3, ["way_group"]), ["way_group"]).select("ride_id", "run_idx", "way_group", "n", F.round("length_m", 3).alias("length_m"))


@query(f"with {A.PATH}{RUNS} select r.ride_id, r.run_idx, array_to_string(list(p.node_id order by p.pos), ';') as nodes from runs r join node_path p on p.ride_id = r.ride_id and p.pos between r.start_pos and r.start_pos + r.n group by all")
def slice_by_runs(spark, d):
    """Nodes of each run with the one that follows it: every step tells its run, and the first of a run the one before too."""
    w = network.path_order()
    p = A.node_path(spark, d).withColumn("way_group", F.col("way_id") % 3)
    p = p.withColumn("new", F.when((F.row_number().over(w) > 1) & F.col("way_group").eqNullSafe(F.lag("way_group").over(w)), 0).otherwise(1))
    p = p.withColumn("run_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    of = F.when((F.col("new") == 1) & (F.col("run_idx") > 0), F.array("run_idx", F.col("run_idx") - 1)).otherwise(F.array("run_idx"))
    return p.select("ride_id", "pos", "node_id", F.explode(of).alias("run_idx")).groupBy("ride_id", "run_idx").agg(listed(routes.ordered("pos", F.col("node_id"))).alias("nodes"))


@query(f"with {A.PATH}, l1 as (select ride_id, pos // 2 as i, avg(len_m) as c from node_path group by all), l2 as (select ride_id, i // 2 as i, avg(c) as c from l1 group by all), l3 as (select ride_id, i // 2 as i, avg(c) as c from l2 group by all), l4 as (select ride_id, i // 2 as i, avg(c) as c from l3 group by all), l5 as (select ride_id, i // 2 as i, avg(c) as c from l4 group by all), l6 as (select ride_id, i // 2 as i, avg(c) as c from l5 group by all) select ride_id, round(c, 6) as confidence from l6")
def confidence_merge(spark, d):
    p = A.node_path(spark, d).groupBy("ride_id").agg(routes.ordered("pos", F.col("len_m")).alias("c"))
    return p.select("ride_id", F.round(routes.tree_mean(F.col("c")), 6).alias("confidence"))


@query(f"with {A.PATH} select ride_id, case when bool_and(len_m > 1) then 'Ok' else 'Failed' end as status from node_path group by ride_id")
def status_merge(spark, d):
    return A.node_path(spark, d).groupBy("ride_id").agg(F.when(F.every(F.col("len_m") > 1), "Ok").otherwise("Failed").alias("status"))


def ends(p: DataFrame) -> DataFrame:
    return p.groupBy("ride_id").agg(F.min_by("node_id", "pos").alias("u"), F.max_by("node_id", "pos").alias("v")).where("u <> v")


HOPS = 3
ASKED = "asked as (select distinct u, v from (select ride_id, first(node_id order by pos) as u, last(node_id order by pos) as v from node_path group by ride_id) where u <> v)"


@query(f"""with {A.EDGES}, steps as (select u as node, v as nxt, min(coalesce(len_m, 1.0e0)) as step from edges group by u, v), {ASKED},
r0 as (select distinct u, u as node, 0.0e0 as cost from asked),
""" + ", ".join(f"r{i} as (select r.u, s.nxt as node, min(r.cost + s.step) as cost from r{i - 1} r join steps s on r.node = s.node group by r.u, s.nxt)" for i in range(1, HOPS + 1))
    + ", done as (" + " union all ".join(f"select * from r{i}" for i in range(HOPS + 1)) + ") select a.u, a.v, min(d.cost) as length_m from asked a left join done d on a.u = d.u and a.v = d.node group by a.u, a.v")
def connector_path(spark, d):
    """Lengths of any number of edges; the SQL stops at HOPS edges, so it has larger or no lengths where the cheapest path has more."""
    p = A.node_path(spark, d)
    return routes.connectors(network.edge_index(p), ends(p))


@query()
def connector_nodes(spark, d):
    p = A.node_path(spark, d)
    return routes.connector_nodes(network.edge_index(p), ends(p))


NODES = A.TRACK + ", nodes as (select s_suppkey as node_id, 51.5e0 + (s_suppkey * 37 % 100) / 10000.0e0 as nlat, -0.12e0 + (s_suppkey * 53 % 500) / 10000.0e0 as nlon from supplier)"
REACH = 60.0
CANDIDATES = NODES + f", met as (select * from (select ride_id, seq, node_id, {A.HAV.format(a='lat', b='lon', c='nlat', d='nlon')} as distance_m from trackpoints, nodes where abs(lat - nlat) < 0.001e0) where distance_m <= {REACH}e0)"
NEAREST = CANDIDATES + ", near as (select ride_id, seq, min({'d': round(distance_m, 3), 'n': node_id}) as b from met group by all)"


def nodes(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return A.read(spark, d, "supplier").select(k.alias("node_id"), (51.5 + (k * 37 % 100) / 10000.0).alias("nlat"), (-0.12 + (k * 53 % 500) / 10000.0).alias("nlon"))


@query(f"with {NEAREST} select t.ride_id, t.seq, b.n as node_id, b.d as distance_m from trackpoints t left join near n on t.ride_id = n.ride_id and t.seq = n.seq")
def nearest_node(spark, d):
    return matching.nearest(A.trackpoints(spark, d), nodes(spark, d), ["ride_id", "seq"], REACH)


@query(f"with {NEAREST} select t.ride_id, t.seq, b.d as distance_m from trackpoints t left join near n on t.ride_id = n.ride_id and t.seq = n.seq where b.d is null or b.d > 30")
def bad_match_report(spark, d):
    return nearest_node(spark, d).where("distance_m is null or distance_m > 30").select("ride_id", "seq", "distance_m")


@query(f"with {CANDIDATES}, hits as (select node_id, count(*) as hits from met group by node_id) select node_id, hits from hits where hits >= 3")
def spur_prune(spark, d):
    return matching.hits(A.trackpoints(spark, d), nodes(spark, d), ["ride_id", "seq"], REACH).where("hits >= 3")


@query(f"with {A.PATH}, nodes as (select s_suppkey as node_id, 51.5e0 + (s_suppkey * 37 % 100) / 10000.0e0 as nlat, -0.12e0 + (s_suppkey * 53 % 500) / 10000.0e0 as nlon from supplier) select ride_id, pos, node_id, nlat as lat, nlon as lon from node_path left join nodes using (node_id)")
def node_coordinates(spark, d):
    return A.node_path(spark, d).join(nodes(spark, d), "node_id", "left").select("ride_id", "pos", "node_id", F.col("nlat").alias("lat"), F.col("nlon").alias("lon"))


@query()
def viterbi_match(spark, d):
    p = A.trackpoints(spark, d).withColumn("chunk", F.floor(F.col("seq") / 200).cast("long"))
    return matching.viterbi(p, nodes(spark, d), 200.0, 20.0, 50.0)


@query(f"with {A.TRACK}, r as (select ride_id, list([{{'seq': seq, 'z': elv, 'x': elv, 'p': 25.0e0}}] order by seq) as c from trackpoints group by ride_id), f as (select ride_id, unnest(list_reduce(c, lambda a, v: a || [{{'seq': v[1].seq, 'z': v[1].z, 'x': a[len(a)].x + (a[len(a)].p + 1) / (a[len(a)].p + 1 + 25) * (v[1].z - a[len(a)].x), 'p': (1 - (a[len(a)].p + 1) / (a[len(a)].p + 1 + 25)) * (a[len(a)].p + 1)}}])) as k from r) select ride_id, k.seq as seq, round(k.x, 6) as smoothed from f")
def kalman_smooth(spark, d):
    return matching.kalman(A.trackpoints(spark, d), "elv", 1.0, 25.0).withColumn("smoothed", F.round("smoothed", 6))


@query(f"with {A.TRACK}, r as (select ride_id, list([{{'seq': seq, 'lat': lat, 'lon': lon}}] order by seq) as c from trackpoints group by ride_id), f as (select ride_id, unnest(list_reduce(c, lambda a, v: case when ({A.HAV.format(a='a[len(a)].lat', b='a[len(a)].lon', c='v[1].lat', d='v[1].lon')}) > 500 then a || v else a end)) as k from r) select ride_id, k.seq as seq from f")
def point_thinning(spark, d):
    return matching.thin(A.trackpoints(spark, d), 500.0)


@query(f"with {A.GRADED}, r as (select ride_id, list([{{'seq': seq, 'at': cum_mm / 1000.0e0, 'least': 4000.0e0 - 2800.0e0 * least(abs({A.GRADIENT}), 10.0e0) / 10, 'begin': 0.0e0, 'segment': 0::bigint}}] order by seq) as c from graded group by ride_id), f as (select ride_id, unnest(list_reduce(c, lambda a, v: a || case when v[1].at - a[len(a)].begin >= v[1].least then [{{'seq': v[1].seq, 'at': v[1].at, 'least': v[1].least, 'begin': v[1].at, 'segment': a[len(a)].segment + 1}}] else [{{'seq': v[1].seq, 'at': v[1].at, 'least': v[1].least, 'begin': a[len(a)].begin, 'segment': a[len(a)].segment}}] end)) as k from r) select ride_id, k.seq as seq, k.segment as segment_id from f")
def adaptive_segments(spark, d):
    p = signal.with_gradient(signal.with_distance(A.trackpoints(spark, d)), 2000).withColumn("gradient_pct", F.round("gradient_pct", 4))
    return matching.adaptive_segments(p, 4000.0, 1200.0)


_WHOLE = "cast(round({c} * 1e5) as bigint)"
_DELTA = _WHOLE + " - coalesce(lag(" + _WHOLE + ") over w, 0)"
_LETTERS = "array_to_string(list_transform(list_filter(range(8), lambda i: i = 0 or ({z} >> (5 * i)::int) > 0), lambda i: chr(((({z} >> (5 * i)::int) % 32) + case when ({z} >> (5 * i + 5)::int) > 0 then 32 else 0 end + 63)::int)), '')"
POLYLINE = A.TRACK + f""", dd as (select ride_id, seq // 200 as chunk, seq, {_DELTA.format(c='lat')} as a, {_DELTA.format(c='lon')} as b from trackpoints window w as (partition by ride_id, seq // 200 order by seq)
), z as (select ride_id, chunk, seq, case when a < 0 then -2 * a - 1 else 2 * a end as a, case when b < 0 then -2 * b - 1 else 2 * b end as b from dd)"""


@query(f"with {POLYLINE} select ride_id, chunk, string_agg({_LETTERS.format(z='a')} || {_LETTERS.format(z='b')}, '' order by seq) as polyline, count(*)::int as n, count(*)::int as n_back, true as same_points from z group by ride_id, chunk")
def polyline_roundtrip(spark, d):
    """Polylines of chunks of 200 points, and whether the points come back from them."""
    p = A.trackpoints(spark, d).groupBy("ride_id", F.floor(F.col("seq") / 200).cast("long").alias("chunk")).agg(routes.ordered("seq", F.struct("lat", "lon")).alias("points"))
    p = p.withColumn("polyline", routes.polyline(F.col("points"))).withColumn("back", routes.decode_polyline(F.col("polyline")))
    off = F.aggregate(F.zip_with("points", "back", lambda a, b: F.greatest(F.abs(a["lat"] - b["lat"]), F.abs(a["lon"] - b["lon"]))), F.lit(0.0), lambda worst, x: F.greatest(worst, x))
    return p.select("ride_id", "chunk", "polyline", F.size("points").alias("n"), F.size("back").alias("n_back"), (off <= 0.51e-5).alias("same_points"))


TIMED = A.SIGNAL + ", c as (select *, seq // 50 as chunk from sig), d as (select *, first(t_us) over w as t0, last(t_us) over w as t1, cum_mm - first(cum_mm) over w as along, last(cum_mm) over w - first(cum_mm) over w as total, row_number() over (partition by ride_id, chunk order by seq) - 1 as i, count(*) over w as n from c window w as (partition by ride_id, chunk order by seq rows between unbounded preceding and unbounded following))"


@query(f"with {TIMED} select ride_id, seq, t0 + cast(floor((t1 - t0) * case when total > 0 then along::double / total when n > 1 then i::double / (n - 1) else 0.0e0 end) as bigint) as node_us from d")
def node_times(spark, d):
    p = signal.with_distance(A.trackpoints(spark, d)).withColumn("chunk", F.floor(F.col("seq") / 50).cast("long"))
    o = Window.partitionBy("ride_id", "chunk").orderBy("seq")
    w = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t0, t1, c0 = F.first("t_us").over(w), F.last("t_us").over(w), F.first("cum_mm").over(w)
    total, n = F.last("cum_mm").over(w) - c0, F.count("*").over(w)
    share = F.when(total > 0, (F.col("cum_mm") - c0) / total).when(n > 1, (F.row_number().over(o) - 1) / (n - 1)).otherwise(0.0)
    return p.select("ride_id", "seq", (t0 + F.floor((t1 - t0) * share).cast("long")).alias("node_us"))


@query(f"with {A.TRACK}, m as (select *, elv > 100 as matched, lead(elv > 100) over (partition by ride_id order by seq) as nxt from trackpoints) select ride_id, seq, seq + 1 as next_seq from m where matched and nxt")
def adjacent_waypoints(spark, d):
    p = A.trackpoints(spark, d).select("ride_id", "seq", (F.col("elv") > 100).alias("matched"))
    return p.withColumn("nxt", F.lead("matched").over(signal.ride())).where("matched and nxt").select("ride_id", "seq", (F.col("seq") + 1).alias("next_seq"))


WAYPOINTS = A.TRACK + """, m as (select *, seq // 20 as chunk, elv > 100 as matched from trackpoints
), i as (select *, case when matched then sum(matched::int) over (partition by ride_id, chunk order by seq) - 1 end as wp from m
), o as (select ride_id, chunk, coalesce(max(wp), -1) + 1 as n from i group by all
), s as (select ride_id, chunk, n, sum(n) over (partition by ride_id order by chunk) - n as off from o)"""


def waypoints(spark, d) -> DataFrame:
    p = A.trackpoints(spark, d).select("ride_id", "seq", F.floor(F.col("seq") / 20).cast("long").alias("chunk"), (F.col("elv") > 100).alias("matched"))
    own = F.sum(F.col("matched").cast("long")).over(Window.partitionBy("ride_id", "chunk").orderBy("seq")) - 1
    return p.withColumn("wp", F.when(F.col("matched"), own))


@query(f"with {WAYPOINTS} select i.ride_id, i.seq, cast(wp + off as bigint) as waypoint_index from i join s using (ride_id, chunk)")
def waypoint_renumber(spark, d):
    p = waypoints(spark, d)
    n = p.groupBy("ride_id", "chunk").agg((F.coalesce(F.max("wp"), F.lit(-1)) + 1).alias("n"))
    off = n.select("ride_id", "chunk", (F.sum("n").over(Window.partitionBy("ride_id").orderBy("chunk")) - F.col("n")).alias("off"))
    return p.join(off, ["ride_id", "chunk"]).select("ride_id", "seq", (F.col("wp") + F.col("off")).alias("waypoint_index"))


@query(f"with {WAYPOINTS} select ride_id, chunk, cast(n - 1 as bigint) as max_waypoint from s")
def max_waypoint(spark, d):
    return waypoints(spark, d).groupBy("ride_id", "chunk").agg(F.coalesce(F.max("wp"), F.lit(-1)).alias("max_waypoint"))


@query(f"with {WAYPOINTS} select ride_id, chunk from i group by all having not bool_or(matched)")
def gap_chunks(spark, d):
    return waypoints(spark, d).groupBy("ride_id", "chunk").agg(F.some("matched").alias("any")).where("not any").select("ride_id", "chunk")


@query(f"with {WAYPOINTS} select ride_id, count(distinct chunk) as legs, count(*) as points, count(*) filter (not matched) as unmatched from i group by ride_id")
def response_summary(spark, d):
    return waypoints(spark, d).groupBy("ride_id").agg(F.count_distinct("chunk").alias("legs"), F.count("*").alias("points"), F.count_if(~F.col("matched")).alias("unmatched"))


LERP = A.SIGNAL + ", l as (select ride_id, seq, cum_mm, lag(cum_mm) over w as c0, lat, lon, plat, plon from sig window w as (partition by ride_id order by seq)), x as (select *, unnest(range(c0 // 1000000 + 1, cum_mm // 1000000 + 1)) as km from l where c0 is not null)"


@query(f"with {LERP} select ride_id, km, round(plat + (lat - plat) * ((km * 1000000 - c0)::double / (cum_mm - c0)), 9) as lat, round(plon + (lon - plon) * ((km * 1000000 - c0)::double / (cum_mm - c0)), 9) as lon from x")
def point_at_distance(spark, d):
    """The point at each full kilometre of a ride: every step emits those that it passes, so nothing is joined."""
    w = signal.ride()
    p = signal.with_distance(A.trackpoints(spark, d)).select("ride_id", "cum_mm", F.lag("cum_mm").over(w).alias("c0"), "lat", "lon", F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon"))
    first, last = F.floor(F.col("c0") / 1e6) + 1, F.floor(F.col("cum_mm") / 1e6)
    p = p.where(F.col("c0").isNotNull() & (last >= first)).withColumn("km", F.explode(F.sequence(first, last)))
    share = (F.col("km") * 1_000_000 - F.col("c0")) / (F.col("cum_mm") - F.col("c0"))
    return p.select("ride_id", "km", F.round(F.col("plat") + (F.col("lat") - F.col("plat")) * share, 9).alias("lat"), F.round(F.col("plon") + (F.col("lon") - F.col("plon")) * share, 9).alias("lon"))


HOUR = 3_600_000_000


@query(f"with {A.TRACK}, l as (select *, lag(t_us) over w as t0, lag(power_w) over w as p0 from trackpoints window w as (partition by ride_id order by seq)), x as (select *, unnest(range(t0 // {HOUR} + 1, t_us // {HOUR} + 1)) as hour from l where t0 is not null and t_us > t0) select ride_id, hour, round(p0 + (power_w - p0) * ((hour * {HOUR} - t0)::double / (t_us - t0)), 6) as power_w from x")
def resample_interpolate(spark, d):
    w = signal.ride()
    p = A.trackpoints(spark, d).select("ride_id", "t_us", F.lag("t_us").over(w).alias("t0"), "power_w", F.lag("power_w").over(w).alias("p0"))
    first, last = F.floor(F.col("t0") / float(HOUR)) + 1, F.floor(F.col("t_us") / float(HOUR))
    p = p.where(F.col("t0").isNotNull() & (F.col("t_us") > F.col("t0")) & (last >= first)).withColumn("hour", F.explode(F.sequence(first, last)))
    share = (F.col("hour") * HOUR - F.col("t0")) / (F.col("t_us") - F.col("t0"))
    return p.select("ride_id", "hour", F.round(F.col("p0") + (F.col("power_w") - F.col("p0")) * share, 6).alias("power_w"))


@query(f"with {A.TRACK}, n as (select *, case when event_id % 7 = 0 then null else t_us end as t from trackpoints) select ride_id, seq, coalesce(t, lag(t) over w + 1000000, lead(t) over w - 1000000) as t_us from n window w as (partition by ride_id order by seq)")
def timestamp_fill(spark, d):
    p = A.trackpoints(spark, d).withColumn("t", F.when(F.col("event_id") % 7 != 0, F.col("t_us")))
    return p.select("ride_id", "seq", F.coalesce("t", F.lag("t").over(signal.ride()) + 1_000_000, F.lead("t").over(signal.ride()) - 1_000_000).alias("t_us"))


@query(f"with {profile.WAYS_SQL} select way_id, speed_kmh, access, push from profiled")
def profile_speed(spark, d):
    return profile.with_speed(A.ways(spark, d)).select("way_id", "speed_kmh", "access", "push")


@query(f"with {A.SIGNAL}, t as (select ride_id, seq, case when plat is null or nlat is null then 0.0e0 else degrees(atan2(sin(atan2(nlat - lat, nlon - lon) - atan2(lat - plat, lon - plon)), cos(atan2(nlat - lat, nlon - lon) - atan2(lat - plat, lon - plon)))) end as angle from sig) select ride_id, seq, round({profile.turn_cost_sql('angle')}, 4) as cost from t")
def turn_cost(spark, d):
    p = signal.with_heading(A.trackpoints(spark, d))
    return p.select("ride_id", "seq", F.round(profile.turn_cost(F.degrees("heading_delta")), 4).alias("cost"))




def parts(spark, d) -> DataFrame:
    s = A.sections(spark, d)
    w = segments.ride()
    cut = F.when((F.row_number().over(w) > 1) & ~F.col("highway").eqNullSafe(F.lag("highway").over(w)), 1).otherwise(0)
    s = s.withColumn("cut", cut).withColumn("segment_id", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ways = routes.ordered("pos", F.col("way_id") % 5)
    return s.groupBy("ride_id", "segment_id").agg(listed(ways).alias("ways"), F.sum("len_m").alias("length_m"))


PARTS = A.SECTIONS + """, c as (select *, case when row_number() over w > 1 and highway is distinct from lag(highway) over w then 1 else 0 end as cut from sections window w as (partition by ride_id order by pos)
), s as (select *, sum(cut) over (partition by ride_id order by pos) as segment_id from c
), parts as (select ride_id, cast(segment_id as bigint) as segment_id, string_agg((way_id % 5)::varchar, ';' order by pos) as ways, sum(len_m) as length_m from s group by ride_id, segment_id
), lib as (select ways, median(length_m) as lib_m, count(*) as hits from parts group by ways having count(*) >= 3)"""


@query(f"with {PARTS} select ride_id, segment_id, ways, hits from parts join lib using (ways) where abs(length_m - lib_m) / lib_m < 0.05e0")
def library_match(spark, d):
    p = parts(spark, d)
    lib = p.groupBy("ways").agg(F.median("length_m").alias("lib_m"), F.count("*").alias("hits")).where("hits >= 3")
    return p.join(lib, "ways").where(F.abs(F.col("length_m") - F.col("lib_m")) / F.col("lib_m") < 0.05).select("ride_id", "segment_id", "ways", "hits")


@query(f"""with {PARTS}, known as (select ways, len(string_split(ways, ';')) as n from lib where len(ways) >= 3), w as (select ride_id, list((way_id % 5)::varchar order by pos) as route from sections group by ride_id
), starts as (select ride_id, route, unnest(range(1, len(route) + 1)) as i from w), sizes as (select distinct n from known), cuts as (select ride_id, i - 1 as position, array_to_string(route[i : i + n - 1], ';') as ways from starts, sizes where i + n - 1 <= len(route))
select ride_id, position, ways from cuts join known using (ways)""")
def route_known_segments(spark, d):
    """Known segments anywhere along a route, with the position they start at."""
    p = parts(spark, d)
    known = p.groupBy("ways").agg(F.count("*").alias("hits")).where("hits >= 3 and length(ways) >= 3")
    known = known.select(F.col("ways").alias("key"), F.split("ways", ";").cast("array<long>").alias("ways"))
    steps = A.sections(spark, d).select("ride_id", "pos", (F.col("way_id") % 5).alias("way"))
    return routes.known_along(steps, known).select("ride_id", "position", F.col("key").alias("ways"))


RANKS = A.SECTIONS + ", a as (select ride_id, sum(len_m) as x, avg(maxspeed) as y from sections group by ride_id), r as (select (rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0e0) as rx, (rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0e0) as ry from a)"


@query(f"with {RANKS} select round(corr(rx, ry), 6) as spearman from r")
def rank_correlation(spark, d):
    """Spearman correlation; ranks are counted inside ranges of values, which running totals of the ranges complete."""
    a = A.sections(spark, d).groupBy("ride_id").agg(F.sum("len_m").alias("x"), F.avg("maxspeed").alias("y"))

    return a.join(scoring.mean_ranks(a, "x"), "x").join(scoring.mean_ranks(a, "y"), "y").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


DETAIL = """v as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
h as (select vec_id, i // 2 as k, (max(case when i % 2 = 0 then x end)::double - max(case when i % 2 = 1 then x end)::double) / sqrt(2.0e0) as d from v group by all),
f as (select *, stddev_pop(d) over (partition by vec_id) as s, row_number() over (partition by vec_id order by abs(d) desc, k) as r from h)"""


def detail(spark, d) -> DataFrame:
    v = A.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    pick = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("x"))).cast("double")
    return v.groupBy("vec_id", F.floor(F.col("i") / 2).cast("long").alias("k")).agg(((pick(0) - pick(1)) / F.sqrt(F.lit(2.0))).alias("d"))


def footprint(spark, d) -> DataFrame:
    s = F.stddev_pop("d").over(Window.partitionBy("vec_id"))
    return detail(spark, d).withColumn("s", s).where(F.abs("d") > 1.5 * F.col("s")).select("vec_id", "k", "d")


@query(f"with {DETAIL} select vec_id, k, round(d, 6) as d from f where abs(d) > 1.5e0 * s")
def wavelet_footprint(spark, d):
    return footprint(spark, d).select("vec_id", "k", F.round("d", 6).alias("d"))


@query(f"with {DETAIL} select vec_id, k, round(d, 6) as d from f where r <= 5")
def topk_coefficients(spark, d):
    r = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.abs("d").desc(), "k"))
    return detail(spark, d).withColumn("r", r).where("r <= 5").select("vec_id", "k", F.round("d", 6).alias("d"))


@query(f"with {DETAIL}, p as (select vec_id, k, d from f where abs(d) > 1.5e0 * s), a as (select * from p where vec_id % 2 = 0), b as (select vec_id - 1 as vec_id, k, d from p where vec_id % 2 = 1) select vec_id, round(sqrt(sum(pow(coalesce(a.d, 0) - coalesce(b.d, 0), 2))), 6) as distance from a full join b using (vec_id, k) group by vec_id")
def footprint_distance(spark, d):
    p = footprint(spark, d)
    both = p.select((F.col("vec_id") - F.col("vec_id") % 2).alias("vec_id"), "k", F.when(F.col("vec_id") % 2 == 0, F.col("d")).otherwise(-F.col("d")).alias("d"))
    gap = both.groupBy("vec_id", "k").agg(F.sum("d").alias("g"))
    return gap.groupBy("vec_id").agg(F.round(F.sqrt(F.sum(F.col("g") * F.col("g"))), 6).alias("distance"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, json_valid(props) as valid from events")
def json_validate(spark, d):
    e = A.read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("select event_id, epoch_us(ts) // 1000000 as epoch_s from events")
def iso_epoch(spark, d):
    e = A.read(spark, d, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_timestamp(F.try_to_timestamp("iso")).alias("epoch_s"))


@query("with d as (select user_id as ride_id, event_type as k, min(ts) as t, min_by(event_id, ts) as e from events group by all) select ride_id, string_agg(k, ';' order by t, e) as keys from d group by ride_id")
def ordered_distinct(spark, d):
    e = A.read(spark, d, "events").groupBy(F.col("user_id").alias("ride_id"), F.col("event_type").alias("k")).agg(F.min(F.struct("ts", "event_id")).alias("o"))
    return e.groupBy("ride_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "k"))), lambda x: x["k"]), ";").alias("keys"))


@query(f"with {A.TRACK}, n as (select *, row_number() over (partition by ride_id order by seq) as r from trackpoints where elv > 100) select ride_id, seq, elv from n where r = 3")
def nth_non_null(spark, d):
    p = A.trackpoints(spark, d).where("elv > 100")
    return p.withColumn("r", F.row_number().over(signal.ride())).where("r = 3").select("ride_id", "seq", "elv")


@query(f"with {A.TRACK} select ride_id, seq, lat, lon from (select *, row_number() over (partition by ride_id order by seq) as r from trackpoints) where r <= 3")
def sample_rows(spark, d):
    p = A.trackpoints(spark, d)
    return p.withColumn("r", F.row_number().over(signal.ride())).where("r <= 3").select("ride_id", "seq", "lat", "lon")


@query(f"with {A.SECTIONS} select ride_id, sum(case when highway in ('primary', 'primary_link') then 2 else 0 end + case when surface = 'gravel' then 1 else 0 end + case when smoothness = 'bad' then 1 else 0 end + case when maxspeed > 40 then 1 else 0 end)::bigint as danger from sections group by ride_id")
def danger_points(spark, d):
    point = lambda c, n: F.when(c, n).otherwise(0)
    c = F.col
    total = point(c("highway").isin("primary", "primary_link"), 2) + point(c("surface") == "gravel", 1) + point(c("smoothness") == "bad", 1) + point(c("maxspeed") > 40, 1)
    return A.sections(spark, d).groupBy("ride_id").agg(F.sum(total).alias("danger"))
