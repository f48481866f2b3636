"""Registered queries over the driver tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rideframe.functions import geo, units
from rideframe.operators import network, segments, signal
from rideframe.plans import adapters as A
from rideframe.plans.adapters import GRADED, GRADIENT, HEADINGS, SPEED
from rideframe.registry import QUERIES, SQL, Query, query


@query(f"with {GRADED} select ride_id, seq, step_mm, cum_mm, round(heading, 6) as heading, round(delta, 6) as heading_delta, round({SPEED}, 6) as speed_mps, {GRADIENT} as gradient_pct, t_us - first_value(t_us) over (partition by ride_id order by seq) as rel_us from graded")
def route_signal(spark, d):
    s = signal.route_signal(A.trackpoints(spark, d))
    return s.select("ride_id", "seq", "step_mm", "cum_mm", F.round("heading", 6).alias("heading"), F.round("heading_delta", 6).alias("heading_delta"), F.round("speed_mps", 6).alias("speed_mps"), F.round("gradient_pct", 4).alias("gradient_pct"), "rel_us")


@query(f"with {A.SIGNAL} select ride_id, seq, step_mm from sig")
def step_distance(spark, d):
    return signal.with_distance(A.trackpoints(spark, d)).select("ride_id", "seq", "step_mm")


@query(f"with {A.SIGNAL} select ride_id, seq, cum_mm from sig")
def cumulative_distance(spark, d):
    return signal.with_distance(A.trackpoints(spark, d)).select("ride_id", "seq", "cum_mm")


@query(f"with {HEADINGS} select ride_id, seq, round(heading, 6) as heading, round(delta, 6) as heading_delta from head")
def heading(spark, d):
    return signal.with_heading(A.trackpoints(spark, d)).select("ride_id", "seq", F.round("heading", 6).alias("heading"), F.round("heading_delta", 6).alias("heading_delta"))


@query(f"with {A.SIGNAL} select ride_id, seq, round({SPEED}, 6) as speed_mps from sig")
def speed(spark, d):
    return signal.with_speed(signal.with_distance(A.trackpoints(spark, d))).select("ride_id", "seq", F.round("speed_mps", 6).alias("speed_mps"))


@query(f"with {GRADED} select ride_id, seq, {GRADIENT} as gradient_pct from graded")
def windowed_gradient(spark, d):
    return signal.with_gradient(signal.with_distance(A.trackpoints(spark, d)), 2000).select("ride_id", "seq", F.round("gradient_pct", 4).alias("gradient_pct"))


@query(f"with {A.SIGNAL}, g as (select ride_id, case when step_mm > 0 then (elv - lag(elv) over (partition by ride_id order by seq)) / (step_mm / 1000.0e0) end as g from sig) select ride_id, round(var_samp(g), 4) as gradient_variation from g group by ride_id")
def gradient_variation(spark, d):
    p = signal.with_distance(A.trackpoints(spark, d))
    g = F.when(F.col("step_mm") > 0, (F.col("elv") - F.lag("elv").over(signal.ride())) / (F.col("step_mm") / 1000.0))
    return p.select("ride_id", g.alias("g")).groupBy("ride_id").agg(F.round(F.var_samp("g"), 4).alias("gradient_variation"))


_X, _Y = "radians({b} - {a}) * cos(radians(lat)) * 6371000.0e0", "radians({b} - {a}) * 6371000.0e0"
KAPPA = A.SIGNAL + f""", plane as (select *, {_X.format(a='lon', b='nlon')} as x1, {_Y.format(a='lat', b='nlat')} as y1, {_X.format(a='plon', b='lon')} as x0, {_Y.format(a='plat', b='lat')} as y0, {_X.format(a='plon', b='nlon')} as cx, {_Y.format(a='plat', b='nlat')} as cy from sig
), kap as (select *, case when sqrt(cx * cx + cy * cy) > 1e-6 then abs(atan2(sin(atan2(y1, x1) - atan2(y0, x0)), cos(atan2(y1, x1) - atan2(y0, x0)))) / sqrt(cx * cx + cy * cy) else 0.0e0 end as kappa from plane)"""


@query(f"with {KAPPA} select ride_id, seq, round(kappa, 6) as kappa from kap")
def curvature(spark, d):
    return signal.curvature(A.trackpoints(spark, d)).select("ride_id", "seq", F.round("kappa", 6).alias("kappa"))


@query(f"with {KAPPA} select ride_id, round(sum(case when kappa > 0.01e0 then step_mm else 0 end) / nullif(sum(step_mm), 0)::double, 6) as pct_twisty from kap group by ride_id")
def curvature_burden(spark, d):
    p = signal.curvature(signal.with_distance(A.trackpoints(spark, d)))
    return p.groupBy("ride_id").agg(F.round(F.sum(F.when(F.col("kappa") > 0.01, F.col("step_mm")).otherwise(0)) / F.nullif(F.sum("step_mm"), F.lit(0)), 6).alias("pct_twisty"))


@query(f"""with {A.TRACK}, c as (select *, seq // 200 as chunk_id, lead(lat) over w as nlat, lead(lon) over w as nlon from trackpoints window w as (partition by ride_id, seq // 200 order by seq)
), b as (select *, degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) as deg from c
), b2 as (select *, case when deg < 0 then deg + 360 else deg end as bear from b
), t as (select *, abs(bear - lag(bear) over (partition by ride_id, chunk_id order by seq)) as dd from b2
), m as (select *, coalesce(round(avg(case when dd > 180 then 360 - dd else dd end) over (partition by ride_id, chunk_id order by seq rows between 2 preceding and 2 following), 6), 0.0e0) as mean from t)
select ride_id, seq, least(50, 10 + cast(ceil(mean * 2) as bigint))::bigint as radius from m""")
def dynamic_radius(spark, d):
    return signal.dynamic_radius(A.trackpoints(spark, d)).select("ride_id", "seq", "radius")


@query(f"with {A.TRACK} select ride_id, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east from trackpoints where lat is not null and lon is not null group by ride_id")
def bounding_box(spark, d):
    p = A.trackpoints(spark, d).where("lat is not null and lon is not null")
    return p.groupBy("ride_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


@query(f"with {A.TRACK} select ride_id, seq // 200 as chunk_id, count(*) as n, min(seq) as first_seq from trackpoints group by all")
def chunk_assignment(spark, d):
    p = A.trackpoints(spark, d)
    return p.groupBy("ride_id", F.floor(F.col("seq") / 200).cast("long").alias("chunk_id")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(f"with {A.SIGNAL}, r as (select ride_id, list(step_mm order by step_mm) as v from sig where seq > 0 group by ride_id) select ride_id, len(v)::bigint as n, v[1] as min_mm, v[cast(floor((len(v) - 1) * 0.5e0) as bigint) + 1] as p50_mm, v[cast(floor((len(v) - 1) * 0.95e0) as bigint) + 1] as p95_mm, v[len(v)] as max_mm, round(list_avg(v), 3) as avg_mm from r")
def step_stats(spark, d):
    return signal.step_stats(A.trackpoints(spark, d))


@query(f"with {A.SIGNAL} select ride_id, seq, cast(sum(case when t_us - pt > 3600000000 then 1 else 0 end) over (partition by ride_id order by seq rows unbounded preceding) as bigint) as track_id from sig")
def track_gap_split(spark, d):
    return signal.split_on_gaps(A.trackpoints(spark, d), 3_600_000_000).select("ride_id", "seq", "track_id")


@query(f"with {A.SIGNAL} select ride_id, seq, cum_mm from sig where cum_mm >= 1000000")
def privacy_trim(spark, d):
    return signal.with_distance(A.trackpoints(spark, d)).where("cum_mm >= 1000000").select("ride_id", "seq", "cum_mm")


@query(f"with {A.TRACK}, s as (select *, avg(power_w) over w as m, stddev_samp(power_w) over w as sd from trackpoints window w as (partition by ride_id)) select ride_id, seq, power_w from s where abs(power_w - m) <= 2 * sd")
def outlier_filter(spark, d):
    w = signal.Window.partitionBy("ride_id")
    p = A.trackpoints(spark, d).withColumns({"m": F.avg("power_w").over(w), "sd": F.stddev_samp("power_w").over(w)})
    return p.where(F.abs(F.col("power_w") - F.col("m")) <= 2 * F.col("sd")).select("ride_id", "seq", "power_w")


_KEYS = "case event_type when 'click' then 'gpxtpx:HR' when 'view' then 'ns3.Cad' when 'purchase' then 'power' when 'signup' then 'temp_f' else 'speed_kph' end"


@query(f"""with e as (select event_id, user_id as ride_id, {_KEYS} as k, value as v from events),
c as (select *, regexp_replace(string_split(lower(trim(k)), '.')[-1], '^[^:]*:', '') as ck from e)
select event_id, case ck when 'hr' then 'hr_bpm' when 'cad' then 'cad_rpm' when 'power' then 'power_w' when 'temp_f' then 'temp_c' else 'speed_mps' end as canonical,
  round(case ck when 'hr' then trunc(v) when 'cad' then trunc(v) when 'temp_f' then (v - 32.0e0) * 5.0e0 / 9.0e0 when 'speed_kph' then v / 3.6e0 else v end, 6) as canonical_value from c""")
def extension_canonical(spark, d):
    out = units.canonical_readings(A.extensions(spark, d), units.rules_table(spark), "ext_key", "ext_value")
    return out.select("event_id", "canonical", F.round("canonical_value", 6).alias("canonical_value"))


@query(f"with {A.TRACK}, a as (select *, last_value(case when elv > 100 then seq end ignore nulls) over (partition by ride_id order by seq rows unbounded preceding) as anchor from trackpoints) select ride_id, anchor, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from a where anchor is not null group by all")
def asof_attach(spark, d):
    p = signal.asof_attach(A.trackpoints(spark, d), F.col("elv") > 100)
    return p.groupBy("ride_id", "anchor").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _runs_sql(keys: str) -> str:
    return f"""with {A.PATH}, f as (select *, case when row_number() over w > 1 and ({keys}) is not distinct from lag(({keys})) over w then 0 else 1 end as new from node_path window w as (partition by ride_id order by pos)
), r as (select *, sum(new) over (partition by ride_id order by pos) - 1 as run_idx from f)"""


@query(_runs_sql("way_id % 3") + " select ride_id, run_idx::bigint as run_idx, any_value(way_id % 3) as way_group, min(pos) as start_pos, count(*) as n, round(sum(len_m), 3) as length_m from r group by ride_id, run_idx")
def way_change_runs(spark, d):
    p = A.node_path(spark, d).withColumn("way_group", F.col("way_id") % 3)
    r = network.run_lengths(p, ["way_group"])
    return r.select("ride_id", "run_idx", "way_group", "start_pos", "n", F.round("length_m", 3).alias("length_m"))


@query(f"with {A.EDGES} select * from edges")
def edge_index(spark, d):
    return network.edge_index(A.node_path(spark, d))


LOOKUP = A.EDGES + """, best as (select u, v, arg_min({'w': way_id, 'd': dir, 'l': len_m}, {'w': way_id, 'd': dir, 'l': len_m}) as e from edges where way_id % 2 = 0 group by u, v)"""


@query(f"with {LOOKUP} select p.ride_id, p.pos, p.node_id as u, p.nxt as v, e.w as way_id, coalesce(e.d, 0) as dir, e.l as len_m from pairs p left join best b on p.node_id = b.u and p.nxt = b.v where p.nxt <> p.node_id")
def edge_lookup(spark, d):
    p = A.node_path(spark, d)
    return network.edge_lookup(network.pairs(p), network.edge_index(p).where("way_id % 2 = 0"))


@query(f"with {A.EDGES} select ride_id, pos, node_id as u, nxt as v from pairs p where nxt <> node_id and not exists (select 1 from edges e where e.u = p.node_id and e.v = p.nxt and e.way_id % 2 = 0)")
def missing_edges(spark, d):
    p = A.node_path(spark, d)
    return network.pairs(p).select("ride_id", "pos", "u", "v").join(network.edge_index(p).where("way_id % 2 = 0"), ["u", "v"], "left_anti").select("ride_id", "pos", "u", "v")


@query(f"with {A.EDGES} select u as node_id, count(distinct v) as degree from edges group by u having count(distinct v) >= 3")
def node_degree_junctions(spark, d):
    return network.junctions(network.edge_index(A.node_path(spark, d)))


@query(f"with {A.PATH} select ride_id, round(sum(len_m), 3) as distance_m, count(*) as n_nodes, bool_and(len_m > 1) as all_ok from node_path group by ride_id")
def route_totals(spark, d):
    return A.node_path(spark, d).groupBy("ride_id").agg(F.round(F.sum("len_m"), 3).alias("distance_m"), F.count("*").alias("n_nodes"), F.every(F.col("len_m") > 1).alias("all_ok"))


@query(f"""with {A.PATH}, c as (select ride_id, pos // 3 as chunk, list(node_id % 4 order by pos) as a from node_path group by all
), s as (select ride_id, chunk, a, lead(a) over (partition by ride_id order by chunk) as b from c)
select ride_id, chunk, coalesce(list_max(list_filter(range(1, least(len(a), len(b), 50) + 1), lambda k: a[len(a) - k + 1 : len(a)] = b[1 : k])), 0)::int as overlap from s where b is not null""")
def seam_overlap(spark, d):
    p = A.node_path(spark, d)
    c = p.groupBy("ride_id", F.floor(F.col("pos") / 3).cast("long").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("node_id") % 4).alias("x")))), lambda s: s["x"]).alias("a"))
    w = signal.Window.partitionBy("ride_id").orderBy("chunk")
    c = c.withColumn("b", F.lead("a").over(w)).where("b is not null")
    return c.select("ride_id", "chunk", network.overlap(F.col("a"), F.col("b"), 50).alias("overlap"))


@query(f"with {A.SECTIONS} select * from sections")
def way_tags(spark, d):
    return A.sections(spark, d)


_HRANK = "case highway " + " ".join(f"when '{k}' then {v}e0" for k, v in segments.HIGHWAY_RANK.items()) + " end"
_SMOOTH = "case smoothness " + " ".join(f"when '{k}' then {v}e0" for k, v in segments.SMOOTHNESS.items()) + " end"
COSTS = A.SECTIONS + f""", t as (select *, {_HRANK} as hr, {_SMOOTH} as sm, surface in ('asphalt', 'concrete', 'paved', 'paving_stones') as pv from sections
), l as (select *, row_number() over w as rn, lag(highway) over w as h0, lag(hr) over w as hr0, lag(surface) over w as s0, lag(pv) over w as pv0, lag(sm) over w as sm0, lag(maxspeed) over w as ms0 from t window w as (partition by ride_id order by pos)
), costed as (select *, case when rn > 1 then least(1.0e0, round(case when highway is distinct from h0 then coalesce(0.5e0 * abs(hr - hr0), 1.0e0) else 0.0e0 end
  + case when surface is distinct from s0 then case when pv is distinct from pv0 then 0.6e0 else 0.1e0 end else 0.0e0 end
  + coalesce(0.05e0 * abs(sm - sm0), 0.0e0) + coalesce(0.02e0 * abs(maxspeed - ms0), 0.0e0), 6)) end as cost from l
), seg as (select *, cast(sum(case when cost >= 0.8e0 then 1 else 0 end) over (partition by ride_id order by pos rows unbounded preceding) as bigint) as segment_id from costed)"""


@query(f"with {COSTS} select ride_id, pos, cost from costed")
def merge_cost(spark, d):
    return segments.merge_cost(A.sections(spark, d)).select("ride_id", "pos", "cost")


@query(f"with {COSTS} select ride_id, pos, segment_id from seg")
def threshold_segments(spark, d):
    return segments.threshold_segments(segments.merge_cost(A.sections(spark, d)), 0.8).select("ride_id", "pos", "segment_id")


FEATURES = COSTS + """, feat as (select ride_id, segment_id, min(pos) as start_pos, count(*) as n_sections, round(sum(len_m), 3) as length_m, round(avg(maxspeed), 6) as mean_maxspeed,
  round(sum(case when pv then len_m else 0.0e0 end) / sum(len_m), 6) as paved_share, count(distinct highway) as n_classes from seg group by ride_id, segment_id)"""


@query(f"with {FEATURES} select * from feat")
def segment_features(spark, d):
    return segments.segment_features(segments.threshold_segments(segments.merge_cost(A.sections(spark, d)), 0.8))


def _pair_cost(a: str, b: str) -> str:
    rank = lambda x: f"case {x}.h " + " ".join(f"when '{k}' then {v}e0" for k, v in segments.HIGHWAY_RANK.items()) + " end"
    smooth = lambda x: f"case {x}.m " + " ".join(f"when '{k}' then {v}e0" for k, v in segments.SMOOTHNESS.items()) + " end"
    paved = lambda x: f"{x}.s in ('asphalt', 'concrete', 'paved', 'paving_stones')"
    return f"""least(1.0e0, round(case when {a}.h is distinct from {b}.h then coalesce(0.5e0 * abs({rank(b)} - {rank(a)}), 1.0e0) else 0.0e0 end
      + case when {a}.s is distinct from {b}.s then case when ({paved(a)}) is distinct from ({paved(b)}) then 0.6e0 else 0.1e0 end else 0.0e0 end
      + coalesce(0.05e0 * abs({smooth(b)} - {smooth(a)}), 0.0e0) + coalesce(0.02e0 * abs({b}.v - {a}.v), 0.0e0)
      + case when {a}.c is distinct from {b}.c then case when {a}.c is null or {b}.c is null then 1.0e0 else 0.2e0 end else 0.0e0 end, 6))"""


def greedy_sql(costs: str, cycleway: str) -> str:
    """Merges by recursion, one a step; sections with a hard tag are parts of their own and stay."""
    return "recursive " + costs + f""", parted as (select *, cast(sum(case when cost >= 1 then 1 else 0 end) over (partition by ride_id order by pos rows unbounded preceding) as bigint) as part from costed
), steps(ride_id, part, x, step) as (
  select ride_id, part, list({{'p': [pos], 'l': len_m::double, 'h': highway, 's': surface, 'm': smoothness, 'v': maxspeed, 'c': {cycleway}}} order by pos), 0 from parted group by ride_id, part
  union all
  select ride_id, part, x[1 : k - 1] || [{{'p': x[k].p || x[k + 1].p, 'l': x[k].l + x[k + 1].l, 'h': t.h, 's': t.s, 'm': t.m, 'v': t.v, 'c': t.c}}] || x[k + 2 : len(x)], step + 1
  from (select *, case when x[k + 1].l > x[k].l then x[k + 1] else x[k] end as t from (
    select *, list_position(c, list_min(c)) as k from (select *, list_transform(range(1, len(x)), lambda i: {_pair_cost("x[i]", "x[i + 1]")}) as c from steps where len(x) > 1) where list_min(c) < 0.8e0))
), settled as (select ride_id, part, arg_max(x, step) as x from steps group by ride_id, part
), numbered as (select ride_id, part, unnest(x).p as p, unnest(range(len(x))) as segment_id from settled)"""


@query(f"with {greedy_sql(COSTS, 'null::varchar')} select ride_id, part, unnest(p) as pos, segment_id from numbered")
def greedy_merge(spark, d):
    return segments.greedy_merge(A.sections(spark, d), 0.8)


EXTRA_TAGS = """, case when way_id % 23 = 0 then 'lane' when way_id % 23 = 1 then 'track' end as cycleway, case when way_id % 97 = 0 then 'roundabout' end as junction,
  case when way_id % 89 = 0 then 'gate' when way_id % 89 = 1 then 'kerb' end as barrier, case when way_id % 101 = 0 then 'yes' end as mountain_pass"""


def tagged_sections(spark, d):
    """Sections with the tags that make boundaries hard or change the cycleway, for some of the ways."""
    way = F.col("way_id")
    return A.sections(spark, d).withColumns({
        "smoothness": F.when(way % 103 == 0, "impassable").otherwise(F.col("smoothness")), "cycleway": F.when(way % 23 == 0, "lane").when(way % 23 == 1, "track"), "junction": F.when(way % 97 == 0, "roundabout"),
        "barrier": F.when(way % 89 == 0, "gate").when(way % 89 == 1, "kerb"), "mountain_pass": F.when(way % 101 == 0, "yes"),
    })


TAG_COSTS = A.SECTIONS + f""", x as (select * replace (case when way_id % 103 = 0 then 'impassable' else smoothness end as smoothness){EXTRA_TAGS} from sections
), t as (select *, {_HRANK} as hr, {_SMOOTH} as sm, surface in ('asphalt', 'concrete', 'paved', 'paving_stones') as pv, coalesce(highway = 'motorway', false) or coalesce(smoothness = 'impassable', false) or junction is not null or coalesce(barrier in ('gate', 'bollard', 'chain', 'yes'), false) or coalesce(mountain_pass = 'yes', false) as hard from x
), l as (select *, row_number() over w as rn, lag(highway) over w as h0, lag(hr) over w as hr0, lag(surface) over w as s0, lag(pv) over w as pv0, lag(sm) over w as sm0, lag(maxspeed) over w as ms0, lag(cycleway) over w as c0, lag(hard) over w as hard0 from t window w as (partition by ride_id order by pos)
), costed as (select *, case when rn > 1 then case when hard or hard0 then 1.0e0 else least(1.0e0, round(case when highway is distinct from h0 then coalesce(0.5e0 * abs(hr - hr0), 1.0e0) else 0.0e0 end
  + case when surface is distinct from s0 then case when pv is distinct from pv0 then 0.6e0 else 0.1e0 end else 0.0e0 end
  + coalesce(0.05e0 * abs(sm - sm0), 0.0e0) + coalesce(0.02e0 * abs(maxspeed - ms0), 0.0e0) + case when cycleway is distinct from c0 then case when cycleway is null or c0 is null then 1.0e0 else 0.2e0 end else 0.0e0 end, 6)) end end as cost from l)"""


@query(f"with {TAG_COSTS} select ride_id, pos, cost from costed")
def merge_cost_tags(spark, d):
    """Merge costs with cycleways, junctions, barriers, passes and impassable ways."""
    return segments.merge_cost(tagged_sections(spark, d)).select("ride_id", "pos", "cost")


LANED = TAG_COSTS.replace("when way_id % 23 = 0 then 'lane' when way_id % 23 = 1 then 'track' end as cycleway", "when way_id % 5 < 2 then 'lane' when way_id % 5 < 4 then 'track' end as cycleway")


def laned_sections(spark, d):
    """Tagged sections most of which have a cycleway."""
    kind = F.when(F.col("way_id") % 5 < 2, "lane").when(F.col("way_id") % 5 < 4, "track")
    return tagged_sections(spark, d).withColumn("cycleway", kind)


@query(f"with {greedy_sql(LANED, 'cycleway')} select ride_id, part, unnest(p) as pos, segment_id from numbered")
def greedy_merge_tags(spark, d):
    """Greedy merges with cycleways, whose change a merge carries to the next boundary, and hard tags."""
    return segments.greedy_merge(laned_sections(spark, d), 0.8)


@query(f"with {A.TRACK}, r as (select *, avg(power_w) over (partition by ride_id order by t_us range between 86400000000 preceding and current row) as m from trackpoints) select ride_id, round(pow(avg(pow(m, 4)), 0.25e0), 6) as np_w from r group by ride_id")
def normalized_power(spark, d):
    return signal.normalized_power(A.trackpoints(spark, d), 86_400).select("ride_id", F.round("np_w", 6).alias("np_w"))


@query(f"with {A.TRACK}, r as (" + " union all ".join(f"select ride_id, {s}::bigint as hours, avg(power_w) over (partition by ride_id order by t_us range between {s * 3600000000} preceding and current row) as m from trackpoints" for s in (1, 24, 168)) + ") select ride_id, hours, round(max(m), 6) as best_w from r group by all")
def power_curve(spark, d):
    p = A.trackpoints(spark, d)
    for h in (1, 24, 168):
        p = signal.rolling_power(p, 3600 * h).withColumnRenamed("rolling_w", f"m{h}")
    best = p.groupBy("ride_id").agg(*[F.round(F.max(f"m{h}"), 6).alias(f"m{h}") for h in (1, 24, 168)])
    return best.select("ride_id", F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("hours"), F.col(f"m{h}").alias("best_w")) for h in (1, 24, 168)])).alias("x")).select("ride_id", "x.hours", "x.best_w")


@query("""with v as (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as i from embeddings),
h as (select vec_id, i // 2 as k, (max(case when i % 2 = 0 then x end)::double - max(case when i % 2 = 1 then x end)::double) / sqrt(2.0e0) as d from v group by all)
select vec_id, round(sum(d * d), 6) as energy from h group by vec_id""")
def wavelet_detail(spark, d):
    v = A.read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    pick = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("x"))).cast("double")
    h = v.groupBy("vec_id", F.floor(F.col("i") / 2).alias("k")).agg(((pick(0) - pick(1)) / F.sqrt(F.lit(2.0))).alias("d"))
    return h.groupBy("vec_id").agg(F.round(F.sum(F.col("d") * F.col("d")), 6).alias("energy"))


@query(f"with {A.TRACK} select cast(floor(lat / 0.01e0) as bigint) as cell_y, cast(floor(lon / 0.01e0) as bigint) as cell_x, count(distinct ride_id) as n_rides, count(*) as n_points from trackpoints group by all having count(distinct ride_id) >= 2")
def popular_cells(spark, d):
    p = A.trackpoints(spark, d)
    cells = p.groupBy(F.floor(F.col("lat") / 0.01).cast("long").alias("cell_y"), F.floor(F.col("lon") / 0.01).cast("long").alias("cell_x"))
    return cells.agg(F.count_distinct("ride_id").alias("n_rides"), F.count("*").alias("n_points")).where("n_rides >= 2")


@query(f"with {A.SIGNAL} select ride_id, seq, step_mm from sig where step_mm > 500000")
def jump_filter(spark, d):
    return signal.with_distance(A.trackpoints(spark, d)).where("step_mm > 500000").select("ride_id", "seq", "step_mm")


@query(f"with {GRADED}, c as (select {GRADIENT} as g from graded) select case when abs(g) < 2 then 'flat' when abs(g) < 5 then 'mild' when abs(g) < 8 then 'steep' else 'wall' end as class, count(*) as n from c group by all")
def grade_class(spark, d):
    p = signal.with_gradient(signal.with_distance(A.trackpoints(spark, d)), 2000)
    return p.groupBy(geo.grade_class(F.round("gradient_pct", 4)).alias("class")).agg(F.count("*").alias("n"))


@query(f"with {A.TRACK}, s as (select *, abs(elv - lag(elv) over w) as jump, stddev_samp(elv) over (partition by ride_id) as sd from trackpoints window w as (partition by ride_id order by seq)) select ride_id, seq, elv from s where jump is null or jump <= sd")
def elevation_jump_filter(spark, d):
    p = A.trackpoints(spark, d).withColumns({"jump": F.abs(F.col("elv") - F.lag("elv").over(signal.ride())), "sd": F.stddev_samp("elv").over(signal.Window.partitionBy("ride_id"))})
    return p.where("jump is null or jump <= sd").select("ride_id", "seq", "elv")


@query(f"with {A.TRACK}, r as (select ride_id, avg(power_w) over (partition by ride_id order by seq rows between current row and 29 following) as m from trackpoints) select ride_id, round(pow(avg(pow(m, 4)), 0.25e0), 6) as np_w from r group by ride_id")
def tapered_np(spark, d):
    p = A.trackpoints(spark, d).withColumn("m", F.avg("power_w").over(signal.ride().rowsBetween(0, 29)))
    return p.groupBy("ride_id").agg(F.round(F.pow(F.avg(F.pow("m", F.lit(4.0))), F.lit(0.25)), 6).alias("np_w"))


@query(f"with {HEADINGS}, j as (select *, case when abs(heading - lag(heading) over w) > pi() then 1 else 0 end as cut from head window w as (partition by ride_id order by seq)), t as (select *, sum(cut) over (partition by ride_id order by seq) as trace from j) select ride_id, trace::bigint as trace_id, count(*) as n, min(seq) as first_seq from t group by all having count(*) >= 2")
def heading_trace_split(spark, d):
    """Parts of rides between jumps of the heading by more than half a turn."""
    p = signal.with_jumps(A.trackpoints(spark, d)).withColumn("cut", F.col("jump").cast("int"))
    p = p.withColumn("trace_id", F.sum("cut").over(signal.so_far()))
    return p.groupBy("ride_id", "trace_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n >= 2")


@query(f"with {A.TRACK} select ride_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from trackpoints group by ride_id")
def map_centre(spark, d):
    return A.trackpoints(spark, d).groupBy("ride_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query(f"with {A.TRACK} select ride_id, round(avg(case when power_w between 100 and 200 then 1.0e0 else 0.0e0 end), 6) as in_zone, count(*) filter (power_w < 10) as pauses from trackpoints group by ride_id")
def zone_labels(spark, d):
    return A.trackpoints(spark, d).groupBy("ride_id").agg(F.round(F.avg(F.when(F.col("power_w").between(100, 200), 1.0).otherwise(0.0)), 6).alias("in_zone"), F.count_if(F.col("power_w") < 10).alias("pauses"))


@query(f"with {A.TRACK} select ride_id, seq, lat, lon from trackpoints where lat between 51.5e0 and 51.505e0 and lon between -0.12e0 and -0.11e0")
def bbox_contains(spark, d):
    return A.trackpoints(spark, d).where(F.col("lat").between(51.5, 51.505) & F.col("lon").between(-0.12, -0.11)).select("ride_id", "seq", "lat", "lon")


@query(_runs_sql("way_id % 3, len_m") + " select ride_id, run_idx::bigint as run_idx, any_value(way_id % 3) as way_group, any_value(len_m) as len_m, count(*) as n from r group by ride_id, run_idx")
def runs_with_length_key(spark, d):
    p = A.node_path(spark, d).withColumns({"way_group": F.col("way_id") % 3, "dis": F.col("len_m")})
    return network.run_lengths(p, ["way_group", "dis"]).select("ride_id", "run_idx", "way_group", F.col("dis").alias("len_m"), "n")


@query(f"with {A.PATH}, p as (select *, lead(node_id) over (partition by ride_id order by pos) as nxt from node_path) select ride_id, count(*) filter (nxt <> node_id) as edges, count(*) filter (nxt = node_id) as degenerate from p group by ride_id")
def degenerate_edges(spark, d):
    p = A.node_path(spark, d).withColumn("nxt", F.lead("node_id").over(network.path_order()))
    return p.groupBy("ride_id").agg(F.count_if(F.col("nxt") != F.col("node_id")).alias("edges"), F.count_if(F.col("nxt") == F.col("node_id")).alias("degenerate"))


@query(f"with {A.PATH} select ride_id, string_agg(node_id::varchar, ';' order by pos) as nodes from node_path group by ride_id")
def join_list(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("pos", "node_id")))
    return A.node_path(spark, d).groupBy("ride_id").agg(F.array_join(F.transform(listed, lambda x: x["node_id"].cast("string")), ";").alias("nodes"))


@query(f"with {COSTS} select ride_id, pos, highway from (select *, lag(highway) over w as h, lag(surface) over w as s, row_number() over w as n from sections window w as (partition by ride_id order by pos)) where n > 1 and (highway is distinct from h or surface is distinct from s)")
def boundary_proposals(spark, d):
    p = A.sections(spark, d)
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(segments.ride()))
    p = p.withColumn("cut", (F.row_number().over(segments.ride()) > 1) & (changed("highway") | changed("surface")))
    return p.where("cut").select("ride_id", "pos", "highway")


@query(f"with {COSTS} select ride_id, arg_min(pos, {{'c': cost, 'p': pos}}) as pos, min(cost) as cost from costed where cost is not null group by ride_id")
def cheapest_boundary(spark, d):
    p = segments.merge_cost(A.sections(spark, d)).where("cost is not null")
    return p.groupBy("ride_id").agg(F.min(F.struct("cost", "pos")).alias("m")).select("ride_id", "m.pos", "m.cost")


@query(f"""with {COSTS}, a as (select ride_id, pos from costed where cost >= 0.8e0), b as (select ride_id, pos from costed where cost >= 0.5e0),
u as (select ride_id, pos, bool_or(x) as x, bool_or(y) as y from (select ride_id, pos, true as x, false as y from a union all select ride_id, pos, false, true from b) group by all)
select ride_id, round(count(*) filter (x and y) / count(*)::double, 6) as jaccard from u group by ride_id""")
def breakpoint_jaccard(spark, d):
    c = segments.merge_cost(A.sections(spark, d)).where("cost >= 0.5")
    return c.groupBy("ride_id").agg(F.round(F.count_if(F.col("cost") >= 0.8) / F.count("*"), 6).alias("jaccard"))


@query(f"with {FEATURES} select ride_id, segment_id, round(least(1.0e0, greatest(0.0e0, 0.4e0 * least(1.0e0, length_m / 100) + 0.3e0 * paved_share + 0.2e0 * (1.0e0 - mean_maxspeed / 50) + 0.1e0 / n_classes)), 10) as tss from feat")
def tss_scores(spark, d):
    return segments.suitability(segment_features(spark, d)).select("ride_id", "segment_id", F.round("tss", 10).alias("tss"))


LIBRARY = COSTS + """, sg as (select ride_id, segment_id, string_agg(way_id::varchar, '>' order by pos) as ways, sum(len_m) as len from seg group by ride_id, segment_id)"""


@query(f"with {LIBRARY} select md5(ways) as segment_key, count(*) as hits, round(avg(len), 3) as mean_length_m from sg group by ways")
def segment_library(spark, d):
    s = segments.threshold_segments(segments.merge_cost(A.sections(spark, d)), 0.8)
    return segments.library(s).select("segment_key", "hits", F.round("mean_length_m", 3).alias("mean_length_m"))


from rideframe import catalogue_routes, catalogue_rules, catalogue_more, catalogue_roads  # noqa: E402, F401, I001  (register more queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
