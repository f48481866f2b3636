"""Route operators without SQL, against plain versions on small rows."""

import itertools
import math
import random

from pyspark.sql import functions as F

from rideframe.functions import geo
from rideframe.operators import matching, routes, segments, signal
from rideframe.sources import readers
from rideframe.streaming.rides import ride_sessions


def plain_haversine(a, b):
    (la, lo), (lb, lp) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


def test_polyline_known_value_and_round_trip(spark):
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    df = spark.createDataFrame([(points,), ([],), ([(0.0, 0.0)],)], "p array<struct<lat:double,lon:double>>")
    rows = df.select("p", routes.polyline(F.col("p")).alias("s")).select("p", "s", routes.decode_polyline(F.col("s")).alias("back")).collect()
    assert rows[0]["s"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert rows[1]["s"] == ""
    for r in rows:
        assert [(round(x["lat"], 5), round(x["lon"], 5)) for x in r["back"]] == [(x["lat"], x["lon"]) for x in r["p"]]


def test_viterbi_equals_enumeration(spark):
    rng = random.Random(3)
    nodes = [(i, 51.5 + rng.random() / 500, rng.random() / 500) for i in range(6)]
    points = [(1, 0, s, 51.5 + rng.random() / 500, rng.random() / 500) for s in range(4)]
    reach, sigma, beta = 5000.0, 40.0, 30.0
    got = matching.viterbi(spark.createDataFrame(points, "ride_id long, chunk long, seq long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, nlat double, nlon double"), reach, sigma, beta)
    got = [r["node_id"] for r in sorted(got.collect(), key=lambda r: r["seq"])]

    def score(path):
        total = -sum(0.5 * (plain_haversine(p[3:], n[1:]) / sigma) ** 2 for p, n in zip(points, path))
        return total - sum(abs(plain_haversine(a[1:], b[1:]) - plain_haversine(p[3:], q[3:])) / beta for a, b, p, q in zip(path, path[1:], points, points[1:]))

    assert got == [n[0] for n in max(itertools.product(nodes, repeat=4), key=score)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    nodes = [(i, 51 + rng.random() / 100, rng.random() / 100) for i in range(40)]
    points = [(1, s, 51 + rng.random() / 100, rng.random() / 100) for s in range(50)]
    got = matching.nearest(spark.createDataFrame(points, "ride_id long, seq long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, nlat double, nlon double"), ["ride_id", "seq"], 150.0)
    for r in got.collect():
        d, n = min((plain_haversine(points[r["seq"]][2:], x[1:]), x[0]) for x in nodes)
        assert (r["node_id"], r["distance_m"]) == ((n, round(d, 3)) if d <= 150 else (None, None))


def test_filters_of_a_ride(spark):
    rows = [(1, 0, 51.0, 0.0, 10.0, 0), (1, 1, 51.0001, 0.0, None, 11_000), (1, 2, 51.01, 0.0, 20.0, 1_112_000)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lon double, elv double, cum_mm long").withColumn("gradient_pct", F.lit(0.0))
    smooth = [r["smoothed"] for r in sorted(matching.kalman(df, "elv", 1.0, 25.0).collect(), key=lambda r: r["seq"])]
    assert smooth[:2] == [10.0, 10.0] and abs(smooth[2] - (10 + 10 * 27 / 52)) < 1e-9
    assert sorted(r["seq"] for r in matching.thin(df, 100.0).collect()) == [0, 2]
    assert [r["segment_id"] for r in sorted(matching.adaptive_segments(df, 40.0, 12.0).collect(), key=lambda r: r["seq"])] == [0, 0, 1]
    assert matching.thin(df.where("false"), 100.0).count() == 0


def test_distance_begins_at_zero(spark):
    """Known values, not the shared SQL: a ride's first step is no step, and a point without a place makes none."""
    rows = [(1, 0, 51.0, 0.0, 0), (1, 1, 51.001, 0.0, 10_000_000), (1, 2, None, 0.0, 20_000_000), (1, 3, 51.002, 0.0, 30_000_000), (1, 4, 51.003, 0.0, 40_000_000), (2, 0, -33.0, 151.0, 0)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lon double, t_us long")
    got = sorted(signal.with_speed(signal.with_distance(df)).collect(), key=lambda r: (r["ride_id"], r["seq"]))
    step = round(1000 * plain_haversine((51.0, 0.0), (51.001, 0.0)))
    assert [r["step_mm"] for r in got] == [0, step, 0, 0, step, 0]
    assert [r["cum_mm"] for r in got] == [0, step, step, step, 2 * step, 0]
    assert [round(r["speed_mps"], 3) for r in got] == [0.0, 11.119, 0.0, 0.0, 11.119, 0.0]
    far = df.select(geo.haversine(F.lit(90.0), F.lit(0.0), F.lit(-90.0), F.lit(0.0)).alias("d")).first()["d"]
    assert abs(far - math.pi * 6371000) < 1e-6


def test_sequential_filters_equal_plain_versions(spark):
    rng = random.Random(11)
    rides = {k: [(51 + rng.random() / 100, rng.random() / 100) for _ in range(n)] for k, n in ((1, 90), (2, 1), (3, 40))}
    rows = [(k, i, *p) for k, points in rides.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lon double")
    for reach in (0.0, 400.0, 1e6):
        want = set()
        for k, points in rides.items():
            kept = []
            for i, p in enumerate(points):
                if not kept or plain_haversine(points[kept[-1]], p) > reach:
                    kept.append(i)
            want |= {(k, i) for i in kept}
        assert {tuple(r) for r in matching.thin(df, reach).collect()} == want


def test_guard_compares_with_the_boundary_that_stays(spark):
    """Candidates every 40 m under a guard of 100 m: one stays every 120 m, and ties of one place leave the first."""
    rows = [(1, i, 40_000 * i, 0.0, 5.0, i) for i in range(20)] + [(2, 0, 0, 0.0, 5.0, 1), (2, 1, 0, 9.0, 5.0, 1), (2, 2, 0, 0.0, 0.0, 1), (2, 3, 200_000, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, cum_mm long, heading_delta double, speed_mps double, way_id long")
    got = sorted(tuple(r) for r in segments.propose_boundaries(df, 3.0, 0.1, 100.0).select("ride_id", "seq", "why").collect())
    assert got == [(1, i, "way") for i in range(1, 20, 3)] + [(2, 1, "turn"), (2, 3, "stop")]
    assert segments.propose_boundaries(df.where("false"), 3.0, 0.1, 100.0).isEmpty()


def test_connectors_equal_dijkstra_of_bounded_hops(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(8), rng.randrange(8), float(rng.randrange(1, 9))) for _ in range(20)]
    edges = [e for e in edges if e[0] != e[1]]
    asked = [(a, b) for a in range(8) for b in range(8) if a != b]
    got = routes.connectors(spark.createDataFrame(edges, "u long, v long, len_m double"), spark.createDataFrame(asked, "u long, v long"), 3)
    for r in got.collect():
        best = {r["u"]: 0.0}
        found = math.inf
        for _ in range(3):
            after = {}
            for u, v, w in edges:
                if u in best:
                    after[v] = min(after.get(v, math.inf), best[u] + w)
            best = after
            found = min(found, best.get(r["v"], math.inf))
        assert (r["length_m"] if r["length_m"] is not None else math.inf) == found


GPX = """<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>
<trkpt lat="51.5" lon="-0.1"><ele>12.5</ele><time>2024-01-01T10:00:00Z</time></trkpt>
<trkpt lat="51.6" lon="-0.2"></trkpt></trkseg></trk></gpx>"""
OSM = """<osm><way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="6"><nd ref="1"/></way></osm>"""


def test_readers(spark, tmp_path):
    (tmp_path / "one.GPX").write_text(GPX)
    (tmp_path / "map.osm").write_text(OSM)
    (tmp_path / "part_000012.json").write_text('{"code": "Ok"}')
    rows = sorted(readers.read_gpx(spark, str(tmp_path / "one.GPX")).collect(), key=lambda r: r["i"])
    assert [(r["ride_id"], r["lat"], r["lon"], r["elv"]) for r in rows] == [("one", 51.5, -0.1, 12.5), ("one", 51.6, -0.2, None)]
    assert rows[0]["time"] is not None and rows[1]["time"] is None
    way = readers.read_osm_ways(spark, str(tmp_path / "map.osm")).collect()
    assert [(w["way_id"], w["nodes"], w["tags"]) for w in way] == [(5, [1, 2], {"highway": "primary"})]
    chunk = readers.read_match_json(spark, str(tmp_path / "part_000012.json"), "code string").collect()
    assert [(c["code"], c["chunk_idx"]) for c in chunk] == [("Ok", 12)]


def test_ride_sessions(spark, tmp_path):
    rows = spark.sql("select 1L as ride_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) as time from values (0), (3), (20) as t(s)")
    want = [(1, 2), (1, 1)]
    assert [(r["ride_id"], r["n"]) for r in ride_sessions(rows).orderBy("start").collect()] == want
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ride_sessions(stream, late="0 seconds").writeStream.format("memory").queryName("rides").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("rides").collect()) == [1, 2]


def test_known_segments_are_found_anywhere_along_a_route(spark):
    from rideframe import catalogue_routes as c
    from rideframe.plans import adapters as A

    data = "/root/testdata/sf0.001"
    p = [r.ways for r in c.parts(spark, data).collect()]
    known = {w for w in p if p.count(w) >= 3 and len(w) >= 3}
    want = []
    for r in A.sections(spark, data).groupBy("ride_id").agg(routes.ordered("pos", F.col("way_id") % 5).alias("route")).collect():
        for i in range(len(r.route)):
            for j in range(i + 1, len(r.route) + 1):
                w = ";".join(map(str, r.route[i:j]))
                want += [(r.ride_id, i, w)] * (w in known)
    got = [tuple(r) for r in c.route_known_segments(spark, data).collect()]
    assert sorted(got) == sorted(want)
    assert any(i > 0 for _, i, _ in got)


def test_connectors_of_any_number_of_edges(spark):
    rng = random.Random(11)
    edges = [(i, i + 1, float(rng.randrange(1, 5))) for i in range(9)] + [(0, 3, 40.0), (2, 7, 3.0), (4, 1, 0.0), (1, 4, 0.0)]
    asked = [(a, b) for a in (0, 1, 5) for b in range(10) if a != b]
    cost = {(a, b): 0.0 if a == b else math.inf for a in range(10) for b in range(10)}
    step = {(u, v): w for u, v, w in edges}
    cost.update({k: min(cost[k], w) for k, w in step.items()})
    for k, a, b in itertools.product(range(10), repeat=3):
        cost[a, b] = min(cost[a, b], cost[a, k] + cost[k, b])
    e, pairs = spark.createDataFrame(edges, "u long, v long, len_m double"), spark.createDataFrame(asked, "u long, v long")
    for got in (routes.connectors(e, pairs).collect(), routes.connector_nodes(e, pairs).collect()):
        assert sorted((r.u, r.v) for r in got) == sorted(asked)
        assert all((math.inf if r.length_m is None else r.length_m) == cost[r.u, r.v] for r in got)
    for r in got:
        if r.length_m is None:
            assert r.nodes == []
        else:
            assert (r.nodes[0], r.nodes[-1]) == (r.u, r.v) and sum(step[x] for x in zip(r.nodes, r.nodes[1:])) == r.length_m
    assert max(len(r.nodes) for r in got) > 5
