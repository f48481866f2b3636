"""Readers and writers of raw files, merges against plain versions, and text of any shape."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rideframe.functions import text, units
from rideframe.operators import routes, segments, signal
from rideframe.sources import matches, readers

GPX = """<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:g="urn:x"><trk><trkseg>
<trkpt lat="51.5" lon="-0.1"><ele>12.5</ele><time>2024-01-01T10:00:00Z</time><extensions><g:TrackPointExtension><g:hr>131</g:hr><g:hr>140</g:hr><g:atemp> </g:atemp></g:TrackPointExtension><power>250.5</power></extensions></trkpt>
<trkpt lat="51.6" lon="-0.2"></trkpt></trkseg></trk></gpx>"""
OSM = """<osm><node id="1" lat="51.5" lon="-0.1"/><node id="2" lat="51.501" lon="-0.1"/><node id="9" lat="151.5" lon="-0.1"/>
<way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way><way id="6"><nd ref="1"/><nd ref="9"/></way></osm>"""
RESULT = {
    "code": "Ok",
    "matchings": [{"confidence": 0.9, "route_nodes": [4, 5], "legs": [{"distance": 7.5, "duration": 2, "weight": 3, "annotation": {"nodes": [4, 5], "distance": [7.5]}, "runs": [{"way_id": 9, "dir": 1, "edge_count": 1, "length_m": 7.5}]}]}],
    "tracepoints": [None, {"waypoint_index": 0, "matchings_index": 0, "location": [-0.1, 51.5], "gpx_list": [{"lat": 1, "lon": 2, "elevation": "12.5"}, {"lat": 1, "lon": 2, "elv": "x", "ele": 3}, {"lat": 1, "lon": 2}]}],
}


def test_extensions_of_any_shape(spark, tmp_path):
    (tmp_path / "one.gpx").write_text(GPX)
    rows = readers.read_gpx_extensions(spark, str(tmp_path / "one.gpx")).orderBy("i", "place").collect()
    assert [(r.ride_id, r.i, r.lat, r.lon, r.key, r.value) for r in rows] == [("one", 0, 51.5, -0.1, "0", "131"), ("one", 0, 51.5, -0.1, "1", "140"), ("one", 0, 51.5, -0.1, "power", "250.5")]
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"canonical": "power_w", "synonyms": ["Power", "watts"], "coerce": "float"}, {"canonical": "other", "synonyms": ["power"], "coerce": "int"}]}))
    rules = units.read_rules(spark, str(tmp_path / "rules.json"))
    assert {(r.synonym, r.canonical) for r in rules.collect()} == {("power", "power_w"), ("watts", "power_w")}
    told = units.extension_maps(spark.createDataFrame(rows), rules, "i", "place", "key", "value").collect()
    assert [(r.i, r.extensions) for r in told] == [(0, {"power_w": 250.5})]


def test_ways_with_a_node_off_the_map_have_no_edges(spark, tmp_path):
    (tmp_path / "map.osm").write_text(OSM)
    ways, nodes = readers.read_osm_ways(spark, str(tmp_path / "map.osm")), readers.read_osm_nodes(spark, str(tmp_path / "map.osm"))
    assert sorted(r.way_id for r in ways.collect()) == [5, 6]
    edges = sorted((r.u, r.v, r.way_id, r.dir, r.seq, round(r.len_m)) for r in readers.way_edges(ways, nodes).collect())
    assert edges == [(1, 2, 5, 1, 0, 111), (2, 1, 5, -1, 0, 111)]


def test_results_into_tables(spark, tmp_path):
    (tmp_path / "ride_a.json").write_text(json.dumps(RESULT))
    (tmp_path / "ride_b.json").write_text('{"matchings": []}')
    r = matches.read_results(spark, str(tmp_path))
    assert sorted((x.ride_id, x.code, x.matching is not None, x.route_nodes) for x in r.collect()) == [("ride_a", "Ok", True, [4, 5]), ("ride_b", "Error", False, None)]
    assert [(x.leg_idx, x.distance, x.nodes) for x in matches.legs(r).collect()] == [(0, 7.5, [4, 5])]
    assert [(x.run_idx, x.way_id, x.length_m) for x in matches.runs(r).collect()] == [(0, 9, 7.5)]
    assert [(x.seq, x.matched, x.waypoint_index, x.n_gpx) for x in matches.tracepoints(r).orderBy("seq").collect()] == [(0, False, None, 0), (1, True, 0, 3)]
    assert [x.elv for x in matches.gpx_points(r).orderBy("i").collect()] == [12.5, 0.0, 0.0]
    rides = spark.createDataFrame([("RIDE_A",)], "ride_id string")
    assert [x.ride_id for x in matches.missing_rides(r, rides).collect()] == ["ride_b"]
    matches.write_matches(r, str(tmp_path / "out"))
    assert sorted((x.ride_id, x.status) for x in spark.read.json(str(tmp_path / "out")).collect()) == [("ride_a", "matched"), ("ride_b", "gap")]


def test_requests_and_payloads(spark, tmp_path):
    p = spark.createDataFrame([(1, "000000", "1;2", "10;20", [(51.5, -0.1), (51.6, -0.2)])], "ride_id long, chunk string, timestamps string, radiuses string, points array<struct<lat:double,lon:double>>")
    r = matches.match_requests(p, routes.polyline(F.col("points"), 6)).first()
    assert r.parameters["radiuses"] == "10;20" and r.parameters["gaps"] == "ignore" and r.polyline6
    matches.write_payloads(p, str(tmp_path / "payloads"))
    assert [(x.ride_id, x.chunk) for x in spark.read.json(str(tmp_path / "payloads")).collect()] == [(1, "000000")]
    assert (tmp_path / "payloads" / "ride_id=1").is_dir()


def test_chunks_without_an_index_are_an_error(spark, tmp_path):
    (tmp_path / "part.json").write_text('{"code": "Ok"}')
    with pytest.raises(Exception, match="no index in the name"):
        readers.read_match_json(spark, str(tmp_path / "part.json"), "code string").collect()


def plain_merge(sections, threshold):
    """Cheapest boundary first, costs taken anew each time; sections: (length, tags)."""
    parts = [([i], n, t) for i, (n, t) in enumerate(sections)]
    while len(parts) > 1:
        costs = [segments.boundary_cost(a[2], b[2]) for a, b in zip(parts, parts[1:])]
        k = min(range(len(costs)), key=costs.__getitem__)
        if costs[k] >= threshold:
            break
        a, b = parts[k], parts.pop(k + 1)
        parts[k] = (a[0] + b[0], a[1] + b[1], b[2] if b[1] > a[1] else a[2])
    return [s for s, p in enumerate(parts) for _ in p[0]]


def test_greedy_merge_equals_a_plain_version():
    rng = random.Random(4)
    for n in [1, 2, 3, *[rng.randrange(4, 60) for _ in range(60)]]:
        lanes = rng.choice([[None], ["lane", "track"], ["lane", "track", None]])
        sections = [(float(rng.randrange(1, 9)), (rng.choice(["primary", "secondary", "tertiary"]), rng.choice(["asphalt", "gravel", "concrete"]), rng.choice(["good", "bad", None]), float(rng.randrange(10, 40)), rng.choice(lanes))) for _ in range(n)]
        costs = [math.nan] + [segments.boundary_cost(a[1], b[1]) for a, b in zip(sections, sections[1:])]
        got = segments.merge_part(costs, [s[0] for s in sections], [s[1] for s in sections], 0.6)
        assert got == plain_merge(sections, 0.6)


def test_a_merge_carries_the_cycleway_on(spark):
    """Surface 0.1, then cycleway 0.2 and surface 0.1: after the first merge the other boundary still costs 0.2."""
    rows = [(1, 0, 100.0, "gravel", "lane"), (1, 1, 10.0, "dirt", "lane"), (1, 2, 50.0, "gravel", "track")]
    df = spark.createDataFrame(rows, "ride_id long, pos long, len_m double, surface string, cycleway string").selectExpr("*", "'primary' as highway", "'good' as smoothness", "30 as maxspeed")
    got = lambda df: [r.segment_id for r in segments.greedy_merge(df, 0.2).orderBy("pos").collect()]
    assert got(df) == [0, 0, 1]
    assert got(df.drop("cycleway")) == [0, 0, 0]


def test_one_cost_for_columns_and_plain_sections(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["primary", "residential", "primary_link", None]), rng.choice(["asphalt", "gravel", None]), rng.choice(["good", "bad", None]), rng.choice([20, 30, None]), rng.choice(["lane", "track", None])) for i in range(80)]
    df = segments.merge_cost(spark.createDataFrame(rows, "ride_id long, pos long, highway string, surface string, smoothness string, maxspeed int, cycleway string"))
    got = {r.pos: r.cost for r in df.collect()}
    tags = [(r[2], r[3], r[4], math.nan if r[5] is None else float(r[5]), r[6]) for r in rows]
    for i in range(1, 80):
        assert got[i] == pytest.approx(segments.boundary_cost(tags[i - 1], tags[i]))


def test_smoothing_over_many_rides(spark):
    rng = random.Random(2)
    rows = [(r, i, 1000 * i * (1 + r % 3), rng.uniform(-12, 12)) for r in range(30) for i in range(rng.randrange(1, 25))]
    got = {(r.ride_id, r.seq): r.smoothed for r in signal.smoothed_gradient(spark.createDataFrame(rows, "ride_id long, seq long, cum_mm long, gradient_pct double"), 5.0).collect()}
    for r, i, at, _ in rows:
        near = [(math.exp(-0.5 * ((c - at) / 1000 / (5 / 3)) ** 2) * (1 + 0.6 * min(abs(g) / 10, 1)), g) for q, _, c, g in rows if q == r and abs(c - at) <= 5000]
        assert got[r, i] == pytest.approx(sum(w * g for w, g in near) / sum(w for w, _ in near))


def test_odd_text(spark):
    df = spark.createDataFrame([("<a><b>1</b></a>",), ("<a><b>",), (None,)], "x string")
    assert [r.j for r in df.select(text.xml_json(F.col("x")).alias("j")).collect()] == ['{"b": 1}', None, None]
    df = spark.createDataFrame([('{"a": {"b": null, "c": [1, {"d": "x"}, 1]}}',), ("[",), ("3",), (None,)], "x string")
    got = df.select(text.json_leaves(F.col("x")).alias("l")).collect()
    assert [(e.key, e.value) for e in got[0].l] == [("0", "1"), ("d", "x"), ("2", "1")] and [g.l for g in got[1:]] == [None, None, None]
    err = spark.createDataFrame([('{"a":\n 1',), ("{}",), (None,)], "x string").select(text.json_error(F.col("x")).alias("e")).collect()
    assert (err[0].e.line, err[0].e.col) == (2, 3) and err[1].e.line is None and err[2].e.line is None
    times = spark.createDataFrame([("2024-01-01T00:00:10Z",), ("2024-01-01T02:00:10+02:00",), ("2024-01-01T00:00:10",), ("soon",), (None,)], "x string")
    assert [r.s for r in times.select(text.iso_epoch(F.col("x")).alias("s")).collect()] == [1704067210] * 3 + [None] * 2


def test_polylines_come_back(spark):
    rng = random.Random(3)
    shapes = [[(round(rng.uniform(-90, 90), 5), round(rng.uniform(-180, 180), 5)) for _ in range(n)] for n in (0, 1, 2, 40)] + [[(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]]
    df = spark.createDataFrame([(s,) for s in shapes], "p array<struct<lat:double,lon:double>>").withColumn("t", routes.polyline(F.col("p"))).withColumn("b", routes.decode_polyline(F.col("t")))
    rows = df.collect()
    assert rows[-1].t == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    for s, r in zip(shapes, rows):
        assert [(round(x.lat, 5), round(x.lon, 5)) for x in r.b] == s


def test_merged_parts_are_cut_from_lists(monkeypatch):
    """Many parts in one pass equal each by itself, and none is cut from the table by itself."""
    rng, rows = random.Random(9), []
    for ride_id in range(60):
        for part in range(rng.randrange(1, 3)):
            own = [(float(rng.randrange(1, 9)), (rng.choice(["primary", "secondary"]), rng.choice(["asphalt", "gravel", None]), "good", rng.choice([20.0, math.nan]), None)) for _ in range(rng.randrange(1, 6))]
            costs = [math.nan] + [segments.boundary_cost(a[1], b[1]) for a, b in zip(own, own[1:])]
            told = segments.merge_part(costs, [s[0] for s in own], [s[1] for s in own], 0.6)
            rows += [(ride_id, part, len(rows), metres, cost, *tags, segment) for (metres, tags), cost, segment in zip(own, costs, told)]
    df = pd.DataFrame(rows, columns=["ride_id", "part", "pos", "len_m", "cost", "highway", "surface", "smoothness", "maxspeed", "cycleway", "want"])
    monkeypatch.setattr(pd.DataFrame, "iloc", property(lambda _: pytest.fail("a part is cut from the table")))
    assert segments._merge_rides(0.6)(df, None)["segment_id"].tolist() == df["want"].tolist()
