"""Access rules, run assignment, geometry fallbacks and raw-text reports on hand-made rows, and readers on hand-made files."""

import json

from pyspark.sql import functions as F

from rideframe.functions.text import error_context
from rideframe.operators import access, network, routes, scoring
from rideframe.sources import readers

WAY = "way_id long, highway string, tags map<string,string>"


def modes(spark, highway, tags, width=None):
    ways = spark.createDataFrame([(1, highway, tags)], WAY)
    return access.way_modes(ways, width).first()


def test_bicycle_rule_goes_before_the_general_one(spark):
    assert modes(spark, "primary", {"oneway": "yes", "oneway:bicycle": "no"})["flow"] == "both"
    assert modes(spark, "primary", {"oneway": "-1"})["forward_mode"] == "inaccessible"
    assert modes(spark, "primary", {"junction": "roundabout"})["backward_mode"] == "inaccessible"


def test_contraflow_cycleway_opens_a_one_way(spark):
    r = modes(spark, "secondary", {"oneway": "yes", "cycleway:left": "opposite_lane"})
    assert (r["backward_mode"], r["backward_speed"], r["forward_speed"]) == ("cycling", 30.0, 30.0)


def test_one_way_lane_follows_the_way(spark):
    r = modes(spark, "secondary", {"oneway": "-1", "cycleway": "lane"})
    assert (r["cycleway_forward"], r["cycleway_backward"]) == (False, True)


def test_narrow_ways_are_pushed_only_on_foot(spark):
    r = modes(spark, "secondary", {"width": "0.8 m", "foot": "yes"}, width=1.0)
    assert (r["forward_mode"], r["forward_speed"]) == ("pushing", 4.0)
    assert modes(spark, "steps", {"foot": "no"})["forward_mode"] == "inaccessible"
    assert modes(spark, "steps", {})["forward_speed"] == 2.0
    assert modes(spark, "cycleway", {"bicycle": "dismount"})["forward_mode"] == "pushing"


def test_null_tags_and_class(spark):
    r = modes(spark, None, None)
    assert (r["flow"], r["forward_mode"], r["backward_speed"]) == ("both", "inaccessible", 0.0)


def test_cyclability_penalties(spark):
    ways = spark.createDataFrame([(1, "primary", {"oneway": "yes"}), (2, "secondary", {"cycleway": "lane"}), (3, "service", {"service": "alley"})], WAY)
    got = {r["way_id"]: r["forward_rate"] for r in access.cyclability(access.way_modes(ways)).collect()}
    assert round(got[1], 6) == round(60 / 3.6 * 0.25, 6)
    assert round(got[2], 6) == round(30 / 3.6, 6)
    assert round(got[3], 6) == round(25 / 3.6 * 0.5, 6)


def test_node_barriers(spark):
    cases = [({"bicycle": "yes", "access": "no"}, False), ({"vehicle": "private"}, True), ({"access": "no", "highway": "crossing"}, False), ({"barrier": "wall"}, True), ({"barrier": "kerb"}, False), ({"opening": "0.4"}, True), ({}, False)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, tags map<string,string>")
    got = {r["i"]: r["b"] for r in rows.select("i", access.node_barrier(0.5).alias("b")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_points_at_a_seam_take_the_later_run(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 10), (1, 3, 99), (2, 0, 5)], "ride_id long, seq long, at_mm long")
    runs = spark.createDataFrame([(1, 0, 0), (1, 1, 10)], "ride_id long, run_idx long, start_mm long")
    got = {(r["ride_id"], r["seq"]): r["run_idx"] for r in network.assign_runs(points, runs).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 0): None}


def test_leg_geometry_takes_the_first_source_with_points(spark):
    shape = "array<struct<lat:double,lon:double>>"
    df = spark.createDataFrame([(1, [(1.0, 2.0)], "_p~iF~ps|U"), (2, [], "_izlhA~rlgdF_{geC~ywl@"), (3, None, None), (4, None, "")], f"i long, c {shape}, p string")
    got = {r["i"]: r["g"] for r in df.select("i", routes.leg_geometry(coordinates=F.col("c"), polyline=F.col("p")).alias("g")).collect()}
    assert got[1]["chosen"] == "coordinates"
    assert got[2]["chosen"] == "polyline" and [tuple(x) for x in got[2]["shape"]] == [(38.5, -120.2), (40.7, -120.95)]
    assert got[3] is None and got[4] is None


def test_error_context_counts_lines_from_one(spark):
    df = spark.createDataFrame([("ab\ncde", 4), ("", 9), ("x\n", 2)], "t string, at int")
    got = [tuple(r["x"]) for r in df.select(error_context(F.col("t"), F.col("at")).alias("x")).collect()]
    assert got == [(2, 2, "ab\ncde\n    ^"), (1, 1, "\n^"), (2, 1, "x\n\n  ^")]


def test_scale_bands_leave_a_hole(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (300.0,), (500.0,), (3600.0,), (3601.0,)], "s double")
    assert [r[0] for r in df.select(scoring.scale_band(F.col("s"))).collect()] == ["sprint", "short", "middle", None, "long", "endless"]


def test_gpx_scan_flattens_segments_in_order(spark, tmp_path):
    point = lambda lat, extra="": f'<trkpt lat="{lat}" lon="1.5"><ele>7</ele>{extra}</trkpt>'
    body = f'<gpx xmlns="http://www.topografix.com/GPX/1/1" xmlns:g="urn:x"><trk><trkseg>{point(1, "<time>2024-01-01T00:00:00Z</time><extensions><g:hr>150</g:hr></extensions>")}{point(2)}</trkseg><trkseg>{point(3)}</trkseg></trk></gpx>'
    (tmp_path / "Ride.GPX").write_text(body)
    got = readers.read_gpx(spark, str(tmp_path)).orderBy("segment", "i").collect()
    assert [(r["ride_id"], r["lat"], r["elv"]) for r in got] == [("Ride", 1.0, 7.0), ("Ride", 2.0, 7.0), ("Ride", 3.0, 7.0)]
    assert got[0]["time"] is not None and got[1]["time"] is None


def test_osm_scan_keeps_ways_of_two_nodes(spark, tmp_path):
    (tmp_path / "m.osm").write_text('<osm><way id="1"><nd ref="5"/><nd ref="6"/><tag k="highway" v="path"/></way><way id="2"><nd ref="5"/></way><way id="3"><nd ref="6"/><nd ref="7"/></way></osm>')
    got = {r["way_id"]: (r["nodes"], r["tags"]) for r in readers.read_osm_ways(spark, str(tmp_path)).collect()}
    assert got == {1: ([5, 6], {"highway": "path"}), 3: ([6, 7], {})}


def test_match_chunks_take_their_index_from_the_name(spark, tmp_path):
    (tmp_path / "match_000012.json").write_text(json.dumps({"timestamps": [1, 2]}))
    got = readers.read_match_json(spark, str(tmp_path), "timestamps array<long>").first()
    assert (got["chunk_idx"], got["timestamps"]) == (12, [1, 2])
