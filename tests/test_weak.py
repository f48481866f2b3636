"""Gaps in matching, order of file scans, known sequences along routes, odd numbers in XML, boundaries by attributes."""

import json
import random

from pyspark.sql import functions as F

from rideframe.functions import text
from rideframe.operators import matching, routes, segments
from rideframe.sources import readers


def test_viterbi_parts_a_chunk_at_a_gap(spark):
    """Without the gap, the jump over the lost point would pull the last point to the wrong node."""
    nodes = spark.createDataFrame([(1, 51.0, 0.0), (2, 51.01, 0.0), (3, 51.0101, 0.0)], "node_id long, nlat double, nlon double")
    points = [(1, 0, 0, 51.0, 0.0), (1, 0, 5, 52.0, 0.0), (1, 0, 9, 51.01003, 0.0), (1, 1, 10, 51.0, 0.0), (2, 0, 0, 52.0, 0.0), (3, 0, 0, 51.0, 0.0)]
    got = matching.viterbi(spark.createDataFrame(points, "ride_id long, chunk long, seq long, lat double, lon double"), nodes, 100.0, 20.0, 0.01)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 1), (1, 0, 9, 2), (1, 1, 10, 1), (3, 0, 0, 1)]


def test_segments_of_files_keep_their_order(spark, tmp_path):
    rng, want = random.Random(3), []
    for name in ("b", "a"):
        seq, body = 0, []
        for segment in range(40):
            n = rng.randint(0, 30)
            body.append("<trkseg>" + "".join(f'<trkpt lat="{segment}" lon="{i}"><ele>1</ele></trkpt>' for i in range(n)) + "</trkseg>")
            want += [(name, segment, i, seq + i, float(segment), float(i)) for i in range(n)]
            seq += n
        (tmp_path / f"{name}.gpx").write_text("<gpx><trk>\n" + "\n".join(body) + "</trk></gpx>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):  # the numbers don't depend on the splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_gpx(spark, str(tmp_path)).collect()
            assert sorted((r.ride_id, r.segment, r.i, r.seq, r.lat, r.lon) for r in rows) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_known_sequences_along_routes_equal_brute_force(spark):
    rng = random.Random(8)
    rides = {r: [rng.randrange(3) for _ in range(rng.randint(1, 40))] for r in range(12)}
    known = [[rng.randrange(3) for _ in range(n)] for n in (1, 2, 2, 3, 4, 6, 9)] + [rides[3][2:20], [7, 8]]
    steps = spark.createDataFrame([(r, i, w) for r, ways in rides.items() for i, w in enumerate(ways)], "ride_id long, pos long, way long")
    got = routes.known_along(steps, spark.createDataFrame([(k, w) for k, w in enumerate(known)], "key long, ways array<long>"))
    want = [(r, i, k) for r, ways in rides.items() for k, w in enumerate(known) for i in range(len(ways) - len(w) + 1) if ways[i : i + len(w)] == w]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_numbers_that_json_lacks_are_text(spark):
    words = ["nan", "Infinity", "-inf", "1_000", "1e999", "12", "-3.5", ".5", "1e3", "9" * 30, " 7 "]
    df = spark.createDataFrame([(f"<a><b>{w}</b></a>",) for w in words], "x string")
    refuse = lambda c: (_ for _ in ()).throw(ValueError(c))
    got = [json.loads(r.j, parse_constant=refuse)["b"] for r in df.select(text.xml_json(F.col("x")).alias("j")).collect()]
    assert got == ["nan", "Infinity", "-inf", "1_000", "1e999", 12, -3.5, 0.5, 1000.0, 1e30, 7]


def test_boundaries_where_attributes_change(spark):
    rows = [(1, i, 100_000 * i, 0.0, 5.0, 1, "primary" if i < 4 else None, "asphalt" if i < 7 else "gravel") for i in range(10)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, cum_mm long, heading_delta double, speed_mps double, way_id long, highway string, surface string")
    got = [(r.seq, r.why) for r in segments.propose_boundaries(df, 3.0, 0.1, 100.0, ["highway", "surface"]).orderBy("seq").collect()]
    assert got == [(4, "highway"), (7, "surface")]
    assert segments.propose_boundaries(df, 3.0, 0.1, 100.0).isEmpty()


def plain_leaves(value, place=()):
    for i, (k, v) in enumerate(sorted(value.items()) if isinstance(value, dict) else enumerate(value)):
        if isinstance(v, dict | list):
            yield from plain_leaves(v, (*place, i))
        elif v is not None:
            yield (*place, i), str(k), v if isinstance(v, str) else json.dumps(v)


def test_leaves_of_any_depth_equal_a_plain_version(spark):
    rng = random.Random(6)

    def drawn(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([None, True, 3, -2.5, "x", "", "\u00e9 y"])
        n = rng.randint(0, 3)
        return {k: drawn(depth - 1) for k in rng.sample("abcd", n)} if kind < 0.7 else [drawn(depth - 1) for _ in range(n)]

    values = [drawn(6) for _ in range(60)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, "["), (101, None), (102, "3"), (103, "{}")]
    got = text.leaf_rows(spark.createDataFrame(rows, "id long, j string"), ["id"], "j").collect()
    want = [(i, p, k, v) for i, value in enumerate(values) if isinstance(value, dict | list) for p, k, v in plain_leaves(value)]
    assert sorted((r.id, tuple(r.place), r.key, r.value) for r in got) == sorted(want)
    assert text.leaf_rows(spark.createDataFrame([], "id long, j string"), ["id"], "j").count() == 0
