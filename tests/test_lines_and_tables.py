"""Simplified lines within their bound, and stored tables that keep what a batch doesn't touch."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from rideframe.operators import matching, segments, simplify
from rideframe.sources import stored

POINTS = "ride_id long, seq long, lat double, lon double, elv double"


def wandering(n, seed):
    rng = random.Random(seed)
    lat, lon, elv, out = 51.0, 0.0, 100.0, []
    for i in range(n):
        lat, lon, elv = lat + rng.uniform(-1, 3) * 1e-5, lon + rng.uniform(-1, 3) * 1e-5, elv + rng.uniform(-1, 1)
        out.append((i, lat, lon, None if rng.random() < 0.05 else elv))
    return out


def off(p, a, b, line, rise):
    """How far p is from the segment from a to b, in tolerances, in the plane at a."""
    k = 6371000 * math.pi / 180
    flat = lambda q: ((q[2] - a[2]) * math.cos(math.radians(a[1])) * k, (q[1] - a[1]) * k)
    (x, y), (dx, dy) = flat(p), flat(b)
    t = min(1.0, max(0.0, (x * dx + y * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy else 0.0
    out = math.hypot(x - t * dx, y - t * dy) / line
    return max(out, abs(p[3] - (a[3] + t * (b[3] - a[3]))) / rise) if None not in (p[3], a[3], b[3]) else out


def test_simplified_lines_keep_to_their_bound(spark):
    rides = {1: wandering(400, 1), 2: wandering(300, 2), 3: [(0, 51.0, 0.0, 1.0)], 4: [(i, 51.0 + i / 1000, 0.0, 5.0) for i in range(50)], 5: [(i, 51.0, 0.0, 5.0) for i in range(9)]}
    rows = [(r, *p) for r, points in rides.items() for p in points] + [(1, 1000, None, 0.0, 1.0), (6, 0, None, None, None)]
    df = spark.createDataFrame(rows, POINTS)
    got = {}
    for r in simplify.simplified(df, F.when(F.col("ride_id") == 2, 40.0).otherwise(5.0), 3.0).collect():
        got.setdefault(r.ride_id, set()).add(r.seq)
    assert got[3] == {0} and got[4] == {0, 49} and got[5] == {0, 8} and 6 not in got and 1000 not in got[1]
    for ride, line in ((1, 5.0), (2, 40.0)):
        points = rides[ride]
        kept = [p for p in points if p[0] in got[ride]]
        assert len(kept) < len(points) / 2 and kept[0] == points[0] and kept[-1] == points[-1]
        for a, b in zip(kept, kept[1:]):
            assert all(off(p, a, b, line, 3.0) <= 1 + 1e-9 for p in points[a[0] + 1 : b[0]])
    assert simplify.simplified(df.where("false"), 1.0, 1.0).isEmpty()


def test_thinning_by_the_accuracy_of_a_ride(spark):
    rows = [(ride, i, 51.0 + i / 10_000, 0.0, 1.0) for ride in (1, 2, 3) for i in range(60)]  # 11 m apart
    df = spark.createDataFrame(rows, POINTS)
    near = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 15.0), (2, 1.0), (3, None)], "ride_id long, distance_m double")
    told = simplify.by_accuracy(df, matching.position_sigma(near), 3.0, 20.0)
    reach = {r.ride_id: r.t for r in told.groupBy("ride_id").agg(F.max("tolerance_m").alias("t")).collect()}
    assert reach[1] == pytest.approx(3 * 1.4826 * 10) and reach[2] == reach[3] == 20.0
    kept = {}
    for r in simplify.thinned(told, F.col("tolerance_m")).collect():
        kept.setdefault(r.ride_id, []).append(r.seq)
    assert sorted(kept[1]) == list(range(0, 60, 5)) and sorted(kept[2]) == list(range(0, 60, 2))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "ways")
    table = stored.StoredTable(spark, path, "way_id", "way_id long, version int, tags string", stored.last_version("way_id", "version"), 8)
    frame = lambda rows: spark.createDataFrame(rows, "way_id long, version int, tags string")
    assert table.read().isEmpty()
    table.upsert(frame([(i, 1, f"a{i}") for i in range(200)] + [(None, 9, "x")]), 1)
    before = files(path)
    touched = table.upsert(frame([(3, 2, "new"), (3, 0, "old"), (500, 1, "more"), (4, 1, "a")]), 2)
    after = files(path)
    assert 0 < len(touched) < 8
    changed = {f.split("bucket=")[1].split("/")[0] for f in before ^ after}
    assert changed == {str(b) for b in touched}  # the other folders keep their files
    got = {r.way_id: (r.version, r.tags) for r in table.read().collect()}
    assert len(got) == 201 and got[3] == (2, "new") and got[500] == (1, "more") and got[4] == (1, "a") and got[7] == (1, "a7")
    assert table.upsert(frame([(3, 3, "again")]), 2) == [] and files(path) == after


def test_a_library_takes_a_batch_once(spark, tmp_path):
    kind = "segment_key string, hits long, mean_tss double, last_ride long"
    table = stored.StoredTable(spark, str(tmp_path / "library"), "segment_key", kind, segments.merged_library, 4)
    one = spark.createDataFrame([(f"s{i}", 2, 0.5, i) for i in range(20)], kind)
    two = spark.createDataFrame([("s1", 2, 1.0, 50), ("t", 1, 0.1, 7)], kind)
    for batch, rows in ((1, one), (2, two), (2, two), (1, one)):
        table.upsert(rows, batch)
    got = {r.segment_key: (r.hits, r.mean_tss, r.last_ride) for r in table.read().collect()}
    assert len(got) == 21 and got["s1"] == (4, 0.75, 50) and got["s2"] == (2, 0.5, 2) and got["t"] == (1, 0.1, 7)


def test_a_batch_that_failed_half_way_is_completed(spark, tmp_path):
    """Only some buckets took the batch: running it again merges it into the others alone."""
    kind = "segment_key string, hits long, mean_tss double, last_ride long"
    table = stored.StoredTable(spark, str(tmp_path / "library"), "segment_key", kind, segments.merged_library, 4)
    rows = spark.createDataFrame([(f"s{i}", 1, 0.5, i) for i in range(20)], kind)
    half = rows.where(F.pmod(F.xxhash64("segment_key"), F.lit(4)) < 2)
    done = table.upsert(half, 1)
    rest = table.upsert(rows, 1)
    assert sorted(done + rest) == [0, 1, 2, 3]
    assert table.read().count() == 20 and {r.hits for r in table.read().collect()} == {1}


def test_a_batch_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    table = stored.StoredTable(spark, str(tmp_path / "ways"), "way_id", "way_id long, version int, tags string", stored.last_version("way_id", "version"), 8)
    rows = spark.createDataFrame([(i % 7, i, "x") for i in range(30)], "way_id long, version int, tags string")
    for batch in range(2):
        table.upsert(rows.mapInPandas(told, rows.schema), batch)
        assert seen.value == 30 * (batch + 1)
    assert table.read().count() == 7
