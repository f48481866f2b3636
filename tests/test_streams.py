"""Stateful streams against the same by windows, over shuffled late points."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rideframe import catalogue_roads, storage
from rideframe.streaming import state

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
START = datetime(2024, 1, 1)
COLUMNS = ["ride_id", "point_id", "time", "part", "step_mm", "cum_mm"]


def drawn(rides=4, points=50):
    rng, rows = random.Random(1), []
    for ride in range(rides):
        at = START
        for _ in range(points):
            at += timedelta(seconds=rng.choice([0, 1, 2, 3, 30]))
            rows.append((ride, len(rows), at, None if rng.random() < 0.05 else 51 + rng.random() / 100, rng.random() / 100))
    return rows


def streamed(spark, folder, batches):
    source = str(folder / "in")
    for rows in batches:
        spark.createDataFrame(rows, state.POINTS).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)  # files are taken in order of their time
    stream = spark.readStream.schema(state.POINTS).option("maxFilesPerTrigger", 1).parquet(source)
    out = state.tracked_stream(stream, 10.0, "60 seconds").writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state"))
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out")).where("ride_id >= 0")


def ends(k):
    return [[(-1, -1 - i, START + timedelta(days=400 + i), 0.0, 0.0)] for i in range(k)]


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_stream_of_late_points_equals_the_table(spark, tmp_path):
    rows, rng = drawn(), random.Random(2)
    by_arrival = [r for _, r in sorted((r[2] + timedelta(seconds=rng.uniform(0, 50)), r) for r in rows)]
    by_arrival.insert(20, (None, 9999, START, 51.0, 0.0))
    batches = [by_arrival[k : k + 40] for k in range(0, len(by_arrival), 40)]
    for b in batches:
        rng.shuffle(b)
    got = streamed(spark, tmp_path, [*batches, *ends(2)]).select(COLUMNS)
    want = state.tracked_table(spark.createDataFrame(rows, state.POINTS), 10.0).select(COLUMNS)
    assert got.count() == len(rows) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert want.agg(F.max("part")).first()[0] > 2


def test_table_of_parts_and_places(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, 1, at(0), 51.0, 0.0), (1, 2, at(5), None, 0.0), (1, 3, at(9), 51.001, 0.0), (1, 4, at(30), 51.002, 0.0), (1, 5, at(31), 51.003, 0.0), (2, 6, at(0), 51.0, 0.0), (None, 7, at(0), 51.0, 0.0), (1, 8, None, 51.0, 0.0)]
    got = {r.point_id: (r.part, r.step_mm) for r in state.tracked_table(spark.createDataFrame(rows, state.POINTS), 10.0).collect()}
    step = round(6371000 * 3.141592653589793 / 180)  # a thousandth of a degree in millimetres
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, step), 4: (1, 0), 5: (1, step), 6: (0, 0)}


def test_running_means_of_a_library(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("abcdef"), i, rng.random()) for i in range(90)] + [(None, 1, 0.5), ("a", None, 0.5), ("g", 7, None)]
    source = str(tmp_path / "in")
    for k in range(0, len(rows), 31):
        spark.createDataFrame(rows[k : k + 31], "segment_key string, ride_id long, tss double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("segment_key string, ride_id long, tss double").option("maxFilesPerTrigger", 1).parquet(source)
    seen = {}

    def keep(df, batch):
        for r in df.collect():
            assert r.segment_key not in seen or seen[r.segment_key][0] < r.hits
            seen[r.segment_key] = (r.hits, r.mean_tss, r.last_ride)

    state.library_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    for key in "abcdef":
        own = [(i, x) for k, i, x in rows if k == key and i is not None]
        assert seen[key] == (len(own), pytest.approx(sum(x for _, x in own) / len(own)), max(i for i, _ in own))
    assert set(seen) == set("abcdef")


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_a_week_is_one_batch_of_the_stream(spark, monkeypatch):
    """However many partitions the points come in."""
    folders, new = [], storage.new_folder
    monkeypatch.setattr(storage, "new_folder", lambda s, name: folders.append(new(s, name)) or folders[-1])
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = catalogue_roads.streamed_rides(spark, DATA).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n == spark.read.parquet(f"{DATA}/events.parquet").count()
    out = next(f for f in folders if "/tracked-" in f).removeprefix("file:")
    assert len([x for x in os.listdir(f"{out}-state/offsets") if not x.startswith(".")]) <= 8  # five weeks, the end, and what it sets free


def test_a_library_stream_calls_no_python_for_its_keys(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.5), ("b", 3, 1.0)], "segment_key string, ride_id long, tss double")
    out = state.library_stream(rows)
    assert "Pandas" not in out._jdf.queryExecution().toString()
    assert ", ".join(f"{c} {t.replace('bigint', 'long')}" for c, t in out.dtypes) == state.LIBRARY
    assert {tuple(r) for r in out.collect()} == {("a", 2, 1.0, 2), ("b", 1, 1.0, 3)}
