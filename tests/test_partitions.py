"""Partitions follow the rows of a table, not a fixed number."""

import os

import pytest

from pyspark.sql import functions as F

from rideframe import storage
from rideframe.operators import network, routes
from rideframe.plans import adapters as A
from rideframe.sources import readers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_rides_are_sorted_in_partitions_of_so_many_rows(spark, monkeypatch):
    few = sorted(map(tuple, A.sections(spark, DATA).collect()), key=repr)
    monkeypatch.setattr(A, "PART_ROWS", 100)
    n = A.read(spark, DATA, "lineitem").count() // 100
    for df in (A.node_path(spark, DATA), A.sections(spark, DATA)):
        assert df.rdd.getNumPartitions() == n > 50
    assert sorted(map(tuple, A.sections(spark, DATA).collect()), key=repr) == few


def test_what_follows_by_ride_needs_no_other_shuffle(spark, capsys):
    network.pairs(A.node_path(spark, DATA)).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_runs_of_chunks_stay_with_their_ride(spark, capsys):
    p = A.node_path(spark, DATA)
    routes.merge_run_lists(routes.chunk_runs(p, 3, ["way_id"]), ["way_id"]).explain()
    assert capsys.readouterr().out.count("Exchange ") == 1


def test_edges_of_ways_are_sorted_in_so_many_partitions(spark):
    ways = spark.createDataFrame([(w, [w, w + 1, w + 2]) for w in range(50)], "way_id long, nodes array<long>")
    nodes = spark.createDataFrame([(i, 51.0 + i / 1000, 0.0) for i in range(51)], "node_id long, lat double, lon double")
    edges = readers.way_edges(ways, nodes, 13)
    assert edges.rdd.getNumPartitions() == 13
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, readers.way_edges(ways, nodes).collect()))


def test_folders_are_written_by_tasks_and_named_as_partitions(spark, tmp_path):
    """The driver moves no file: Spark's writer left its own marks; values are escaped as Spark's writer does."""
    rows = [("a/b=c", 2, "second ☃"), ("a/b=c", 1, "first"), (None, 1, "none"), ("7", 1, ""), ("é %", 1, "x")]
    df = spark.createDataFrame(rows, "k string, i int, value string")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    for _ in range(2):  # the second replaces the first
        storage.write_folders(df, ours, "k", F.col("value"), ["i"], "txt")
    df.repartition(1, "k").sortWithinPartitions("k", "i").drop("i").write.partitionBy("k").text(theirs)
    told = lambda p: sorted((r.k or "", r.value) for r in spark.read.schema("value string, k string").text(p).collect())
    assert told(ours) == told(theirs) == sorted((k or "", v) for k, _, v in rows)
    names = lambda p: {x.name for x in os.scandir(p) if x.is_dir()}
    assert names(ours) == names(theirs) and {x.name for x in os.scandir(ours)} == names(ours)
    assert all(os.listdir(os.path.join(ours, x)) == ["part-00000.txt"] for x in names(ours))
    with open(os.path.join(ours, "k=a%2Fb%3Dc", "part-00000.txt")) as f:
        assert f.read() == "first\nsecond ☃\n"
    storage.write_folders(df.where("false"), ours, "k", F.col("value"), ["i"], "txt")
    assert spark.read.schema("value string").text(ours).count() == 0
