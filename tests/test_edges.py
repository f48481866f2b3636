"""Values on the edge of a comparison, which the JVM and the C library round differently: query against SQL."""

import random

import duckdb

from rideframe import catalogue


def _same(spark, folder, name, rows):
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, timestamp '2024-01-01' + to_seconds(?), ?, 'view', ?, ?)", [(i, i, ride, value, f'{{"k": {k}}}') for i, (ride, k, value) in enumerate(rows)])
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    got = catalogue.queries()[name](spark, str(folder))
    want = con.sql(f"select {', '.join(got.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_ways_straight_back_part_traces_as_in_sql(spark, tmp_path):
    rng, rows = random.Random(1), []
    for ride in range(400):
        a, b = [(rng.randrange(100), rng.randrange(50_000) / 100) for _ in range(2)]
        rows += [(ride, *p) for p in (a, b, a, b, b, a)]
    _same(spark, tmp_path, "heading_trace_split", rows)


def test_places_half_way_between_are_rounded_as_in_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(ride, rng.randrange(5, 100, 10), rng.choice((50.0, 150.0, 149.99, 250.0))) for ride in range(60) for _ in range(40)]
    _same(spark, tmp_path, "coord_merge", rows)
