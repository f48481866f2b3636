"""Searches where many nodes or roads share a place: what is looked at grows with the places, the results stay whole."""

import math
import random

import pytest

from rideframe.operators import matching, roads, routes

POINTS, NODES = "ride_id long, seq long, lat double, lon double", "node_id long, nlat double, nlon double"


@pytest.fixture
def piled(spark, monkeypatch):
    """Points, nodes of which ten share each place, and the counts of nodes that were looked at."""
    rng, looked, real = random.Random(4), [], matching.candidates

    def counted(points, nodes, keys, reach_m):
        looked.append(nodes.count())
        return real(points, nodes, keys, reach_m)

    monkeypatch.setattr(matching, "candidates", counted)
    spots = [(51.5 + rng.randrange(9) / 5000, rng.randrange(9) / 5000) for _ in range(12)]
    nodes = [(rng.randrange(10) * 1000 + 10 * i + k, *spots[i]) for i in range(12) for k in range(10)]
    nodes = list({n[0]: n for n in nodes}.values()) + [(99_999, None, 0.0)]
    points = [(i // 10, i % 10, 51.5 + rng.random() / 500, rng.random() / 500) for i in range(60)]
    return points, nodes, spark.createDataFrame(points, POINTS), spark.createDataFrame(nodes, NODES), looked, len({n[1:] for n in nodes})


def _far(p, n):
    return float(matching.haversine_np(p[2], p[3], n[1], n[2])) if n[1] is not None else math.inf


def test_nearest_and_hits_look_at_places(piled):
    points, nodes, p, n, looked, places = piled
    got = {(r.ride_id, r.seq): (r.distance_m, r.node_id) for r in matching.nearest(p, n, ["ride_id", "seq"], 40.0).collect()}
    best = {q[:2]: min(((round(_far(q, x), 3), x[0]) for x in nodes if _far(q, x) <= 40.0), default=(None, None)) for q in points}
    assert got == best
    hits = {x[0]: sum(_far(q, x) <= 40.0 for q in points) for x in nodes}
    assert {r.node_id: r.hits for r in matching.hits(p, n, ["ride_id", "seq"], 40.0).collect()} == {k: v for k, v in hits.items() if v}
    assert max(looked) <= places


def test_viterbi_looks_at_places_and_takes_the_least_id(piled):
    points, nodes, p, n, looked, places = piled
    least = {}
    for x in nodes:
        if x[1] is not None:
            least[x[1:]] = min(x[0], least.get(x[1:], x[0]))
    got = matching.viterbi(p.selectExpr("*", "0L as chunk"), n, 60.0, 20.0, 50.0).collect()
    single = n.sparkSession.createDataFrame([(k, *place) for place, k in least.items()], NODES)
    want = matching.viterbi(p.selectExpr("*", "0L as chunk"), single, 60.0, 20.0, 50.0).collect()
    assert len(got) and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert max(looked) <= places


def test_a_point_meets_few_of_many_roads(spark, monkeypatch):
    """Every second road lies on another, and all but a few points are on one: those meet only what is near."""
    met, real = [], roads.road_candidates

    def counted(points, lines, keys, reach_m):
        out = real(points, lines, keys, reach_m)
        met.append((lines.count(), out.count()))
        return out

    monkeypatch.setattr(roads, "road_candidates", counted)
    rng = random.Random(6)
    lines = [(2 * i + k, 1000 + i, 200.0, 51.5 + i / 100_000, 0.0, 51.5 + i / 100_000, 0.003) for i in range(60) for k in (1, 0)]
    points = [(1, i, 51.5 + rng.randrange(60) / 100_000, rng.random() * 0.003) for i in range(50)] + [(2, 0, 51.5, -0.0005), (2, 1, 51.6, 0.0), (2, 2, None, 0.0)]
    keys = ["ride_id", "seq"]
    p = spark.createDataFrame(points, POINTS)
    r = spark.createDataFrame(lines, "u long, v long, len_m double, ulat double, ulon double, vlat double, vlon double")
    got = {(x.ride_id, x.seq): (x.u, x.v) for x in roads.nearest_road(p, r, keys, 60.0).collect()}
    whole = {}
    for x in real(p, r, keys, 60.0).collect():
        own = (round(x.distance_m, 3), x.u, x.v)
        whole[x.ride_id, x.seq] = min(own, whole.get((x.ride_id, x.seq), own))
    assert got == {q[:2]: whole.get(q[:2], (0, None, None))[1:] for q in points}
    assert {n for n, _ in met} == {60} and sum(n for _, n in met) < 53 * 20


def test_sequences_that_begin_alike_do_not_all_meet(spark):
    """Of 200 sequences with the same first two ways, a stretch meets its own only."""
    known = spark.createDataFrame([(k, [1, 1, k]) for k in range(200)], "key long, ways array<long>")
    taken = spark.createDataFrame([(r, [1, 1, 10 * r, 5]) for r in range(10)], "ride_id long, route array<long>")
    assert sorted((x.ride_id, x.position, x.key) for x in routes._met(taken, known).collect()) == [(r, 0, 10 * r) for r in range(10)]
