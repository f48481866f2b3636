"""Roads, ways between places and spliced routes against plain versions."""

import heapq
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rideframe import catalogue, catalogue_roads
from rideframe.operators import roads, routes
from test_routes import plain_haversine

ROADS = "u long, v long, len_m double, ulat double, ulon double, vlat double, vlon double"
POINTS = "ride_id long, seq long, lat double, lon double"


def project(p, a, b):
    """(share, metres) of a point against a segment, in the plane at the point."""
    k = 6371000 * math.pi / 180
    flat = lambda q: ((q[1] - p[1]) * math.cos(math.radians(p[0])) * k, (q[0] - p[0]) * k)
    (ax, ay), (bx, by) = flat(a), flat(b)
    dx, dy = bx - ax, by - ay
    t = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy else 0.0
    return t, math.hypot(ax + t * dx, ay + t * dy)


def made(places, pairs):
    return [(u, v, plain_haversine(places[u], places[v]), *places[u], *places[v]) for u, v in pairs]


def test_nearest_road_equals_brute_force(spark):
    rng = random.Random(5)
    places = {i: (51 + rng.random() / 50, rng.random() / 50) for i in range(30)} | {100: (51.0, 0.05), 101: (51.0, 0.08), 102: (51.05, 0.0)}
    pairs = [(a, b) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.15] + [(100, 101), (102, 102)]
    rows = made(places, pairs) + [(200, 201, 5.0, None, 0.0, 51.0, 0.0)]
    points = [(1, s, 51 + rng.random() / 50, rng.random() / 50) for s in range(80)] + [(2, 0, 51.0003, 0.0651), (2, 1, 51.05, 0.0003), (2, 2, None, 0.0), (2, 3, 60.0, 0.0)]
    got = roads.nearest_road(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, ROADS), ["ride_id", "seq"], 60.0)
    got = {(r.ride_id, r.seq): r for r in got.collect()}
    assert len(got) == len(points)
    for ride, seq, lat, lon in points:
        want = (None, None, None)
        if lat is not None:
            met = [(round(project((lat, lon), r[3:5], r[5:])[1], 3), r[0], r[1], project((lat, lon), r[3:5], r[5:])[0] * r[2]) for r in rows if r[3] is not None]
            d, u, v, offset = min(met)
            want = (u, v, d) if d <= 60 else want
        r = got[ride, seq]
        assert (r.u, r.v, r.distance_m) == want
        if want[0] is not None:
            assert abs(r.offset_m - offset) < 1e-6
    far = got[2, 0]  # beside a road of 2 km, a kilometre from both ends
    assert (far.u, far.v) == (100, 101) and 30 < far.distance_m < 40 and 1000 < far.offset_m < 1100


def dijkstra(edges, u):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, 1.0 if w is None else w))
    best, heap = {u: 0.0}, [(0.0, u)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > best[x]:
            continue
        for y, w in out.get(x, ()):
            if d + w < best.get(y, math.inf):
                best[y] = d + w
                heapq.heappush(heap, (d + w, y))
    return best


def enumerated(points, rows, reach, sigma, beta, gap, detour):
    """The likeliest (u, v) of every point, of one part, by trying all."""
    edges = [(r[0], r[1], r[2]) for r in rows]
    near = [[(r, *project(p[2:], r[3:5], r[5:])) for r in rows if project(p[2:], r[3:5], r[5:])[1] <= reach] for p in points]
    best = (-math.inf, None)
    for path in itertools.product(*near):
        score = -sum(0.5 * (d / sigma) ** 2 for _, _, d in path)
        for p, q, (a, s, _), (b, t, _) in zip(points, points[1:], path, path[1:]):
            walked = plain_haversine(p[2:], q[2:])
            if a is b and s <= t:
                moved = (t - s) * a[2]
            else:
                moved = (1 - s) * a[2] + dijkstra(edges, a[1]).get(b[0], math.inf) + t * b[2]
            score -= abs(moved - walked) / beta if walked <= gap and moved <= walked + detour else math.inf
        best = max(best, (score, [x[0][:2] for x in path]), key=lambda x: x[0])
    return best[1]


def test_network_match_equals_enumeration(spark):
    rng = random.Random(9)
    args = (90.0, 30.0, 20.0, 500.0, 400.0)
    for _ in range(3):
        places = {i: (51 + rng.random() / 300, rng.random() / 200) for i in range(7)}
        pairs = [(a, b) for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.4]
        rows = made(places, pairs)
        points = [(1, 10 * s, 51 + rng.random() / 300, rng.random() / 200) for s in range(3)]
        got = roads.network_match(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, ROADS), *args).collect()
        want = enumerated(points, rows, *args)
        if want is not None and all(any(project(p[2:], r[3:5], r[5:])[1] <= 90 for r in rows) for p in points):
            assert [(r.u, r.v) for r in sorted(got, key=lambda r: r.seq)] == want and {r.part for r in got} == {0}


def test_network_match_does_not_jump_to_a_parallel_road(spark):
    """Two parallel roads 40 m apart without a link: one point is nearer to the wrong one, which straight lines would take."""
    places = {0: (51.0, 0.0), 1: (51.0, 0.002), 2: (51.0, 0.004), 10: (51.00036, 0.0), 11: (51.00036, 0.002), 12: (51.00036, 0.004)}
    rows = made(places, [(0, 1), (1, 2), (10, 11), (11, 12)])
    points = [(1, 0, 51.00005, 0.0005), (1, 1, 51.00022, 0.0015), (1, 2, 51.00005, 0.0025), (1, 3, 51.00005, 0.0035), (1, 4, 51.2, 0.0), (1, 5, 51.00005, 0.0036), (2, 0, 51.2, 0.0)]
    got = roads.network_match(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, ROADS), 60.0, 20.0, 10.0, 300.0, 100.0).collect()
    got = {(r.ride_id, r.seq): (r.u, r.v, r.part) for r in got}
    assert got == {(1, 0): (0, 1, 0), (1, 1): (0, 1, 0), (1, 2): (1, 2, 0), (1, 3): (1, 2, 0), (1, 5): (1, 2, 1)}  # a point without a road parts the ride
    assert roads.network_match(spark.createDataFrame([], POINTS), spark.createDataFrame(rows, ROADS), 60.0, 20.0, 10.0, 300.0, 100.0).isEmpty()


EDGES, PAIRS = "u long, v long, len_m double", "u long, v long"


@pytest.mark.parametrize("nodes,n", [(30, 70)])
def test_ways_equal_dijkstra(spark, nodes, n):
    rng = random.Random(nodes)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([None, 0.0, 1.0, 2.5, 7.0, 9.0])) for _ in range(n)]
    asked = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(60)] + [(1, 999), (3, 3)]
    got = routes.connector_nodes(spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, PAIRS)).collect()
    assert len(got) == len(set(asked))
    least = {}
    for u, v, w in edges:
        least[u, v] = min(least.get((u, v), math.inf), 1.0 if w is None else w)
    for r in got:
        want = dijkstra(edges, r.u).get(r.v)
        assert r.length_m == (None if want is None else pytest.approx(want))
        if want is None:
            assert r.nodes == []
        else:
            assert (r.nodes[0], r.nodes[-1]) == (r.u, r.v)
            assert sum(least[p] for p in zip(r.nodes, r.nodes[1:])) == pytest.approx(want)


def test_deep_ways_leave_few_tables_and_unreachable_ones_stop(spark, monkeypatch):
    """A way of 16 edges, and a target without ways in, whose source could reach 300 nodes."""
    edges = [(i, i + 1, 1.0) for i in range(16)] + [(1000 + i, 1001 + i, 1.0) for i in range(300)] + [(7777, 7778, 1.0)]
    seen, write = [], routes.written

    def counted(df, name):
        seen.append(name)
        return write(df, name)

    monkeypatch.setattr(routes, "written", counted)
    df = spark.createDataFrame(edges, EDGES)
    far = routes.connector_nodes(df, spark.createDataFrame([(0, 16)], PAIRS)).collect()[0]
    assert far.length_m == 16.0 and far.nodes == list(range(17))
    assert seen.count("pairs") == 9  # both ends move: half as many rounds as edges
    seen.clear()
    got = routes.connectors(df, spark.createDataFrame([(1000, 7777)], PAIRS)).collect()[0]
    assert got.length_m is None and seen.count("pairs") <= 3


def test_a_search_keeps_its_own_tables_only(spark):
    from rideframe.storage import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], EDGES)
    assert routes.connectors(df, spark.createDataFrame([(0, 12)], PAIRS)).collect()[0].length_m == 12.0
    assert len(set(os.listdir(folder)) - before) == 1  # the result


def test_spliced_routes_equal_a_plain_version(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(1, 9))) for _ in range(30)]
    chunks = [(ride, c, None if rng.random() < 0.3 else [rng.randrange(12) for _ in range(rng.randint(1, 4))]) for ride in range(12) for c in range(5)] + [(99, 0, None), (98, 0, []), (97, 0, [1, 2, 3]), (97, 1, [2, 3, 50]), (97, 2, [60])]
    least = {}
    for u, v, w in edges:
        least[u, v] = min(least.get((u, v), math.inf), w)
    frame = spark.createDataFrame(chunks, "ride_id long, chunk long, nodes array<long>")
    out = routes.spliced(frame, spark.createDataFrame(edges, EDGES), 64)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.ride_id, r.pos)):
        got.setdefault(r.ride_id, []).append(r)
    totals = {r.ride_id: r for r in routes.spliced_totals(out).collect()}
    assert set(got) == {c[0] for c in chunks if c[2]} == set(totals)
    for ride, rows in got.items():
        own = [c[2] for c in sorted(c for c in chunks if c[0] == ride and c[2])]
        length, opened, at, missing = 0.0, 0, 1, 0
        nodes = [r.node_id for r in rows]
        seq = own[0]
        assert nodes[: len(seq)] == seq
        at = len(seq)
        for a, b in zip(own, own[1:]):
            k = max([k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]], default=0)
            if not k:
                cost = dijkstra(edges, a[-1]).get(b[0])
                if cost is None:
                    opened += 1
                else:
                    between = nodes[at - 1 : nodes.index(b[0], at) + 1] if b[0] in nodes[at:] else []
                    upto = next(i for i in range(at, len(rows)) if rows[i].kind == "chunk")
                    between = nodes[at - 1 : upto + 1]
                    assert between[-1] == b[0] and sum(least[p] for p in zip(between, between[1:]) if p[0] != p[1]) == cost
                    at = upto
            assert nodes[at : at + len(b) - k] == b[k:]
            at += len(b) - k
        assert at == len(nodes)
        for i in range(1, len(nodes)):
            p = nodes[i - 1], nodes[i]
            if rows[i].kind == "open" or p[0] == p[1]:
                continue
            length, missing = length + least.get(p, 0.0), missing + (p not in least)
        t = totals[ride]
        assert (t.n_nodes, t.open_seams, t.missing_steps) == (len(nodes), opened, missing)
        assert (t.length_m or 0.0) == pytest.approx(length)
    assert [r.kind for r in got[97]] == ["chunk"] * 4 + ["open"] and totals[97].open_seams == 1


def test_nodes_of_many_edges_give_off_short_ones_first(spark, monkeypatch):
    """Every node leads to all others, to the next five by short edges: a search holds the few labels near its ends, not all nodes of all roots."""
    n = 40
    edges = [(i, j, 1.0 if (j - i) % n <= 5 else 100.0) for i in range(n) for j in range(n) if i != j]
    rows, write = [], routes.written

    def counted(df, name):
        out = write(df, name)
        if name == "labels":
            rows.append(out.count())
        return out

    monkeypatch.setattr(routes, "written", counted)
    got = routes.connectors(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i, (i + 7) % n) for i in range(n)], PAIRS)).collect()
    assert len(got) == n and all(r.length_m == 2.0 for r in got)
    assert max(rows) <= n * (11 + 6)  # all nodes from both ends: 2 * n * n


def test_matching_takes_roads_of_any_length(spark):
    """A cut at 400 m left most steps of the paths out of the network."""
    data = "/root/testdata/sf0.001"
    all_roads = catalogue_roads.road_edges(spark, data, None)
    assert all_roads.where(F.col("len_m") > catalogue_roads.ROAD_M).count() > 0
    matched = catalogue.queries()["viterbi_roads"](spark, data).join(all_roads, ["u", "v"])
    assert matched.where(F.col("len_m") > catalogue_roads.ROAD_M).count() > 0


def test_transitions_in_blocks_equal_those_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    u, v = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    ways = roads._Ways(u, v, rng.integers(1, 60, 40).astype(float), 150.0)
    side = lambda n: {"u": rng.integers(0, 11, n), "v": rng.integers(0, 11, n), "len_m": rng.integers(40, 60, n).astype(float), "offset_m": rng.integers(0, 40, n).astype(float)}
    a, b, score = side(30), side(20), rng.integers(-3, 0, 30).astype(float)
    whole = roads._moved(a, b, ways, score, 50.0, 120.0, 50.0)
    monkeypatch.setattr(roads, "SUMS", 60)
    parts = roads._moved(a, b, ways, score, 50.0, 120.0, 50.0)
    assert np.isfinite(whole[0]).any() and (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_points_of_one_place_meet_the_roads_once(spark, monkeypatch):
    met, best = [], roads._best
    monkeypatch.setattr(roads, "_best", lambda points, *a: met.append(points.count()) or best(points, *a))
    rows = made({0: (51.0, 0.0), 1: (51.0, 0.002)}, [(0, 1)])
    points = [(ride, seq, 51.0 + seq * 1e-4, 0.001) for ride in range(20) for seq in range(3)] + [(20, 0, None, 0.001), (20, 1, 51.2, None)]
    got = roads.nearest_road(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, ROADS), ["ride_id", "seq"], 60.0).collect()
    assert met[0] == 3 and len(got) == len(points)
    assert all((r.u, r.v) == (0, 1) for r in got if r.ride_id < 20) and all(r.u is None for r in got if r.ride_id == 20)


def test_a_search_holds_a_part_of_the_sources_at_a_time(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(24), rng.randrange(24), float(rng.randrange(1, 9))) for _ in range(90)]
    held, write = [], routes.written

    def counted(df, name):
        out = write(df, name)
        held.append(out.where("side = 0").select("root").distinct().count() if name == "labels" else 0)
        return out

    monkeypatch.setattr(routes, "written", counted)
    monkeypatch.setattr(routes, "SOURCES", 12)
    asked = [(u, v) for u in range(24) for v in (3, 17)]
    got = routes.connector_nodes(spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, PAIRS)).collect()
    assert 0 < max(held) < 24 and {(r.u, r.v) for r in got} == set(asked)
    least, out = {}, {}
    for u, v, w in edges:
        least[u, v] = min(w, least.get((u, v), math.inf))
    for (u, v), w in least.items():
        out.setdefault(u, []).append((v, w))
    for r in got:
        best, heap = {r.u: 0.0}, [(0.0, r.u)]
        while heap:
            d, x = heapq.heappop(heap)
            for y, w in out.get(x, ()):
                if d + w < best.get(y, math.inf):
                    best[y] = d + w
                    heapq.heappush(heap, (d + w, y))
        assert r.length_m == best.get(r.v)
        if r.length_m is not None:
            assert (r.nodes[0], r.nodes[-1]) == (r.u, r.v) and sum(least[e] for e in zip(r.nodes, r.nodes[1:])) == r.length_m
