"""Corridors of many rides."""

import random

from pyspark.sql import functions as F

from rideframe.operators import corridors

SIZE = 0.001


def plain_roots(cells):
    root = {}
    for c in sorted(cells):
        if c in root:
            continue
        open_ = [c]
        while open_:
            y, x = open_.pop()
            if (y, x) not in root:
                root[y, x] = c
                open_ += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in cells]
    return root


def test_components_equal_a_flood(spark):
    rng = random.Random(2)
    cells = {(rng.randrange(18), rng.randrange(18)) for _ in range(120)} | {(40, x) for x in range(60)} | {(60 + i, 60 + i) for i in range(30)}
    df = spark.createDataFrame([(y, x) for y, x in cells], "cy long, cx long").select(corridors.cell_id(F.col("cy"), F.col("cx")).alias("cell"), "cy", "cx")
    number = {r.cell: (r.cy, r.cx) for r in df.collect()}
    got = corridors.components(df.selectExpr("cell as node"), corridors.neighbours(df)).collect()
    assert {number[r.node]: number[r.root] for r in got} == plain_roots(cells)


def test_two_planted_corridors_are_found(spark):
    """Five rides along a bend and four along a diagonal, in the noise of forty that share nothing."""
    rng = random.Random(7)
    bend = [(10, x) for x in range(10, 22)] + [(y, 22) for y in range(11, 20)]
    slope = [(60 + i, 60 + i) for i in range(15)]
    rows = []
    for ride, cells in [*((r, bend) for r in range(5)), *((10 + r, slope) for r in range(4))]:
        rows += [(ride, i, (y + rng.random()) * SIZE, (x + rng.random()) * SIZE) for i, (y, x) in enumerate(cells)]
    rows += [(0, 900 + i, 10.5 * SIZE, 10.5 * SIZE) for i in range(50)]  # one ride that stands still
    rows += [(100 + r, 0, rng.uniform(100, 400) * SIZE, rng.uniform(100, 400) * SIZE) for r in range(40)] + [(1, 999, None, 0.0)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lon double")
    found = corridors.corridors(df, SIZE, SIZE, 4, 3)
    cells = {}
    for r in found.collect():
        cells.setdefault(r.corridor, set()).add((r.cy, r.cx))
    assert sorted(map(sorted, cells.values())) == sorted(map(sorted, (bend, slope)))
    paths = {}
    for r in corridors.corridor_paths(found).orderBy("corridor", "pos").collect():
        paths.setdefault(r.corridor, []).append((r.cy, r.cx))
    for corridor, path in paths.items():
        want = bend if (10, 10) in cells[corridor] else slope
        assert path[0] in (want[0], want[-1]) and path[-1] in (want[0], want[-1]) and path[0] != path[-1]
        assert set(path) <= set(want) and len(path) >= len(want) - 1  # a corner may be cut
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))
    assert len(paths) == 2
    assert corridors.corridor_paths(corridors.corridors(df.where("false"), SIZE, SIZE, 1, 1)).isEmpty()
