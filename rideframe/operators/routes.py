"""Sequences of nodes, legs and runs: flattening, trimming, merging, connectors and geometry codecs."""

from __future__ import annotations

import bisect
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.storage import dropped, written
from rideframe.operators.network import overlap, path_order, run_lengths


def ordered(order: str, value: Column) -> Column:
    """Values of a group as an array in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def flatten_nodes(legs: DataFrame, most: int) -> DataFrame:
    """(ride_id, nodes): legs (ride_id, legs) in order as one array: each leg loses its largest overlap (<= most) with what came before; then equal neighbours collapse.

    Only the last ``most`` nodes can overlap, so the fold keeps that tail and the cut legs,
    which are joined once; equal neighbours are told by the array beside itself shifted.
    """
    kind = dict(legs.dtypes)["legs"].removeprefix("array<").removesuffix(">")
    none = F.array().cast(kind)

    def step(acc, leg):
        own = F.slice(leg, overlap(acc["tail"], leg, most) + 1, F.size(leg))
        both = F.concat(acc["tail"], own)
        tail = F.slice(both, F.greatest(F.size(both) - most + 1, F.lit(1)), F.lit(most))
        return F.struct(tail.alias("tail"), F.concat(acc["cut"], F.array(own)).alias("cut"))

    cut = F.aggregate("legs", F.struct(none.alias("tail"), F.array().cast(f"array<{kind}>").alias("cut")), step, lambda acc: F.flatten(acc["cut"]))
    joined = legs.select("ride_id", cut.alias("j"))
    shifted = joined.withColumn("b", F.concat(F.array(F.lit(None)), F.slice("j", F.lit(1), F.greatest(F.size("j") - 1, F.lit(0)))))
    pairs = shifted.select("ride_id", F.arrays_zip("j", "b").alias("p"))
    return pairs.select("ride_id", F.transform(F.filter("p", lambda x: ~x["j"].eqNullSafe(x["b"])), lambda x: x["j"]).alias("nodes"))


def merge_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """One row per ride: chunks (chunk, nodes) joined at their seams, n_chunks and seams without an overlap.

    Concatenation is associative, so one ordered aggregation takes the place of a tree of merges.
    """
    w = Window.partitionBy("ride_id").orderBy("chunk")
    cut = chunks.withColumn("before", F.lag("nodes").over(w))
    cut = cut.withColumn("k", F.when(F.col("before").isNotNull(), overlap(F.col("before"), F.col("nodes"), most)))
    cut = cut.withColumn("own", F.slice("nodes", F.coalesce("k", F.lit(0)) + 1, F.size("nodes")))
    return cut.groupBy("ride_id").agg(F.flatten(ordered("chunk", F.col("own"))).alias("nodes"), F.count("*").alias("n_chunks"), F.count_if(F.col("k") == 0).alias("open_seams"))


def trim_legs(legs: DataFrame, most: int) -> DataFrame:
    """Legs (chunk, nodes) without their overlap k with the leg before; legs that are all overlap go.

    Overlaps are judged on the legs as given, so seams do not depend on each other. With a
    column metres, one length a node, distance is the sum of what is left.
    """
    cut = legs.withColumn("before", F.lag("nodes").over(Window.partitionBy("ride_id").orderBy("chunk")))
    cut = cut.withColumn("k", F.when(F.col("before").isNotNull(), overlap(F.col("before"), F.col("nodes"), most)).otherwise(0))
    cut = cut.where(F.size("nodes") > F.col("k"))
    if "metres" in cut.columns:
        cut = cut.withColumn("metres", F.slice("metres", F.col("k") + 1, F.size("metres")))
        cut = cut.withColumn("distance", F.aggregate("metres", F.lit(0.0), lambda a, x: a + x))
    return cut.withColumn("nodes", F.slice("nodes", F.col("k") + 1, F.size("nodes"))).drop("before")


def leg_geometry(**sources: Column) -> Column:
    """(chosen, shape): the first source with a point, in the order given.

    ``polyline`` is decoded at six digits, ``steps`` is an array of shapes to join, ``gpx_list``
    an array of maps in any spelling.
    """
    read = {"polyline": lambda c: decode_polyline(c, 6), "steps": F.flatten, "gpx_list": spelled_points}
    read = {name: read.get(name, lambda c: c)(c) for name, c in sources.items()}
    return F.coalesce(*[F.when(F.size(c) > 0, F.struct(F.lit(name).alias("chosen"), c.alias("shape"))) for name, c in read.items()])


#: How points spell their place.
LATITUDES, LONGITUDES = ["lat", "latitude", "Lat", "Latitude"], ["lon", "lng", "longitude", "Lon", "Longitude"]


def spelled_points(points: Column) -> Column:
    """Array of (lat, lon) from an array of maps under any of the known spellings; points without both are left out."""
    first = lambda m, names: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in names])
    found = F.transform(points, lambda m: F.struct(first(m, LATITUDES).alias("lat"), first(m, LONGITUDES).alias("lon")))
    return F.filter(found, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def trim_runs(runs: DataFrame, edges: int) -> DataFrame:
    """Runs without the first ``edges`` edges of each ride; a run that is cut keeps its share of length_m."""
    upto = F.sum("n").over(Window.partitionBy("ride_id").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, 0))
    left = F.least(F.col("n"), F.greatest(F.lit(0), upto - edges))
    return runs.withColumn("left", left).where("left > 0").withColumn("length_m", F.col("length_m") * F.col("left") / F.col("n")).withColumn("n", F.col("left")).drop("left")


def merge_run_lists(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of several chunks in order (chunk, run_idx) as one list; runs of equal keys at a seam are one."""
    w = Window.partitionBy("ride_id").orderBy("chunk", "run_idx")
    rows = runs.withColumn("pos", F.row_number().over(w)).withColumnRenamed("length_m", "len_m")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(path_order()))
    rows = rows.withColumn("new", F.when((F.col("pos") > 1) & same, 0).otherwise(1))
    rows = rows.withColumn("merged_idx", F.sum("new").over(path_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy("ride_id", F.col("merged_idx").alias("run_idx"), *keys).agg(F.sum("n").alias("n"), F.sum("len_m").alias("length_m"))


def chunk_runs(path: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Runs inside chunks of ``size`` steps."""
    rows = path.withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))
    return run_lengths(rows, keys, ("ride_id", "chunk")).select("ride_id", "chunk", "run_idx", *keys, "n", "length_m")


def tree_mean(values: Column) -> Column:
    """Mean by a tree of pairs, an odd last value carried: early values weigh more or less with the shape of the tree."""
    half = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.when(2 * i + 1 < F.size(a), (F.get(a, 2 * i) + F.get(a, 2 * i + 1)) / 2).otherwise(F.get(a, 2 * i)))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int"))
    return F.get(F.aggregate(levels, values, lambda acc, _: half(acc)), F.lit(0))


def _steps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(side, at, next, step, low, high) and (side, at, low, high, n), written: the least length of every edge; side 0 goes forward, side 1 back.

    low and high are the least and the greatest step that goes on from next, or from at, and n their number.
    """
    least = edges.groupBy("u", "v").agg(F.min(F.coalesce("len_m", F.lit(1.0))).cast("double").alias("step"))
    ways = [F.struct(F.lit(0).alias("side"), F.col("u").alias("at"), F.col("v").alias("next")), F.struct(F.lit(1).alias("side"), F.col("v").alias("at"), F.col("u").alias("next"))]
    plain = written(least.select(F.explode(F.array(*ways)).alias("e"), "step").select("e.*", "step"), "steps")
    around = written(plain.groupBy("side", "at").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.count("*").alias("n")), "around")
    steps = written(plain.join(around.select("side", F.col("at").alias("next"), "low", "high"), ["side", "next"], "left"), "steps")
    # edges of a node, about its third shortest, all edges together and four hundred shares of them by length
    shares, placed = [i / 400 for i in range(1, 400)], (F.col("step") > 0) & (F.col("step") < float("inf"))
    degree = around.agg(F.avg("n")).first()[0] or 1.0
    told = plain.where(placed & (F.col("side") == 0)).agg(F.percentile_approx("step", [min(0.9, 3 / degree), *shares]), F.sum("step")).first()
    around.lengths = (degree, told[0][0] if told[0] else None, told[1], told[0][1:] if told[0] else [])
    dropped(plain)
    return steps, around


#: So many sources of asked pairs are searched from at a time, so that what is kept between rounds does not grow with their number.
SOURCES = 24_000
#: Both radii grow at once while neither makes more rows than so many.
FEW_ROWS = 500_000
#: Ways of at most so many edges are walked back edge by edge.
WALKED = 8


def _in_parts(asked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (u, v) asked for, written, and the same in parts of about SOURCES sources."""
    pairs = written(asked.select("u", "v").where("u is not null and v is not null").distinct(), "asked")
    parts = max(1, -(-pairs.select("u").distinct().count() // SOURCES))
    return pairs, [pairs.where(F.pmod(F.xxhash64("u"), F.lit(parts)) == k) if parts > 1 else pairs for k in range(parts)]


def _search(steps: DataFrame, around: DataFrame, asked: DataFrame, hops: int | None, keep: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v, cost, meet) of the pairs, written, and with ``keep`` the labels of both searches, as tables (side, root, at, cost, before, hop).

    Every source is searched forward within a radius f and every target back within a radius b; labels up to these are exact.
    Labels below b give off the edges that end within f + b. A way of at most f + b has a last node within f, and
    what follows that is the target or below b, so the two meet there: such a pair is settled, and so is one of
    which either search has no edge that leads beyond its radius. Labels of roots without open pairs are put aside. The radius grows for
    which fewer rows are made, as told by how many labels and open pairs there are and how many edges are as short: with many pairs
    of each source that is the forward one, and only the last pairs are met from behind.
    With ``hops`` the radii have no end, and the two searches share that many rounds.
    """
    kind, far = dict(steps.dtypes)["at"], float("inf")
    degree, unit, longest, lengths = around.lengths
    endless = hops is not None or unit is None
    forth, behind, grows = (far, far, far) if endless else (0.0, 0.0, unit)
    edges_within = lambda r: max(1.0, degree * bisect.bisect_right(lengths, r) / len(lengths))
    nothing, same = F.lit(None).cast(kind), F.col("u") == F.col("v")
    pairs = written(asked.select("u", "v", F.when(same, 0.0).alias("cost"), F.when(same, F.col("u")).alias("meet"), (~same).alias("open")), "pairs")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("root")), F.struct(F.lit(1).alias("side"), F.col("v").alias("root"))))

    def roots() -> DataFrame:
        """side, root and room of open pairs: what a way must cost less than to be of use to one of them."""
        return pairs.where("open").select("cost", ends.alias("e")).groupBy("e.side", "e.root").agg(F.max(F.coalesce("cost", F.lit(far))).alias("room"))

    key = ["side", "root", "at"]
    labels = roots().select("side", "root", F.col("root").alias("at")).join(around.drop("n"), ["side", "at"], "left")
    # moved: how far the edges from a label have been followed
    labels = written(labels.select(*key, F.lit(0.0).alias("cost"), nothing.alias("before"), F.lit(0).alias("hop"), F.lit(-1.0).alias("moved"), "low", "high"), "labels")
    kept, done, n_open = [], 0, pairs.where("open").count()
    while n_open:
        start = done
        if forth + behind >= (longest or 0):
            forth = behind = far
        elif forth < far:
            sizes = labels.agg(F.count_if(F.col("side") == 0), F.count_if((F.col("side") == 1) & (F.col("hop") == 0)), F.count_if((F.col("side") == 1) & (F.col("cost") < behind)), F.count_if((F.col("side") == 1) & (F.col("cost") < behind + grows))).first()
            met = lambda n: n_open * max(1.0, n / max(1, sizes[1]) * edges_within(forth + behind + grows))  # noqa: B023, E731
            by_forward, by_back = sizes[0] * edges_within(grows) + met(sizes[2]), met(sizes[3])
            few = max(by_forward, by_back) <= FEW_ROWS
            forth, behind = forth + grows * (few or by_forward <= by_back), behind + grows * (few or by_forward > by_back)
        reach = F.when(F.col("side") == 0, F.lit(forth)).otherwise(F.lit(forth + behind))
        inside = (F.col("side") == 0) | (F.col("cost") < behind)
        waits = inside & (F.col("moved") < reach) & (F.col("cost") + F.col("low") <= reach)
        total = F.col("cost") + F.col("step")
        while hops is None or done < hops - hops // 2:
            turn = waits if hops is None or done < hops // 2 else waits & (F.col("side") == 0)
            front = labels.where(turn)
            if front.isEmpty():
                break
            ahead = front.join(roots(), ["side", "root"]).select(*key, "cost", "moved", "room").join(steps.where(F.col("step") <= forth + behind), ["side", "at"])
            ahead = ahead.where((total <= reach) & (total > F.col("moved")) & ((total < F.col("room")) | (F.col("room") == far)))
            ahead = ahead.groupBy("side", "root", F.col("next").alias("at")).agg(F.min(F.struct(total.alias("cost"), F.col("at").alias("before"))).alias("m"), F.max("low").alias("low1"), F.max("high").alias("high1"))
            both = labels.withColumn("moved", F.when(turn, reach).otherwise(F.col("moved"))).join(ahead, key, "full")
            better = F.col("cost").isNull() | F.coalesce(F.col("m.cost") < F.col("cost"), F.lit(False))
            pick = lambda new, old: F.when(better, new).otherwise(F.col(old)).alias(old)
            after = written(both.select(*key, pick(F.col("m.cost"), "cost"), pick(F.col("m.before"), "before"), pick(F.lit(done + 1), "hop"), pick(F.lit(-1.0), "moved"), pick(F.col("low1"), "low"), pick(F.col("high1"), "high")), "labels")
            dropped(labels)
            labels, done = after, done + 1
        # where the two searches of an open pair meet, if that is cheaper than what it has
        forward = labels.where("side = 0").select(F.col("root").alias("u"), "at", F.col("cost").alias("there"))
        back = labels.where("side = 1").select(F.col("root").alias("v"), "at", F.col("cost").alias("rest"))
        over = pairs.where("open").select("u", "v", F.col("cost").alias("most")).join(back, "v").where(F.col("rest") < F.coalesce("most", F.lit(far)))
        over = over.join(forward, ["u", "at"]).groupBy("u", "v").agg(F.min(F.struct((F.col("there") + F.col("rest")).alias("cost"), F.col("at").alias("meet"))).alias("m"))
        told = pairs.where("open").drop("open").join(over, ["u", "v"], "left")
        found = F.col("m.cost").isNotNull() & (F.col("cost").isNull() | (F.col("m.cost") < F.col("cost")))
        told = told.select("u", "v", *[F.when(found, F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in ("cost", "meet")])
        if hops is None and forth < far:
            leads = labels.where(F.col("cost") + F.col("high") > F.when(inside, reach).otherwise(-far)).select("side", "root").distinct()
            for side, end in enumerate(("u", "v")):
                told = told.join(leads.where(F.col("side") == side).select(F.col("root").alias(end), F.lit(True).alias(f"on_{end}")), end, "left")
            still = F.coalesce(F.col("on_u") & F.col("on_v"), F.lit(False)) & F.coalesce(F.col("cost") > forth + behind, F.lit(True))
        else:
            still = F.lit(False)
        now = written(pairs.where("not open").unionByName(told.select("u", "v", "cost", "meet", still.alias("open"))), "pairs")
        dropped(pairs)
        pairs, was_open = now, n_open
        n_open = pairs.where("open").count()
        if not n_open:
            break
        if n_open < was_open:
            live = roots().select("side", "root")
            if keep:
                kept.append(written(labels.join(live, ["side", "root"], "left_anti").select(*key, "cost", "before", "hop"), "settled"))
            after = written(labels.join(live, ["side", "root"], "left_semi"), "labels")
            dropped(labels)
            labels = after
        grows = grows * 2 if labels.where(F.col("hop") > start).isEmpty() else unit
    if keep:
        kept.append(written(labels.select(*key, "cost", "before", "hop"), "settled"))
    dropped(labels)
    return pairs.select("u", "v", "cost", "meet"), kept


def connectors(edges: DataFrame, asked: DataFrame, hops: int | None = None) -> DataFrame:
    """Cheapest length from u to v over directed edges (u, v, len_m), for pairs (u, v); of at most ``hops`` edges, if given.

    Searches from both ends (``_search``), short edges first, so a pair stops once its way is proven; an unreachable
    target ends with the smaller of the two searches, not with all that the source reaches.
    A round keeps its own tables only, and ``SOURCES`` sources are searched from at a time. Unreachable pairs have null; a node is 0 from itself.
    Missing edge lengths count as 1; lengths are not negative.
    """
    steps, around = _steps(edges)
    pairs, parts = _in_parts(asked)
    told = [_search(steps, around, part, hops, False)[0] for part in parts]
    dropped(steps, around, pairs)
    return functools.reduce(DataFrame.unionByName, told).select("u", "v", F.col("cost").alias("length_m"))


def walked_back(met: DataFrame, labels: DataFrame) -> DataFrame:
    """u, v and the nodes of the way of every pair (u, v, meet), from labels (side, root, at, before, hop), which are written tables' union.

    From the node where the two searches meet, labels tell the nodes back to either end, for all pairs at once: edge by edge where
    no half has over WALKED, else by pointer doubling, in as many rounds as the logarithm of the longest half.
    The result still reads what is written here.
    """
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("root")), F.struct(F.lit(1).alias("side"), F.col("v").alias("root"))))
    marks = written(met.select("u", "v", "meet", both.alias("e")).select("u", "v", "meet", "e.*", F.col("meet").alias("at")), "marks")
    longest, key = labels.agg(F.max("hop")).first()[0] or 0, ["side", "root", "at"]
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("side", "place", "at"))), lambda x: x["at"])
    place = F.when(F.col("side") == 0, F.col("hop")).otherwise(-F.col("hop")).alias("place")
    if longest <= WALKED:
        front, walked = marks, []
        for _ in range(longest + 1):
            walked.append(written(front.join(labels.select(*key, "hop", "before"), key).select("u", "v", "meet", *key, place, "before"), "walked"))
            front = walked[-1].where("before is not null").select("u", "v", "meet", "side", "root", F.col("before").alias("at"))
            if front.isEmpty():
                break
        dropped(marks)
        placed = functools.reduce(DataFrame.unionByName, walked).where("side = 0 or at <> meet")  # the meeting node stands in both halves
        out = placed.groupBy("u", "v").agg(nodes.alias("nodes"))
        out.reads = tuple(walked)
        return out
    hops = written(labels.select("side", "root", "at", "hop"), "hops")
    jumps = written(labels.where("before is not null").select("side", "root", "at", F.col("before").alias("to")), "jumps")
    for k in range(longest.bit_length()):
        more = marks.join(jumps, key).select("u", "v", "meet", "side", "root", F.col("to").alias("at"))
        marks, was = written(marks.unionByName(more), "marks"), [marks]
        if k + 1 < longest.bit_length():
            far = jumps.select("side", "root", F.col("at").alias("to"), F.col("to").alias("beyond"))
            was, jumps = [*was, jumps], written(jumps.join(far, ["side", "root", "to"]).select(*key, F.col("beyond").alias("to")), "jumps")
        dropped(*was)
    placed = marks.join(hops, key).withColumn("place", place).where("side = 0 or at <> meet")  # the meeting node stands in both halves
    out = placed.groupBy("u", "v").agg(nodes.alias("nodes"))
    out.reads = (marks, hops, jumps)
    return out


def connector_nodes(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """u, v, length_m and the nodes of one cheapest path (``walked_back``), ends included; an empty array if v is unreachable."""
    kind = dict(edges.dtypes)["u"]
    alone = F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array().cast(f"array<{kind}>"))
    steps, around = _steps(edges)
    asked, parts = _in_parts(asked)
    told = []
    for part in parts:  # a part's labels are let go once its ways are told
        pairs, kept = _search(steps, around, part, None, True)
        labels = functools.reduce(DataFrame.unionByName, [x.select("side", "root", "at", "before", "hop") for x in kept])
        paths = walked_back(pairs.where("meet is not null and u <> v"), labels)
        told.append(written(pairs.join(paths, ["u", "v"], "left").select("u", "v", F.col("cost").alias("length_m"), F.coalesce("nodes", alone).alias("nodes")), "ways"))
        dropped(*kept, *paths.reads)
    dropped(steps, around, asked)
    return functools.reduce(DataFrame.unionByName, told)


def spliced(chunks: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """ride_id, pos, node_id, kind, chunk, step_m of ONE route per ride: matched chunks in order, joined where they overlap and by cheapest ways where not.

    chunks: ride_id, chunk, nodes; a chunk without nodes is a gap that the way between its
    neighbours fills. A chunk loses its largest overlap (<= ``most``) with the one before;
    where there is none, the inner nodes of the cheapest way over ``edges`` come between (kind
    connector). Where no way exists the route goes on with kind open. step_m is the least
    length of the edge from the node before: 0 at the first node, at an open seam and where a node
    repeats, null where there is no such edge. Rides without a matched chunk have no rows.
    """
    w = Window.partitionBy("ride_id").orderBy("chunk")
    rows = chunks.where("size(nodes) > 0").withColumn("before", F.lag("nodes").over(w))
    rows = written(rows.withColumn("k", F.when(F.col("before").isNotNull(), overlap(F.col("before"), F.col("nodes"), most)).otherwise(0)).select("ride_id", "chunk", "nodes", "k", F.element_at("before", -1).alias("u"), F.element_at("nodes", 1).alias("v")), "chunks")
    seam = F.col("u").isNotNull() & (F.col("k") == 0)
    ways = connector_nodes(edges, rows.where(seam).select("u", "v")).withColumnRenamed("nodes", "way")
    rows = rows.join(ways, ["u", "v"], "left")
    found = seam & (F.size("way") > 0)
    inner = F.when(found & (F.size("way") > 2), F.slice("way", F.lit(2), F.greatest(F.size("way") - 2, F.lit(1))))
    told = lambda c, kind: F.transform(c, lambda x, i: F.struct(x.alias("node_id"), kind(i).alias("kind")))
    own = F.slice("nodes", F.col("k") + 1, F.size("nodes"))
    parts = F.concat(F.coalesce(told(inner, lambda i: F.lit("connector")), told(F.slice("nodes", F.lit(1), F.lit(0)), lambda i: F.lit(""))), told(own, lambda i: F.when((i == 0) & seam & ~found, "open").otherwise("chunk")))
    flat = rows.select("ride_id", "chunk", F.posexplode(parts).alias("i", "p")).select("ride_id", "chunk", "i", "p.*")
    order = Window.partitionBy("ride_id").orderBy("chunk", "i")
    flat = flat.withColumns({"pos": F.row_number().over(order).cast("long") - 1, "u": F.lag("node_id").over(order)})
    least = edges.groupBy("u", F.col("v").alias("node_id")).agg(F.min(F.coalesce("len_m", F.lit(1.0))).alias("len"))
    still = F.col("u").isNull() | (F.col("kind") == "open") | (F.col("u") == F.col("node_id"))
    return flat.join(least, ["u", "node_id"], "left").select("ride_id", "pos", "node_id", "kind", "chunk", F.when(still, 0.0).otherwise(F.col("len")).alias("step_m"))


def spliced_totals(route: DataFrame) -> DataFrame:
    """ride_id, n_nodes, n_filled, open_seams, missing_steps, length_m of routes of ``spliced``."""
    kind = F.col("kind")
    return route.groupBy("ride_id").agg(F.count("*").alias("n_nodes"), F.count_if(kind == "connector").alias("n_filled"), F.count_if(kind == "open").alias("open_seams"), F.count_if(F.col("step_m").isNull()).alias("missing_steps"), F.sum("step_m").alias("length_m"))


def stitched(chunks: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """ride_id, chunk, u, v, length_m: a connector leg for each seam without an overlap, from the last node before it to the first one after."""
    seams = chunks.withColumn("before", F.lag("nodes").over(Window.partitionBy("ride_id").orderBy("chunk"))).where("before is not null")
    seams = seams.where(overlap(F.col("before"), F.col("nodes"), most) == 0)
    seams = written(seams.select("ride_id", "chunk", F.element_at("before", -1).alias("u"), F.element_at("nodes", 1).alias("v")), "seams")
    return seams.join(connectors(edges, seams.select("u", "v")), ["u", "v"], "left").select("ride_id", "chunk", "u", "v", "length_m")


def _met(routes_: DataFrame, known: DataFrame) -> DataFrame:
    """ride_id, position, key, ways: stretches of routes (ride_id, route) that have the length and the hash of a known sequence."""
    told = known.where("size(ways) > 0").withColumns({"n": F.size("ways"), "h": F.xxhash64("ways")})
    lengths = told.select("n").distinct()
    stretches = F.transform(F.sequence(F.lit(0), F.size("route") - F.col("n")), lambda i: F.struct(i.cast("long").alias("position"), F.xxhash64(F.slice("route", i + 1, F.col("n"))).alias("h")))
    cuts = routes_.crossJoin(F.broadcast(lengths)).where(F.size("route") >= F.col("n")).select("ride_id", "n", F.explode(stretches).alias("s")).select("ride_id", "n", "s.*")
    return cuts.join(told, ["n", "h"]).select("ride_id", "position", "key", "ways")


def known_along(steps: DataFrame, known: DataFrame) -> DataFrame:
    """ride_id, position, key: where a known sequence of ways stands in a route; steps: ride_id, pos (from 0), way; known: key, ways.

    Every stretch of a route of a length that a known sequence has meets those of its hash, and only what meets is
    compared whole. So a step has one narrow row for each length, however many sequences begin alike.
    """
    ways = F.transform(F.array_sort(F.collect_list(F.struct("pos", "way"))), lambda x: x["way"])
    routes_ = steps.groupBy("ride_id").agg(ways.cast(dict(known.dtypes)["ways"]).alias("route"))
    whole = F.slice("route", (F.col("position") + 1).cast("int"), F.size("ways")) == F.col("ways")
    return _met(routes_, known).join(routes_, "ride_id").where(whole).select("ride_id", "position", "key")


def polyline(points: Column, digits: int = 5) -> Column:
    """Encoded polyline of an array of structs (lat, lon): zigzag deltas in groups of five bits, all in built-in functions."""
    scale = 10.0**digits
    whole = lambda p: F.struct(F.round(p["lat"] * scale).cast("long").alias("a"), F.round(p["lon"] * scale).cast("long").alias("b"))
    state = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        w = whole(p)
        return F.struct(w["a"].alias("a"), w["b"].alias("b"), F.concat(acc["out"], F.array(w["a"] - acc["a"], w["b"] - acc["b"])).alias("out"))

    deltas = F.aggregate(points, state, step, lambda acc: acc["out"])

    def letters(v: Column) -> Column:
        z = F.when(v < 0, -2 * v - 1).otherwise(2 * v)
        group = lambda i: F.floor(z / F.pow(F.lit(32.0), i)).cast("long")
        return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: (i == 0) | (group(i) > 0)), lambda i: F.char(group(i) % 32 + F.when(group(i + 1) > 0, 32).otherwise(0) + 63)), "")

    return F.array_join(F.transform(deltas, letters), "")


def decode_polyline(text: Column, digits: int = 5) -> Column:
    """Array of (lat, lon) of an encoded polyline, null for null; inverse of ``polyline`` up to rounding.

    One fold over the letters holds the running latitude and longitude, so no sum is taken twice.
    """
    zero = F.lit(0).cast("long")
    point = "struct<lat:double,lon:double>"
    state = F.struct(zero.alias("value"), F.lit(1).cast("long").alias("weight"), zero.alias("lat"), zero.alias("lon"), F.lit(False).alias("half"), F.array().cast(f"array<{point}>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        b = F.ascii(c) - 63
        value = acc["value"] + (b % 32) * acc["weight"]
        delta = F.when(value % 2 == 1, (-(value + 1) / 2).cast("long")).otherwise((value / 2).cast("long"))
        more = b >= 32
        lat = F.when(more | acc["half"], acc["lat"]).otherwise(acc["lat"] + delta)
        lon = F.when(~more & acc["half"], acc["lon"] + delta).otherwise(acc["lon"])
        done = F.struct((lat / 10.0**digits).alias("lat"), (lon / 10.0**digits).alias("lon")).cast(point)
        return F.struct(
            F.when(more, value).otherwise(0).cast("long").alias("value"), F.when(more, acc["weight"] * 32).otherwise(1).cast("long").alias("weight"), lat.cast("long").alias("lat"), lon.cast("long").alias("lon"),
            (more & acc["half"] | ~more & ~acc["half"]).alias("half"), F.when(~more & acc["half"], F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(text.isNotNull(), F.aggregate(F.split(text, ""), state, step, lambda acc: acc["out"]))
