"""N-gram Jaccard join: a MinHash LSH forest of prefix tries, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.llm.common import HOT_ROWS, Polynomial, dropped, key_of, mixed, splitmix, spread_join, with_nulls, written
from rideframe.llm.graph import components

#: Tries, and levels of each: a signature is a long whose bytes are the levels, so tries are sorted by number and a prefix is a shift.
TREES, DEPTH = 32, 8
#: The shortest prefix, against which recall is measured: it loses one pair in 20 million at similarity 0.8.
FLOOR = 4
#: Recall is measured with every document whose id is divisible by this as a query, and with so many invented near copies of each.
QUERY_STEP, COPIES = 20, 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Shingles:
    """Sets of n-word shingles as sorted 64-bit fingerprints."""

    def __init__(self, n: int):
        self.n, self.poly = n, Polynomial(11)
        self.weights = splitmix(n, 23) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.r_[False, ~_SPACE[data], False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        words = mixed(self.poly.ranges(self.poly.sums(data), start, end) + (end - start).astype(np.uint64))
        n = min(self.n, len(words))  # a shorter text is one shingle of all its words
        out = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):
            out += words[i : len(words) - n + 1 + i] * self.weights[i]
        return np.unique(mixed(out))


class Forest:
    """MinHash signatures, one per trie: DEPTH levels of one byte each, the first level in the highest byte."""

    def __init__(self, trees: int = TREES):
        self.trees = trees
        self.flip = splitmix(trees * DEPTH, 101)
        self.scale = splitmix(trees * DEPTH, 102) | np.uint64(1)
        self.place = np.uint64(1) << (np.uint64(8) * np.arange(DEPTH - 1, -1, -1, dtype=np.uint64))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.trees * DEPTH, np.uint64(2**64 - 1))
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            for j in range(0, len(least), 16):
                x = (part[None, :] ^ self.flip[j : j + 16, None]) * self.scale[j : j + 16, None]
                least[j : j + 16] = np.minimum(least[j : j + 16], x.min(axis=1))
        level = mixed(least).reshape(self.trees, DEPTH) >> np.uint64(56)
        return (level * self.place).sum(axis=1, dtype=np.uint64)

    def _hashed(self, x: np.ndarray, j: int) -> np.ndarray:
        return (x ^ self.flip[j]) * self.scale[j]

    def planted(self, shingles: np.ndarray, threshold: float, copies: int = COPIES) -> np.ndarray:
        """Invented near copies of a set, counted by the longest prefix that they share with it in some trie: DEPTH + 1 numbers.

        A copy loses and gains as many shingles as the threshold allows, so it is as hard to
        find as a link can be. A level is shared if its least shingle stays and no new one is
        less. The choice depends on the set alone. Sets that can have no other within the
        threshold (below 0.8: of three shingles or fewer) get no copies.
        """
        n = len(shingles)
        lost = int(n * (1 - threshold) / (1 + threshold) + 1e-9)
        new = lost + int((n - lost) / (n + lost + 1) >= threshold - 1e-9)
        if not new:
            return np.zeros(DEPTH + 1, np.int64)
        levels = self.trees * DEPTH
        at, least = np.empty(levels, np.int64), np.empty(levels, np.uint64)
        for j in range(levels):
            x = self._hashed(shingles, j)
            at[j] = x.argmin()
            least[j] = x[at[j]]
        seeds = mixed(splitmix(copies, 211) ^ shingles[0])
        stays = np.ones((copies, levels), bool)
        for c, seed in enumerate(seeds):
            order = mixed(shingles ^ seed)
            if lost:
                stays[c] = order[at] > np.partition(order, lost - 1)[lost - 1]
        for begin in range(0, new, 512):
            fresh = mixed(seeds[:, None] + np.arange(begin + 1, min(begin + 512, new) + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
            for j in range(levels):
                stays[:, j] &= self._hashed(fresh, j).min(axis=1) > least[j]
        shared = np.cumprod(stays.reshape(copies, self.trees, DEPTH), axis=2).sum(axis=2).max(axis=1)
        return np.bincount(shared, minlength=DEPTH + 1)


def _signed(n: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, forest = Shingles(n), Forest()
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                    s = shingles(text)
                    if not len(s):
                        rows.append((doc_id, key, 0, 0, 0, None, None))
                        continue
                    a, b = (mixed(s * k + np.uint64(1)).sum(dtype=np.uint64) for k in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)))
                    planted = forest.planted(s, threshold) if doc_id % QUERY_STEP == 0 else None
                    rows.append((doc_id, key, len(s), a.astype(np.int64), b.astype(np.int64), forest(s).astype(np.int64), planted))
                yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n", "set_a", "set_b", "signature", "planted"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(n)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for rep, query, signature, text, met in zip(batch["rep"], batch["query"], batch["signature"], batch["text"], batch["met"]):
                    nodes, homes, at = np.zeros(TREES, np.int64), np.zeros(TREES, np.int64), {}
                    for m in met:
                        nodes[m["tree"]], homes[m["tree"]] = m["node"], m["home"]
                        at[m["home"]] = max(m["blocks"], at.get(m["home"], 1))
                    rows.append((rep, query, np.asarray(signature, np.int64).tobytes(), nodes.tobytes(), homes.tobytes(), shingles(text).tobytes(), [{"home": h, "blocks": b} for h, b in at.items()]))
                yield pd.DataFrame(rows, columns=["rep", "query", "signature", "nodes", "homes", "shingles", "at"])

    return run


def similar_pairs(sets: list[np.ndarray], first: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of Jaccard similarity at or above the threshold, counted exactly, in strips.

    Pairs among the ``first`` sets are for i, j < first; if first < len(sets), only pairs
    across that border are given.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    if not lengths.sum():
        return
    ids, where, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = seen[where] > 1  # others are in no intersection
    where, owner = where[shared], owner[shared]
    across = first < len(sets)
    # a row list for each shared shingle, its members in ascending order
    order = np.argsort(where, kind="stable")
    members = owner[order]
    begins = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.bincount(where, minlength=len(ids)), out=begins[1:])
    mine = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(sets)), out=mine[1:])
    for i in range(first):
        own = where[mine[i] : mine[i + 1]]
        if not len(own):
            continue
        a, b = begins[own], begins[own + 1]
        take = np.arange((b - a).sum()) + np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a)
        common = np.bincount(members[take], minlength=len(sets))
        common[: first if across else i + 1] = 0
        j = np.flatnonzero(common)
        c = common[j]
        j = j[c >= threshold * (lengths[i] + lengths[j] - c) - 1e-9]
        if len(j):
            yield np.full(len(j), i), j


def _prefixes(signatures: np.ndarray) -> np.ndarray:
    """Levels that two signatures share from the first on, given their exclusive or."""
    out = np.zeros(signatures.shape, np.int64)
    for level in range(1, DEPTH + 1):
        out += (signatures >> np.uint64(8 * (DEPTH - level))) == 0
    return out


def _verify(threshold: float, queries_only: bool):
    """Links of one group of sets: (a, b, links, depth, n), the spanning forest and link counts, or with ``queries_only`` the deepest prefix of each link of a query, counted."""
    columns = ["a", "b", "links", "depth", "times"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "side"]).sort_values(["side", "rep"], ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        first = int((rows["side"] == 0).sum()) if key[1] != key[2] else len(sets)
        nodes = np.array([np.frombuffer(x, np.int64) for x in rows["nodes"]]).reshape(len(rows), -1)
        homes = np.array([np.frombuffer(x, np.int64) for x in rows["homes"]]).reshape(len(rows), -1)
        signatures = np.array([np.frombuffer(x, np.uint64) for x in rows["signature"]]).reshape(len(rows), -1)
        query = rows["query"].to_numpy(bool)
        root, links, depths = np.arange(len(sets)), np.zeros(len(sets), np.int64), np.zeros(DEPTH + 1, np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, js in similar_pairs(sets, first, threshold):
            i = int(i[0])
            # a pair that meets in several tries is counted in the group of the least of its nodes only
            met = (nodes[i] == nodes[js]) & (nodes[i] != 0)
            least = np.where(met, nodes[i], np.iinfo(np.int64).max).argmin(axis=1)
            js = js[met.any(axis=1) & (homes[i][least] == key[0])]
            if queries_only:
                js = js[query[js] | query[i]]
                depths += np.bincount(_prefixes(signatures[i] ^ signatures[js]).max(axis=1), minlength=DEPTH + 1) if len(js) else 0
                continue
            links[i] += len(js)
            links[js] += 1
            for j in js:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
        if queries_only:
            return pd.DataFrame([(0, 0, 0, d, n) for d, n in enumerate(depths) if n], columns=columns)
        ids = rows["rep"].to_numpy()
        out = pd.DataFrame({"a": ids, "b": ids[[find(x) for x in range(len(sets))]], "links": links, "depth": 0, "times": 0})
        return out[out["links"] > 0]

    return run


_LINK = "a long, b long, links long, depth int, times long"


class _Join:
    """Distinct sets with their signatures, and how those that meet in the forest are verified."""

    def __init__(self, narrow: DataFrame, reps: DataFrame, threshold: float, n: int, block_rows: int, block_shingles: int):
        self.narrow, self.reps, self.threshold, self.n = narrow, reps, threshold, n
        self.block_rows, self.block_shingles = block_rows, block_shingles

    def verified(self, depth: int, queries_only: bool = False) -> DataFrame:
        """Links of the sets that share a prefix of ``depth`` levels in some trie; ``queries_only``: counts of the links of queries.

        A trie node is named by its members, so that nodes of equal members in several tries
        are one. A set goes to every node that it shares with another, and nodes to groups:
        small ones by hash, many in a group, large ones in blocks of their own that meet
        pairwise. No closure of candidates is formed: what verifies is what meets in a node.
        """
        tries = self.reps.select("rep", "size", "query", F.posexplode("signature").alias("tree", "s")).withColumn("prefix", F.shiftrightunsigned("s", 8 * (DEPTH - depth)))
        named = F.xxhash64(F.count("*"), F.bit_xor("rep"), F.bit_xor(F.xxhash64("rep", F.lit(7))))
        asked = "n > 1 and asked" if queries_only else "n > 1"
        nodes = tries.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.some("query").alias("asked"), named.alias("node")).where(asked)
        blocks = F.ceil(F.greatest(F.col("n") / self.block_rows, F.col("weight") / self.block_shingles)).cast("long")
        nodes = written(nodes.select(F.xxhash64("tree", "prefix").alias("at"), "node", "n", "weight", blocks.alias("blocks")), "nodes")
        total = nodes.select("node", "weight").distinct().agg(F.sum("weight")).first()[0] or 0
        bins = int(4 * total // self.block_shingles) + 1
        home = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("node"), F.lit(bins))).otherwise(F.col("node").bitwiseOR(F.lit(-(1 << 63))))  # large nodes: below 0
        # nodes of many sets, 2000 at most, meet theirs by broadcast
        hot = max(HOT_ROWS, TREES * self.reps.count() // 2000)
        told = nodes.select("at", "n", "node", "blocks", home.alias("home"))
        many, few = F.broadcast(told.where(F.col("n") >= hot)), told.where(F.col("n") < hot)
        keyed = tries.select("rep", F.col("tree").cast("int").alias("tree"), F.xxhash64("tree", "prefix").alias("at"))
        met = keyed.join(many, "at").unionByName(keyed.join(many.select("at"), "at", "left_anti").join(few, "at"))
        placed = met.groupBy("rep").agg(F.collect_list(F.struct("tree", "node", "home", "blocks")).alias("met"))  # TREES at most
        placed = self.reps.select("rep", "query", "signature", "src").join(placed, "rep").select("rep", "query", "signature", "src.doc_id", "src.text_key", "met")
        texts = self.narrow.join(placed, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        sets = texts.mapInPandas(_sets(self.n), "rep long, query boolean, signature binary, nodes binary, homes binary, shingles binary, at array<struct<home:long,blocks:long>>")
        sets = sets.select("rep", "query", "signature", "nodes", "homes", "shingles", F.explode("at").alias("at")).select("*", "at.home", "at.blocks").drop("at")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
        dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select("rep", "query", "signature", "nodes", "homes", "shingles", "home", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
        out = written(dealt.groupBy("home", "x", "y").applyInPandas(_verify(self.threshold, queries_only), _LINK), "verified")
        dropped(nodes)
        return out

    def query_links(self) -> dict[int, int]:
        """Links of the queries that prefixes of FLOOR levels find, by the longest prefix that they share."""
        found = self.verified(FLOOR, True)
        out = {r["depth"]: r["n"] for r in found.groupBy("depth").agg(F.sum("times").alias("n")).collect()}
        dropped(found)
        return out


def planted_links(filled: DataFrame) -> dict[int, int]:
    """Invented links of the queries by the longest prefix that they share; a set counts once however many rows have it."""
    once = filled.where("planted is not null").groupBy("rep").agg(F.first("planted").alias("planted"))
    return {r["depth"]: r["n"] for r in once.select(F.posexplode("planted").alias("depth", "n")).groupBy("depth").agg(F.sum("n").alias("n")).collect()}


def missed_share(depth: int, threshold: float, links: dict[int, int], weight: float) -> float:
    """Share of links that prefixes of ``depth`` levels miss: measured links, and ``weight`` more at the threshold that miss as chance has it."""
    chance = (1 - threshold**depth) ** TREES
    return (sum(n for d, n in links.items() if d < depth) + weight * chance) / (sum(links.values()) + weight)


def chosen_depth(threshold: float, target: float, *measured: dict[int, int]) -> int:
    """Shorten the prefix from all levels until each table of measured links is found to the target share.

    Few links prove little, so each table is joined by as many links of chance as one miss in
    them would be within the target: without links chance decides, with many the measure.
    """
    weight = 1 / max(1 - target, 1e-9)
    depth = DEPTH
    while depth > FLOOR and any(missed_share(depth, threshold, links, weight) > 1 - target for links in measured or ({},)):
        depth -= 1
    return depth


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, target: float = 0.9999, block_rows: int = 2000, block_shingles: int = 2_000_000) -> DataFrame:
    """Similarity classes of all documents; one row per input row.

    doc_id, class_id, n_links, n_copies, text_key, class_key. Two documents are linked if the
    Jaccard similarity of their sets of n-word shingles is at or above the threshold; a class
    is a connected component, named by its least doc_id. n_copies counts the other rows of an
    equal set, n_links the linked different sets. text_key tells rows of one id apart, and
    (class_id, class_key) is the row that stands for the class.

    Equal sets are one representative. Its signatures stand in TREES tries. The prefix by
    which representatives meet is shortened from DEPTH levels until a fixed query set (ids
    divisible by QUERY_STEP) finds the share ``target`` both of its links among all rows and
    of COPIES invented near copies of each query, which lie at the threshold. What meets in a node is verified exactly, in groups of about ``block_shingles``
    shingles (large nodes: ``block_rows`` sets a block), from which only counts and a spanning
    forest leave.

    A text of fewer than n words is one shingle; null, empty and wordless texts are in
    classes of their own, with no links. Rows that repeat an id and differ in text, and rows
    without an id, are documents of their own. An empty table gives an empty result; a very
    long text is one set, in one task.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(key_of().alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = written(narrow.mapInPandas(_signed(n, threshold), "doc_id long, text_key long, n int, set_a long, set_b long, signature array<long>, planted array<long>"), "forest")
    filled = signed.where("n > 0").withColumn("rep", F.xxhash64("set_a", "set_b", "n"))
    source = F.min(F.struct("doc_id", "text_key")).alias("src")
    reps = filled.groupBy("rep").agg(source, F.count("*").alias("copies"), F.first("n").alias("size"), F.first("signature").alias("signature"))  # equal sets, equal signatures
    reps = written(reps.withColumn("query", F.pmod(F.col("src.doc_id"), F.lit(QUERY_STEP)) == 0), "sets")
    join = _Join(narrow, reps, threshold, n, block_rows, block_shingles)
    found = join.verified(chosen_depth(threshold, target, planted_links(filled), join.query_links()))
    classes = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = reps.select("rep", "src", "copies").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = written(named.select("rep", "src", "copies", F.coalesce("class_id", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    dropped(reps, found)
    least = named.groupBy("class").agg(F.min("src").alias("least"))
    classed = written(spread_join(named, least, "class", "inner").select("rep", "least", "copies", "links"), "classes")
    dropped(named)
    out = spread_join(written(filled.select("doc_id", "text_key", "rep"), "members"), classed, "rep", "inner")
    out = out.select("doc_id", F.col("least.doc_id").alias("class_id"), F.col("links").alias("n_links"), (F.col("copies") - 1).alias("n_copies"), "text_key", F.col("least.text_key").alias("class_key"))
    none = F.lit(0).cast("long")
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies"), "text_key", F.col("text_key").alias("class_key"))
    return with_nulls(out.unionByName(alone), "doc_id", "class_id")
