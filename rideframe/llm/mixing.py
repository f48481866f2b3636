"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import key_of, with_nulls, word_count, written

_LEFT = "source string, block long, id long, tie long, size long, copies long, part double"


def source_targets(sizes: DataFrame, weights: list[float], total_share: float, cap: float) -> DataFrame:
    """Water-filling: targets in proportion to weights, none above ``cap`` times its source.

    ``sizes``: one row per source with source and source_size. Sources weigh ``weights`` in
    turn by code point order, null last. The capped sources are those of the smallest cap per
    weight, so the common level comes from running sums, without a loop. Source ranks take one
    task, over one row a source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns(
        {
            "level": (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("most").over(earlier), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        }
    )
    # with the sources before it capped, a source that reaches the level is free, and so are all after it
    level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return s.select("source", "source_size", F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level)).alias("target"))


def pivotal(sizes: np.ndarray, parts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``parts`` (0 to 1), keeping the sum of sizes * parts and every expectation.

    Pairs pass mass until one of them is integral; at most one stays fractional, whose index
    comes back (-1: none).
    """
    out, open_ = parts.copy(), -1
    draws = rng.random(len(parts))
    for j in np.flatnonzero((parts > 0) & (parts < 1)):
        if open_ < 0:
            open_ = j
            continue
        i, si, sj = open_, sizes[open_], sizes[j]
        up_i, down_j, down_i, up_j = si * (1 - out[i]), sj * out[j], si * out[i], sj * (1 - out[j])
        a, b = min(up_i, down_j), min(down_i, up_j)
        if draws[j] * (a + b) < b:  # i gains
            if up_i <= down_j:
                out[i], out[j], open_ = 1.0, (0.0 if up_i == down_j else out[j] - a / sj), j
            else:
                out[i], out[j], open_ = out[i] + a / si, 0.0, i
        elif down_i <= up_j:
            out[i], out[j], open_ = 0.0, (1.0 if down_i == up_j else out[j] + b / sj), j
        else:
            out[i], out[j], open_ = out[i] - b / si, 1.0, i
        if not 0 < out[open_] < 1:
            open_ = -1
    return out, int(open_)


def _round_block(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tie", "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{key[1]}|{key[0]!r}".encode("utf-8", "surrogatepass")))
        part, open_ = pivotal(rows["size"].to_numpy(float), rows["part"].to_numpy(float), rng)
        done = np.ones(len(rows), bool)
        if open_ >= 0:
            done[open_] = False
        rows["copies"] += np.where(done, np.round(part), 0).astype("int64")
        rows["part"] = np.where(done, 0.0, part)
        return rows

    return run


def _last(seed: int):
    """Round what is left of each source by its own expectation."""
    return F.when(F.col("part") > F.pmod(F.xxhash64("id", "tie", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30), 1).otherwise(0)


def mix_sources(docs: DataFrame, id_column: str = "doc_id", weights: list[float] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0, seed: int = 7, block_rows: int = 10_000, fan_in: int = 256) -> DataFrame:
    """Copies of every document, so that each source's words meet its target.

    One row per input row: id column, tie, source, size, source_size, target, copies, taken.
    A document's expected copies are target / source_size; the whole part is taken, the rest
    is rounded by ``pivotal`` in blocks of about ``block_rows`` rows of one source (a hot
    source has many), and the at most one open document of each block is rounded again with
    those of ``fan_in`` other blocks, level by level, until a source has one, which is rounded
    alone. So a source misses its target by less than one document, most of which ``_settle``
    takes back. Draws depend on ids and
    seed only: reruns agree. Null and wordless texts have size 0 and take nothing; null
    sources are one source; rows that repeat are documents of their own. An empty table gives
    an empty result; very long texts are counted whole.
    """
    base = docs.select(key_of(id_column).alias("id"), F.xxhash64("text").alias("tie"), F.col("source").cast("string").alias("source"), word_count(F.coalesce("text", F.lit(""))).alias("size"))
    base = written(base, "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = written(sizes, "sources")
    targets = written(source_targets(sizes.select("source", "source_size"), list(weights), total_share, cap).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    small = F.broadcast(targets) if targets.limit(20_001).count() <= 20_000 else targets
    rows = base.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(want + 1e-12).cast("long")
    rows = rows.select("source", F.pmod(F.xxhash64("id", "tie", F.lit(seed)), F.ceil(F.col("n") / block_rows)).cast("long").alias("block"), "id", "tie", "size", F.when(F.col("size") > 0, whole).otherwise(0).alias("copies"), F.when((F.col("size") > 0) & (want - whole > 1e-9), want - whole).otherwise(0.0).alias("part"))
    most = (targets.agg(F.max(F.ceil(F.col("n") / block_rows))).first()[0]) or 1
    settled, level = [], 0
    while True:
        rows = written(rows.groupBy("source", "block").applyInPandas(_round_block(seed, level), _LEFT), f"mix{level}")
        if most <= 1:
            break
        settled.append(rows.where("part = 0"))
        rows, most, level = rows.where("part > 0").withColumn("block", F.floor(F.col("block") / fan_in).cast("long")), -(-most // fan_in), level + 1
    out = rows.withColumn("copies", F.col("copies") + _last(seed))
    for x in settled:
        out = out.unionByName(x)
    out = _settle(written(out.select("source", "id", "tie", "size", "copies"), "rounded"), small, seed)
    return with_nulls(out, "id").select(F.col("id").alias(id_column), "tie", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _settle(rounded: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Take back what the last document of each source missed its target by.

    Smaller documents of the source that were rounded the way of the error are rounded the
    other way, in hash order up to the size of the error. About as many as make up twice the
    error are looked at; each keeps floor or ceiling of its expected copies.
    """
    rows = rounded.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    missed = rows.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.max("target")).alias("over"))
    missed = written(missed, "missed")

    def with_table(df: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("source", "s")
        if table.limit(20_001).count() <= 20_000:
            table = F.broadcast(table)
        return df.join(table, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(want + 1e-12).cast("long")
    split = (F.col("size") > 0) & (want - whole > 1e-9) & (F.col("size") <= F.abs("over"))
    way = F.when(split & (F.col("over") > 0) & (F.col("copies") > whole), -1).when(split & (F.col("over") < 0) & (F.col("copies") == whole), 1).otherwise(0)
    rows = with_table(rows, missed).withColumn("way", way).withColumn("h", F.pmod(F.xxhash64("id", "tie", F.lit(seed + 1)), F.lit(1 << 40)))
    able = rows.where("way <> 0")
    mass = written(able.groupBy("source").agg(F.sum("size").alias("mass")), "mass")
    few = with_table(able, mass).where(F.col("h") < 2 * F.abs("over") / F.col("mass") * float(1 << 40))
    upto = few.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("h"))).where(F.col("upto") <= F.abs("over"))
    last = written(upto.groupBy("source").agg(F.max("h").alias("last")), "settled")
    return with_table(rows, last).withColumn("copies", F.col("copies") + F.when(F.col("h") <= F.col("last"), F.col("way")).otherwise(0))
