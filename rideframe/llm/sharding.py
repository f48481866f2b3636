"""Sharding by a permutation-filled lookup table, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of the shard's permutation of the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot: shards take turns, each claiming its next free slot by preference."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("there must be one to `slots` shards, all different")
    owner = [-1] * slots
    at, skips = map(list, zip(*[preference(x, slots) for x in shards]))
    for claimed in range(slots):
        i = claimed % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + skips[i]) % slots
        owner[at[i]] = i
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard); ``slots`` rows, whatever the data."""
    names = F.array(*[F.lit(x) for x in shards])
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key by the first 32 bits of its MD5; a null key is placed as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(rows: DataFrame, key: str, shards: list[str], slots: int = 8191) -> DataFrame:
    """``rows`` with slot and shard columns (those of the same name are replaced); one row per input row.

    The table is broadcast: it has ``slots`` rows, a parameter. A row's place depends on its
    key alone, so equal keys go together, and a changed list of shards moves few others. A null
    key has a place of its own; an empty table gives an empty result, whatever other columns it has.
    """
    kept = [c for c in rows.columns if c.lower() not in ("slot", "shard")]
    table = lookup_table(rows.sparkSession, shards, slots)
    return rows.select(*kept).withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*kept, "slot", "shard")
