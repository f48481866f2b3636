"""Helpers that the text operators share: shared-storage tables, size-checked joins, word and hash kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideframe.storage import dropped, written  # noqa: F401  (used through this module)

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a lookup table that is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Fewest rows of a name that is joined by broadcast instead of a shuffle.
HOT_ROWS = 1000
#: Stands for a null id inside the operators; rows without an id are rows that share one.
NO_ID = -(1 << 63) + 1
_MASK = (1 << 64) - 1


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written lookup table: by broadcast if it has at most ``limit`` rows, else by a shuffle that AQE may split."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)


def _met(rows: DataFrame, on: str, many: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the struct r that ``many`` or ``few`` (on, r) have for ``on``, a long; null where neither has it.

    Rows of a value of ``many`` (2000 values at most) meet it by broadcast; in the shuffle to
    ``few`` they go by a hash of the whole row, so that no task gets all of them.
    """
    told = rows.join(F.broadcast(many.select(on, F.lit(True).alias("hot"), F.col("r").alias("hot_r"))), on, "left")
    told = told.withColumn("met_key", F.when(F.col("hot"), F.xxhash64(*rows.columns)).otherwise(F.col(on)))
    out = told.join(few.select(F.col(on).alias("met_key"), "r"), "met_key", "left")
    return out.select(*rows.columns, F.when(F.col("hot"), F.col("hot_r")).otherwise(F.col("r")).alias("found"))


def repeated(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (a written table) with ``again``: true where ``name`` stands in two rows or more, else null; null names are alone.

    Names are counted with map-side combining. A name of HOT_ROWS rows or of a 2000th of all
    rows is hot: there are at most 2000 of those, so ``_met`` broadcasts them.
    """
    counts = written(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("times")).where("times > 1"), "counts")
    hot = max(HOT_ROWS, rows.count() // 2000)
    told = counts.select(name, "times", F.struct(F.lit(True).alias("again")).alias("r"))
    out = _met(rows, name, told.where(F.col("times") >= hot), told.where(F.col("times") < hot))
    return out.select(*rows.columns, F.col("found.again").alias("again"))


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``left`` (a written table) with ``right``, which has a value of ``on``, a long, once at most.

    Values of HOT_ROWS rows or of a 2000th of all rows of ``left``, of which there are 2000 at
    most, meet their rows of ``right`` by broadcast, the others by a shuffle. A hot value that
    ``right`` lacks is left to the shuffle.
    """
    hot = max(HOT_ROWS, left.count() // 2000)
    many = left.groupBy(on).agg(F.count("*").alias("times")).where(F.col("times") >= hot).select(on)
    more = [c for c in right.columns if c != on]
    told = right.select(on, F.struct(*more).alias("r"))
    out = _met(left, on, told.join(F.broadcast(many), on), told)
    if how == "inner":
        out = out.where("found is not null")
    return out.select(*left.columns, *[F.col("found")[c].alias(c) for c in more])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def key_of(column: str = "doc_id") -> Column:
    """The id, with NO_ID for null, so that joins and Python see a plain long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID).cast("long"))


def with_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """NO_ID is null again."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns})


def word_count(text: Column) -> Column:
    """Number of WORD runs of a text without nulls."""
    flat = F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers, by rule."""
    out, x = [], seed & _MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Polynomial:
    """Fingerprints of byte ranges: prefix sums of keyed bytes times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int):
        self.table = splitmix(256, seed)
        self.base = int(splitmix(1, seed + 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start, end) -> np.ndarray:
        """Fingerprints of [start, end), not mixed; add the length to the key where lengths differ."""
        return (sums[end] - sums[start]) * self.down[start]
