"""Embedding whitening: a compensated covariance in double-double and a tridiagonal divide-and-conquer eigen-solve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.llm.common import dropped, written

#: Entries in a block of products that a task holds at once.
BLOCK = 1 << 18
#: Partial sums that one group merges.
FAN_IN = 64
_PARTIAL = "task long, n long, high array<double>, low array<double>"
#: Quantised entries stay within this, so that sums of high and low halves are exact longs.
_MOST = 1 << 61


def two_sum(a, b):
    """a + b without error: the rounded sum and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _split(a):
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """a * b without error: the rounded product and what rounding lost."""
    p = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a, b):
    """Sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiplied(a, b):
    """Product of two double-doubles."""
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def total(high: np.ndarray, low: np.ndarray):
    """Sum over the first axis, in a tree of double-double additions."""
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([x, np.zeros_like(x[:1])]) for x in (high, low))
        high, low = added((high[::2], low[::2]), (high[1::2], low[1::2]))
    return high[0], low[0]


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")
    high, low = total(np.stack(rows["high"].to_numpy()), np.stack(rows["low"].to_numpy()))
    return pd.DataFrame({"task": [int(rows["task"].iloc[0]) // FAN_IN], "n": [int(rows["n"].sum())], "high": [high], "low": [low]})


def _reduced(partials: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Merge the tasks' high and low parts in a tree of fan-in FAN_IN; only the root, one row, comes to the driver."""
    rows = written(partials, "partials")
    most = rows.agg(F.max("task")).first()[0]
    if most is None:
        return None
    while True:
        rows, before = written(rows.groupBy(F.floor(F.col("task") / FAN_IN).alias("at")).applyInPandas(_merged, _PARTIAL), "partials"), rows
        dropped(before)
        if most < FAN_IN:
            break
        most //= FAN_IN
    root = rows.first()
    dropped(rows)
    return root["n"], np.array(root["high"]), np.array(root["low"])


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _partial(n: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "n": pa.array([n], pa.int64()), "high": pa.array([high], pa.list_(pa.float64())), "low": pa.array([low], pa.list_(pa.float64()))})


def _added_up(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, (np.zeros(dim), np.zeros(dim))
        for batch in batches:
            x = _matrix(batch, dim)
            if len(x):
                n, sums = n + len(x), added(sums, total(x, np.zeros_like(x)))
        if n:
            yield _partial(n, *sums)

    return run


def _outer(dim: int, centre):
    """Upper triangle of the centred outer products of a task's rows; ``centre`` takes a block and returns double-doubles."""
    rows_, cols = np.triu_indices(dim)
    step = max(1, BLOCK // len(rows_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, (np.zeros(len(rows_)), np.zeros(len(rows_)))
        for batch in batches:
            x = _matrix(batch, dim)
            for k in range(0, len(x), step):
                high, low = centre(x[k : k + step])
                products = multiplied((high[:, rows_], low[:, rows_]), (high[:, cols], low[:, cols]))
                n, sums = n + len(high), added(sums, total(*products))
        if n:
            yield _partial(n, *sums)

    return run


def _full(dim: int, n: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The matrix of triangle sums over n, each entry rounded once."""
    values = [float((Fraction(float(a)) + Fraction(float(b))) / n) for a, b in zip(high, low)]
    out = np.zeros((dim, dim))
    out[np.triu_indices(dim)] = values
    return np.triu(out) + np.triu(out, 1).T


@dataclass
class Whitening:
    """What a fit keeps: rows, exact sums per dimension, covariance trace, the leading unit eigenvectors (columns) and eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)


def quantised(df: DataFrame, column: str, scale: int, shift: int) -> DataFrame:
    """``df`` with x, floor(scale * entry) + shift as longs; rows whose vector is null, or holds a null or non-finite entry, go.

    Vectors of another length than most rows have (the longer, if two lengths tie) are not of
    this space and go too, empty ones among them. Entries beyond 2**61 count as 2**61.
    """
    entry = lambda c: c.cast("double")
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < F.lit(float("inf"))))
    rows = df.where(F.col(column).isNotNull()).where(finite).where(F.size(column) > 0)
    lengths = rows.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    dim = lengths["length"] if lengths else 0
    held = lambda c: F.least(F.greatest(entry(c) * float(scale), F.lit(-float(_MOST))), F.lit(float(_MOST)))
    return rows.where(F.size(column) == dim).withColumn("x", F.transform(column, lambda c: F.floor(held(c)).cast("long") + F.lit(shift).cast("long")))


def _exact_sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim)), "n": pa.array(np.full(dim, n)), "high": pa.array(high), "low": pa.array(low)})

    return run


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Fit on all rows' x (longs of one length); None without rows.

    Sums are exact: high and low halves of 32 bits are added as longs. The mean is their ratio
    in double-double, every row is centred before it is multiplied, and products are added in
    double-double by error-free transformations within tasks and, high and low parts together,
    in a tree across tasks. The driver gets sums of ``dim`` and ``dim * (dim + 1) / 2`` numbers
    and solves the eigenproblem by LAPACK's syevd: reduction to tridiagonal form, then divide
    and conquer.
    """
    some = rows.select("x").first()
    if some is None:
        return None
    dim = len(some["x"])
    parts = rows.select("x").mapInArrow(_exact_sums(dim), "at long, n long, high long, low long")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()  # dim rows
    n, exact = sums[0]["n"], [(r["high"] << 32) + r["low"] for r in sums]
    means = [Fraction(s, n) for s in exact]
    high = np.array([float(m) for m in means])
    low = np.array([float(m - Fraction(float(h))) for m, h in zip(means, high)])

    def centre(x: np.ndarray):
        # a long is two doubles without error
        upper = x >> 32
        return added((upper.astype(float) * 4294967296.0, (x & 0xFFFFFFFF).astype(float)), (-high, -low))

    covariance = _full(dim, *_reduced(rows.select("x").mapInArrow(_outer(dim, centre), _PARTIAL)))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, exact, float(np.trace(covariance)), vectors[:, order], np.maximum(values[order], 0.0))


def _projected(model: Whitening, keep: list[str]):
    floor = model.trace * model.dim * 2.0**-50
    scale = np.array([e**-0.5 if e > floor else np.nan for e in model.values])
    sums = np.array(model.sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, model.dim)
            if len(x) and model.n * int(np.abs(x).max()) + max(map(abs, model.sums)) < 1 << 62:
                apart = model.n * x - sums.astype(np.int64)
            else:
                apart = model.n * x.astype(object) - sums
            most = int(np.abs(apart).max()) if len(x) else 0
            if most * most * model.dim < 1 << 63:
                squares = (apart.astype(np.int64) ** 2).sum(axis=1)
                deviation = pa.array(squares, pa.int64())
            else:
                deviation = pa.array([s if s < 1 << 63 else None for s in (apart.astype(object) ** 2).sum(axis=1)], pa.int64())
            told = (apart.astype(float) / model.n) @ model.vectors * scale
            lists = pa.array(list(told), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], deviation, lists], names=[*keep, "deviation", "x"])

    return run


def whiten(rows: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """``keep`` columns, deviation and x (double per component) of every row: centred, projected and scaled to unit variance.

    deviation is the exact sum over dimensions of (n * x - sum)**2, null where it exceeds a long.
    Directions without spread (variance below rounding) are NaN.
    """
    kinds = dict(rows.dtypes)
    return rows.select(*keep, "x").mapInArrow(_projected(model, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", deviation long, x array<double>")


def identity_error(white: DataFrame, spread: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of x minus the identity, over the components with ``spread``; x is centred in a pass before."""
    at = np.flatnonzero(spread)
    if not len(at):
        return None
    rows = white.select(F.array(*[F.col("x")[int(k)] for k in at]).alias("x"))
    n, high, low = _reduced(rows.mapInArrow(_added_up(len(at)), _PARTIAL))
    means = [(Fraction(float(a)) + Fraction(float(b))) / n for a, b in zip(high, low)]
    upper = np.array([float(m) for m in means])
    lower = np.array([float(m - Fraction(float(h))) for m, h in zip(means, upper)])
    centre = lambda x: added((x, np.zeros_like(x)), (-upper, -lower))
    covariance = _full(len(at), *_reduced(rows.mapInArrow(_outer(len(at), centre), _PARTIAL)))
    return float(np.abs(covariance - np.eye(len(at))).max())


def whitened_embeddings(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024, shift: int = 100_000, components: int = 8) -> DataFrame:
    """One row per remaining vector and component: id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Dropped are rows that ``quantised`` drops; rows that repeat, and null ids, stay as rows of
    their own. Vectors shorter than ``components`` have as many components as entries. An empty
    table, or one without a usable vector, gives no rows. A component without spread (all
    vectors equal in it) has null whitened; identity_error is over the others, null without any.
    A fit needs memory for ``dim * (dim + 1) / 2`` sums a task, whatever the number of rows.
    """
    narrow = quantised(df.select(F.col(id_column).alias("vec_key"), F.col(column).alias("vec_entries")), "vec_entries", scale, shift)
    rows = written(narrow.select("vec_key", "x"), "quantised")
    kind = dict(rows.dtypes)["vec_key"]
    model = fit_whitening(rows, components)
    if model is None:
        out = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], out)
    white = written(whiten(rows, model, ["vec_key"]), "whitened")
    dropped(rows)
    error = identity_error(white, model.values > model.trace * model.dim * 2.0**-50)
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values])
    out = white.select("vec_key", "deviation", F.posexplode("x").alias("at", "value"))
    return out.select(
        F.col("vec_key").alias(id_column),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
