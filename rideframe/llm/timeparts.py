"""Adaptive time partitions: years, months, days and hours joined into runs, or split, so that leaves have about as many rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import dropped, join_small, written
from rideframe.storage import CLEANUP, shared_folder

YEAR, MONTH, DAY, HOUR = range(4)
#: The leaf of rows without a moment.
NO_MOMENT = "null"
EPOCH = "date'1970-01-01'"


def year_key(m: Column) -> Column:
    return F.year(m).cast("long")


def month_key(m: Column) -> Column:
    """Months since year 0."""
    return (F.year(m) * 12 + F.month(m) - 1).cast("long")


def day_key(m: Column) -> Column:
    """Days since 1970."""
    return F.unix_date(m.cast("date")).cast("long")


def hour_key(m: Column) -> Column:
    """Hours since 1970."""
    return F.unix_date(m.cast("date")).cast("long") * 24 + F.hour(m)


def _date(day: Column) -> Column:
    return F.date_add(F.expr(EPOCH), day.cast("int"))


def _first_day(month: Column) -> Column:
    return F.make_date((F.floor(month / 12)).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))


def _keys(hours: DataFrame) -> DataFrame:
    day = F.floor(F.col("hour") / 24).cast("long")
    return hours.withColumn("day", day).withColumns({"month": month_key(_date(F.col("day"))), "year": year_key(_date(F.col("day")))})


def siblings(hours: DataFrame, limit: int) -> DataFrame:
    """level, parent, key, n of all siblings: the years, and the months, days and hours of every node above ``limit``; the last row of a parent is an end mark.

    ``hours`` has hour (since 1970) and n. Keys are consecutive within a parent, nodes without
    rows included. A node has more than ``limit`` rows to be split, so the table is bounded by
    rows / limit nodes a level times 31, and by the years.
    """
    days = hours.groupBy("day", "month", "year").agg(F.sum("n").alias("n"))
    days = written(days, "days")
    months = written(days.groupBy("month", "year").agg(F.sum("n").alias("n")), "months")
    years = months.groupBy(F.col("year").alias("key")).agg(F.sum("n").alias("n"))

    def children(level: int, parents: DataFrame, first: Column, last: Column) -> DataFrame:
        keys = F.explode(F.sequence(first.cast("long"), (last + 1).cast("long")))
        return parents.select(F.lit(level).alias("level"), "parent", last.cast("long").alias("last"), keys.alias("key"))

    span = years.agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a is not null").withColumn("parent", F.lit(0).cast("long"))
    rows = children(YEAR, span, F.col("a"), F.col("b"))
    split = years.where(F.col("n") > limit).select(F.col("key").alias("parent"))
    rows = rows.unionByName(children(MONTH, split, F.col("parent") * 12, F.col("parent") * 12 + 11))
    split = months.where(F.col("n") > limit).select(F.col("month").alias("parent"))
    first = _first_day(F.col("parent"))
    rows = rows.unionByName(children(DAY, split, F.unix_date(first), F.unix_date(F.last_day(first))))
    split = days.where(F.col("n") > limit).select(F.col("day").alias("parent"))
    rows = rows.unionByName(children(HOUR, split, F.col("parent") * 24, F.col("parent") * 24 + 23))
    counts = years.select(F.lit(YEAR).alias("level"), "key", "n")
    counts = counts.unionByName(months.select(F.lit(MONTH).alias("level"), F.col("month").alias("key"), "n"))
    counts = counts.unionByName(days.select(F.lit(DAY).alias("level"), F.col("day").alias("key"), "n"))
    counts = counts.unionByName(hours.select(F.lit(HOUR).alias("level"), F.col("hour").alias("key"), "n"))
    told = rows.join(counts, ["level", "key"], "left")
    own = F.when(F.col("key") <= F.col("last"), F.coalesce("n", F.lit(0))).otherwise(0)
    return told.select("level", "parent", "key", own.cast("long").alias("n"), (F.col("key") > F.col("last")).alias("ended"))


def run_starts(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` of ``siblings`` with start: whether a run starts there.

    Each sibling's next start is the last one whose rows before it are within ``limit`` of the
    rows before itself (or the next sibling, if it is above ``limit`` alone). From the first
    sibling of every parent, pointer doubling marks what is reachable: each round adds the targets of
    all marks and joins the pointers with themselves, all parents at once, for as many rounds as
    the logarithm of the longest list of siblings.
    """
    order = Window.partitionBy("level", "parent").orderBy("key")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("start", F.row_number().over(order) == 1)
    reach = F.max("key").over(Window.partitionBy("level", "parent").orderBy("before").rangeBetween(0, limit))
    pointer = F.when(F.col("ended"), F.col("key")).otherwise(F.greatest(reach, F.col("key") + 1))
    rows = written(rows.withColumn("next", pointer), "pointers")
    longest = rows.groupBy("level", "parent").count().agg(F.max("count")).first()[0] or 0
    on = ["level", "parent", "key"]
    for _ in range(max(0, longest - 1).bit_length()):
        found = rows.where("start").select("level", "parent", F.col("next").alias("key")).distinct().withColumn("found", F.lit(True))
        ahead = rows.select("level", "parent", F.col("key").alias("next"), F.col("next").alias("beyond"))
        step = rows.join(found, on, "left").join(ahead, ["level", "parent", "next"])
        step = step.select("level", "parent", "key", "n", "ended", (F.col("start") | F.col("found").isNotNull()).alias("start"), F.col("beyond").alias("next"))
        rows, was = written(step, "pointers"), rows
        dropped(was)
    return rows


def leaf_members(hours: DataFrame, limit: int) -> DataFrame:
    """level, key, leaf, large of every sibling that is part of a leaf with rows; a large leaf is one hour above ``limit``."""
    rows = run_starts(siblings(hours, limit), limit)
    order = Window.partitionBy("level", "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.last(F.when(F.col("start"), F.col("key")), ignorenulls=True).over(order)).where(~F.col("ended"))
    run = Window.partitionBy("level", "parent", "run")
    rows = rows.withColumns({"first": F.min("key").over(run), "last": F.max("key").over(run), "total": F.sum("n").over(run)})
    rows = rows.where((F.col("total") > 0) & ((F.col("total") <= limit) | (F.col("level") == HOUR)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = lambda c: F.format_string("%04d", c)
    months = lambda c: two(F.pmod(c, F.lit(12)) + 1)
    day = _date(F.floor(F.when(F.col("level") == DAY, F.col("key")).when(F.col("level") == HOUR, F.col("parent"))))
    month = F.when(F.col("level") == DAY, F.col("parent")).otherwise(month_key(day))
    above = F.when(F.col("level") == YEAR, F.lit("")).when(F.col("level") == MONTH, F.concat(year(F.col("parent")), F.lit("/")))
    above = above.otherwise(F.concat(year(F.floor(month / 12)), F.lit("/"), months(month), F.lit("/"), F.when(F.col("level") == HOUR, F.concat(two(F.dayofmonth(day)), F.lit("/"))).otherwise("")))

    def named(c: Column) -> Column:
        return F.when(F.col("level") == YEAR, year(c)).when(F.col("level") == MONTH, months(c)).when(F.col("level") == DAY, two(F.dayofmonth(_date(c)))).otherwise(two(F.pmod(c, F.lit(24))))

    leaf = F.concat(above, named(F.col("first")), F.lit("-"), named(F.col("last")))
    return rows.select("level", "key", leaf.alias("leaf"), (F.col("total") > limit).alias("large"))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each leaf in a task's sorted rows, from 1."""
    last, seen = None, 0
    for batch in batches:
        if not len(batch):
            continue
        leaf = batch["leaf"].to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        at = np.arange(len(leaf)) - np.repeat(begins, np.diff(np.r_[begins, len(leaf)])) + 1
        if leaf[0] == last:
            at[: begins[1] if len(begins) > 1 else len(leaf)] += seen
        last, seen = leaf[-1], int(at[-1])
        yield batch.append_column("at", pa.array(at))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


@dataclass
class Layout:
    """Files of a table in a folder: ``files`` (written) has leaf, part, n_rows, n_new, hashes and stays, one row per file."""

    folder: str
    columns: list[str]
    schema: str
    files: DataFrame
    order: list[str]
    names: tuple[str, str]

    def rows(self) -> DataFrame:
        """The rows of all files."""
        return self.files.sparkSession.read.schema(self._all()).parquet(self.folder).select(*self.columns)

    def _all(self) -> str:
        return f"{self.schema}, `{self.names[0]}` string, `{self.names[1]}` long"

    def paths(self) -> DataFrame:
        """leaf, part, path, n_rows of the files in the folder; the counts come from the files."""
        files = self.files.sparkSession.read.schema(self._all()).parquet(self.folder)
        return files.groupBy(_leaf(F.col(self.names[0])).alias("leaf"), F.col(self.names[1]).alias("part"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))

    def digests(self, id_column: str) -> DataFrame:
        """leaf, part and the sha256 of the ids, comma-joined in file order, of every file; a null id is empty.

        Ids are dealt out by file, in order, and each file's are streamed through one digest.
        """
        files = self.files.sparkSession.read.schema(self._all()).parquet(self.folder)
        ids = files.select(F.col(self.names[0]).alias("leaf"), F.col(self.names[1]).alias("part"), F.col("_metadata.row_index").alias("at"), F.col(id_column).cast("string").alias("id"))
        ids = ids.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "at")
        return ids.mapInArrow(_hashed, "leaf string, part long, ids_sha256 string").withColumn("leaf", _leaf(F.col("leaf")))


def _leaf(name: Column) -> Column:
    return F.translate(name, "_", "/")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest = None, None

    def told(done: tuple, value) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"leaf": pa.array([done[0]], pa.string()), "part": pa.array([done[1]], pa.int64()), "ids_sha256": pa.array([value.hexdigest()], pa.string())})

    for batch in batches:
        leaf, part, ids = batch["leaf"].to_pylist(), batch["part"].to_numpy(), batch["id"].to_pylist()
        a = 0
        while a < len(ids):
            key = (leaf[a], int(part[a]))
            # rows of a file stand together
            more = np.flatnonzero((part[a:] != part[a]) | np.array([x != leaf[a] for x in leaf[a:]]))
            b = a + int(more[0]) if len(more) else len(ids)
            text = ",".join(x or "" for x in ids[a:b]).encode()
            if key != at:
                if at is not None:
                    yield told(at, digest)
                at, digest = key, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
            a = b
    if at is not None:
        yield told(at, digest)


def _placed(rows: DataFrame, columns: list[str], moment: Column, limit: int, order: list[str]) -> DataFrame:
    """``rows`` with time_moment, time_tie, leaf, part: written, every row with its file."""
    rows = rows.withColumn("time_moment", moment).withColumn("time_tie", F.xxhash64(*columns))
    counts = written(_keys(rows.groupBy(hour_key(F.col("time_moment")).alias("hour")).agg(F.count("*").alias("n"))), "hours")
    hours, without = counts.where("hour is not null"), counts.where("hour is null").first()
    members = written(leaf_members(hours, limit), "members")
    told = rows
    for level, key in enumerate((year_key, month_key, day_key, hour_key)):
        own = members.where(F.col("level") == level).select(F.col("key").alias(f"time_key{level}"), F.struct("leaf", "large").alias(f"time_leaf{level}"))
        told = join_small(told.withColumn(f"time_key{level}", key(F.col("time_moment"))), own, [f"time_key{level}"])
    found = F.coalesce(*[F.col(f"time_leaf{k}") for k in range(4)])
    told = told.withColumn("leaf", F.coalesce(found["leaf"], F.lit(NO_MOMENT)))
    told = told.withColumn("large", F.coalesce(found["large"], F.lit(without is not None and without["n"] > limit)))
    told = told.select(*columns, "time_new", "time_moment", "time_tie", "leaf", "large")
    small = told.where(~F.col("large")).withColumn("part", F.lit(1).cast("long"))
    # large leaves have many parts: ranges of the whole order are numbered, then the ranges are added up
    by = ["leaf", "time_moment", *order, "time_tie"]
    large = told.where("large").withColumn("time_place", F.monotonically_increasing_id())
    ranged = large.repartitionByRange(*by, "time_place").sortWithinPartitions(*by, "time_place").withColumn("time_block", F.spark_partition_id())
    kinds = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)
    ranged = written(ranged.mapInArrow(_positions, f"{kinds}, at long"), "ranged")
    sizes = ranged.groupBy("leaf", "time_block").agg(F.max("at").alias("n"))
    earlier = Window.partitionBy("leaf").orderBy("time_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.select("leaf", "time_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "sizes")
    rank = F.col("before") + F.col("at")
    large = join_small(ranged, sizes, ["leaf", "time_block"], "inner").withColumn("part", (F.floor((rank - 1) / limit) + 1).cast("long"))
    out = written(small.unionByName(large.select(*small.columns)), "placed")
    dropped(counts, members, ranged, sizes)
    return out


def write_layout(rows: DataFrame, moment: Column, limit: int, order: list[str], is_new: Column | None = None, previous: Layout | None = None) -> Layout:
    """Write ``rows`` as one Parquet file per leaf and part of at most ``limit`` rows; or rewrite the folder of ``previous`` for them.

    The years from the first to the last moment are siblings; a node above ``limit`` rows is
    split into all its months, days or hours, and siblings within it join the run before them
    while that stays within it (``run_starts``). Leaves are runs with rows, hours above ``limit``
    and all null moments. A leaf's rows are ordered by moment, ``order`` (nulls first) and a hash
    of all columns, so that ties come in the same order at every call, and fill its parts.

    With ``previous``, a file whose leaf, part and rows (count and sums of two hashes of all
    columns) are as before stays untouched; the other files are written anew and the old ones
    deleted. ``is_new`` marks the rows that n_new counts. Repeated rows all stay. An
    empty table has no files. Columns named leaf or part are kept: the folders take other names.

    One task writes each file, streaming its sorted rows; no other step gathers rows. What is
    broadcast or comes to the driver is one row per sibling or file: bounded by rows / limit.
    """
    spark, columns = rows.sparkSession, rows.columns
    names = previous.names if previous else (_free("leaf", columns), _free("part", columns))
    folder = previous.folder if previous else f"{shared_folder(spark)}/timeparts-{uuid.uuid4().hex}"
    # inside, the columns have names that clash with nothing
    inner = [f"column{i}" for i in range(len(columns))]
    renamed = dict(zip(columns, inner))
    marked = rows.select(moment.alias("time_moment"), (F.lit(False) if is_new is None else F.coalesce(is_new, F.lit(True))).alias("time_new"), *[F.col(f"`{c}`").alias(renamed[c]) for c in columns])
    placed = _placed(marked, inner, F.col("time_moment"), limit, [renamed[c] for c in order])
    other = F.xxhash64(F.lit(1), *inner)
    low, high = (lambda h: h.bitwiseAND(0xFFFFFFFF)), (lambda h: F.shiftrightunsigned(h, 32))
    sums = [F.sum(f(h)).alias(f"hash{i}") for i, (f, h) in enumerate([(low, F.col("time_tie")), (high, F.col("time_tie")), (low, other), (high, other)])]
    files = placed.groupBy("leaf", "part").agg(F.count("*").alias("n_rows"), F.sum(F.col("time_new").cast("long")).alias("n_new"), *sums)
    if previous:
        same = previous.files.select("leaf", "part", "n_rows", *[f"hash{i}" for i in range(4)]).withColumn("stays", F.lit(True))
        files = files.join(same, [c for c in same.columns if c != "stays"], "left").withColumn("stays", F.col("stays").isNotNull())
        old = previous.paths().select("leaf", "part", "path").collect()  # one row a file, at most twice rows / limit and one a leaf
    else:
        files, old = files.withColumn("stays", F.lit(False)), []
    files = written(files, "files")
    todo = placed
    if previous:
        todo = join_small(placed, files.where("stays").select("leaf", "part", "stays"), ["leaf", "part"], "left_anti")
    order_ = ["time_moment", *[renamed[c] for c in order], "time_tie"]
    safe = todo.withColumn("leaf", F.translate("leaf", "/", "_"))
    sorted_ = safe.repartition("leaf", "part").sortWithinPartitions("leaf", "part", *order_)
    out = sorted_.select(*[F.col(renamed[c]).alias(c) for c in columns], F.col("leaf").alias(names[0]), F.col("part").alias(names[1]))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out.write.mode("append").partitionBy(*names).parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    if previous:
        kept = {(r["leaf"], r["part"]) for r in files.where("stays").select("leaf", "part").collect()}
        gone = [r["path"] for r in old if (r["leaf"], r["part"]) not in kept]
        for path in gone:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    dropped(placed)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return Layout(folder, columns, schema, files, order, names)


def layout_report(layout: Layout, id_column: str) -> DataFrame:
    """leaf, columns, ids_sha256, path, part, n_rows, n_new, rewritten of every file, read back from the folder."""
    files = layout.files.select("leaf", "part", "n_new", (~F.col("stays")).alias("rewritten"))
    out = layout.paths().join(layout.digests(id_column), ["leaf", "part"]).join(files, ["leaf", "part"])
    return out.select("leaf", F.lit(",".join(layout.columns)).alias("columns"), "ids_sha256", "path", "part", "n_rows", "n_new", "rewritten")
