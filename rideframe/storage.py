"""Tables in the folder that all executors share, which cut the lineage of long jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark drops the shuffle files of a query when it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a temporary one in a local session; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="rideframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor never recomputes what came before, and lets
    the shuffle files behind ``df`` go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_files(texts: DataFrame, name: str) -> str:
    """The path in the shared folder of the texts (one string column), each in a file of its own."""
    path = f"{shared_folder(texts.sparkSession)}/{name}-{uuid.uuid4().hex}"
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_folders(rows: DataFrame, path: str, key: str, text: Column, order: list[str], kind: str) -> None:
    """Replace ``path`` by a folder ``key``=value for every value of a column, named as Spark names partitions, with one file of its texts in order, a line each.

    Spark's writer moves the folder of every value at the end, one after the other from the driver. Here a task
    writes a file where it stays, under a hidden name until it is whole, so that a task that runs twice leaves it once.
    """
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        held: tuple = ()  # value, hidden name, stream

        def close() -> None:
            held[2].close()
            system.move(held[1], f"{held[1].rpartition('/')[0]}/part-00000.{kind}")

        n = 0
        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held or held[0] != value:
                    if held:
                        close()
                    # as Spark's writer escapes them, and names what is null or empty
                    name = re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
                    folder = f"{base.rstrip('/')}/{key}={name}"
                    system.create_dir(folder, recursive=True)
                    hidden = f"{folder}/_{uuid.uuid4().hex}"
                    held, n = (value, hidden, system.open_output_stream(hidden)), n + 1
                held[2].write(f"{line}\n".encode())
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    told = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("value"), text.alias("text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    told = told.repartition("value").sortWithinPartitions("value", *[f"o{i}" for i in range(len(order))]).select("value", "text").where("text is not null")
    if not told.mapInArrow(put, "n long").agg(F.sum("n")).first()[0]:
        root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
