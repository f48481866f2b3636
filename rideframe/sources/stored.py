"""Stored tables that batches are merged into: hash buckets, of which only the touched ones are rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideframe import storage

Merge = Callable[[DataFrame], DataFrame]


class StoredTable:
    """A Parquet table in ``path`` with a row per ``key``, in ``buckets`` folders by a hash of it.

    ``merge`` takes rows of the table and of a batch together and returns one row per key; with
    equal keys in one bucket, it shuffles nothing that is not touched.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, merge: Merge, buckets: int = 64):
        self.spark, self.path, self.key, self.merge, self.buckets = spark, path, key, merge, buckets
        self.schema = f"{schema}, batch long, bucket int"
        self.columns = spark.createDataFrame([], schema).columns

    def _rows(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().select(*self.columns)

    def upsert(self, rows: DataFrame, batch: int) -> list[int]:
        """Merge ``rows`` into the buckets that their keys fall in; the rewritten buckets come back.

        Only those buckets are read, and only they are overwritten; other folders keep their
        files. Every bucket remembers the last batch that it took, so a batch that is run again,
        after a failure half-way or by mistake, is merged into no bucket twice. Batches are
        numbered upwards. Rows without a key go.
        """
        rows = rows.where(F.col(self.key).isNotNull()).select(*self.columns)
        # written once, as it is read once for its buckets and once to be merged
        rows = storage.written(rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")), "batch")
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most `buckets` rows
        own = self._rows().where(F.col("bucket").isin(sorted(touched)))
        have = {r["bucket"] for r in own.groupBy("bucket").agg(F.max("batch").alias("b")).where(F.col("b") >= batch).collect()}
        todo = sorted(touched - have)
        if not todo:
            storage.dropped(rows)
            return []
        both = own.where(F.col("bucket").isin(todo)).select(*self.columns).unionByName(rows.where(F.col("bucket").isin(todo)).select(*self.columns))
        out = self.merge(both).select(*self.columns, F.lit(batch).cast("long").alias("batch"), F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        storage.dropped(rows)
        return todo


def last_version(key: str, version: str) -> Merge:
    """The row of the latest version of each key; of rows of one version that with the least other columns."""

    def merge(rows: DataFrame) -> DataFrame:
        latest = rows.groupBy(key).agg(F.max(version).alias("latest"))
        rest = [c for c in rows.columns if c not in (key, version)]
        newest = rows.join(latest, key).where(F.col(version).eqNullSafe(F.col("latest")))
        return newest.groupBy(key, version).agg(F.min(F.struct(*rest)).alias("r")).select(key, version, "r.*").select(*rows.columns)

    return merge
