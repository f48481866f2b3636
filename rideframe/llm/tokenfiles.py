"""Token ids in ORC files: stripes of run-length encoded ids, with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import join_small, text_or_empty
from rideframe.llm.packing import Encoder
from rideframe.storage import CLEANUP, shared_folder

#: doc_id, number of the file by doc_id order, ids of the file before this document, number of ids, ids.
SCHEMA = "doc_id long, shard int, at long, n_tokens int, ids array<int>"
#: Bytes of ids that a worker gathers before it sends them on.
PART_BYTES = 4 << 20


def _encoded(folder: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, at = Encoder(folder), np.array([end_id], "<u4").tobytes(), 0

        def part(keys: list, shards: list, ids: list[bytes], before: int) -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shards, pa.int32()), pa.array(before + ends - sizes), pa.array(sizes.astype(np.int32)), lists], schema=schema)

        for batch in batches:
            keys, shards, ids, size = [], [], [], 0
            for key, shard, text in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist(), batch["text"]):
                own = encode(text.as_py()) + last
                keys.append(key), shards.append(shard), ids.append(own)
                size += len(own)
                if size >= PART_BYTES:
                    yield part(keys, shards, ids, at)
                    at, keys, shards, ids, size = at + size // 4, [], [], [], 0
            if keys:
                yield part(keys, shards, ids, at)
                at += size // 4

    return run


def write_token_files(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = 2, stripe_bytes: int = 64 << 20, stride: int = 1000) -> str:
    """Write the ids of every whole text, with ``end_id`` after each document, as ORC files in ascending doc_id order; the path comes back.

    Texts are dealt out by ranges of doc_id, so that file k holds the ids that come before
    those of file k + 1, and each task encodes its range in order and streams it into one
    file (SCHEMA). Integers are run-length encoded by the format; every ``stride`` rows have
    an entry in the row index with their least and greatest doc_id and a Bloom filter of doc_ids.
    Null texts are empty and have the closing id only; null ids come first; rows that share an
    id are ordered by text, and rows that repeat are written once each (they are dealt out by
    their place in the input, so that no task gets all of them). An empty table writes no rows.
    Long texts: a document is encoded whole in one task.
    """
    from rideframe.llm.quality import tokenizer_folder

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = ["doc_id", "tie", "place"]
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.spark_partition_id().alias("shard"), "text")
    ids = rows.mapInArrow(_encoded(folder or tokenizer_folder(), end_id), SCHEMA)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        ids.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_bytes)).orc(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents of the files; start counts the ids of all documents before.

    Stripes are read in parallel; a filter on doc_id reaches the scan, where it prunes
    stripes and rows by the index and the Bloom filters. The number of ids before each file comes from
    the narrow columns of the files, one row a file.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("shard", before.cast("long").alias("before"))
    return join_small(files, bases, ["shard"], "inner").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        data, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
        crcs = pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], crcs], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, for rows of ``read_token_files``."""
    return rows.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
