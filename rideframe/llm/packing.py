"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import join_small, key_of, with_nulls, written

#: Fixed value: the string that the vocabulary file lists as a special token.
SPECIAL = "<|endoftext|>"
#: Chunks of text whose ids a worker remembers.
CACHE = 300_000


class _Chunks(dict):
    """Text between two lone spaces -> its ids as uint32 bytes; ``lead`` stands before the chunk."""

    def __init__(self, encode, lead: str):
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise LookupError  # the space beside it isn't alone: chunks can't be encoded apart
        out = self.encode(self.lead + chunk)
        if "\n" not in chunk:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Ids of byte_bpe_50k.json, as little-endian uint32 bytes.

    The same vocabulary as ranks gives equal ids several times faster; a text that holds the
    special token goes through the file itself. A lone space always begins a new unit of the
    vocabulary's split pattern, so chunks between lone spaces are encoded apart and remembered.
    """

    def __init__(self, folder: str):
        import public_tokenizers
        import tiktoken

        self.folder, self.whole = folder, None
        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Chunks(self.ordinary, ""), _Chunks(self.ordinary, " ")

    def ordinary(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(f"{self.folder}/byte_bpe_50k.json")
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *later = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.later.__getitem__, later))
        except LookupError:
            return self.ordinary(text)


def _pieces(folder: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(folder)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, how many, offset).

    Sequences of equal free space are held as intervals, so the work depends on the number
    of lengths, not of documents. Each piece goes to the fullest sequence that it fits.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []  # sorted keys of free
    rows, opened = [], 0

    def put(space: int, start: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((start, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                start, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, start, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                rows += [(length, rank + j * full, start, full, capacity - space + j * length) for j in range(each)]
                put(space - each * length, start, full)
            else:
                full, each = 1, left
                rows += [(length, rank + j, start, 1, capacity - space + j * length) for j in range(left)]
                put(space - left * length, start, 1)
            put(space, start + full, n - full)
            rank, left = rank + each * full, left - each * full
    return rows


def _place(rows: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    lengths, ranks = table[:, 0], table[:, 1]
    begin = {int(x): int(i) for x, i in zip(*np.unique(lengths, return_index=True))}
    end = {x: int(np.searchsorted(lengths, x, "right")) for x in begin}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.empty(len(batch), np.int64)
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            for x in np.unique(length):
                own, a, b = length == x, begin[int(x)], end[int(x)]
                at[own] = a + np.searchsorted(ranks[a:b], rank[own], "right") - 1
            batch["sequence_id"] = table[at, 2] + rank - table[at, 1]
            batch["offset"] = table[at, 4]
            yield batch.drop(columns="rank")

    return run


def best_fit_packing(docs: DataFrame, capacity: int = 2048, folder: str | None = None, block_rows: int = 20_000) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset; a document is its ids and a
    closing id 0, cut only if longer than a sequence, the first piece then being the shorter
    one. Null and empty texts are one piece of one id. Rows that repeat are packed once each.
    The plan has rows for lengths and free spaces only: its size is bounded by ``capacity``,
    whatever the input, and it goes to the executors with the placing function. The rank of a
    piece within its length is its rank within (length, block) plus the sizes of the blocks
    before, so a length that a third of all pieces share is spread over many tasks, and so are
    rows that repeat. An empty table has no pieces; a very long text is encoded whole in one task.
    """
    from rideframe.llm.quality import tokenizer_folder

    narrow = docs.select(key_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = narrow.mapInPandas(_pieces(folder or tokenizer_folder(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = written(pieces.withColumn("spot", F.monotonically_increasing_id()), "pieces")  # tells rows that repeat apart
    histogram = pieces.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most `capacity` rows
    blocks = max(1, math.ceil(sum(counts.values()) / block_rows))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "spot"), F.lit(blocks)).cast("int"))
    sizes = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select("length", "block", before.alias("before")), "ranks")
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = join_small(pieces.withColumn("own", F.row_number().over(order)), sizes, ["length", "block"], "inner")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return with_nulls(ranked.mapInPandas(_place(plan(counts, capacity)), out), "doc_id")
