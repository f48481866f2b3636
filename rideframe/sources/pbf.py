"""Binary map files: a data source that reads them blob by blob, and the blobs of a table of nodes or ways."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, nodes array<long>, tags map<string,string>"
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("nodes", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])
#: Numbers of the fields of the format's messages.
BLOB_TYPE, BLOB_SIZE = 1, 3
RAW, PACKED = 1, 3
STRINGS, GROUP, GRANULARITY, LAT_OFFSET, LON_OFFSET = 1, 2, 17, 19, 20
NODE, DENSE, WAY = 1, 2, 3
ID, KEYS, VALUES, LAT, LON, REFS, DENSE_TAGS = 1, 2, 3, 8, 9, 8, 10


def varints(data: bytes) -> np.ndarray:
    """All varints of a packed field: every byte knows its number and its place in it."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1]
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        more = last - first >= k
        out[more] |= (raw[first[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: a whole number, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + n]
            at += n


def _bytes(value: int | bytes) -> bytes:
    """A packed field, or the varint of one that is not."""
    return value if isinstance(value, bytes) else _varint(value)


def _lists(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Varints of many packed fields, all at once, and where those of each begin and the last end."""
    data = b"".join(values)
    ends = np.cumsum([len(v) for v in values], dtype=np.int64)
    upto = np.r_[0, np.cumsum(np.frombuffer(data, np.uint8) < 128, dtype=np.int64)]
    return varints(data), np.r_[0, upto[ends]].astype(np.int64)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums that start anew at each list."""
    sums = np.r_[0, np.cumsum(signed(values))]
    return sums[1:] - np.repeat(sums[begin[:-1]], np.diff(begin))


def _dense_tags(data: bytes, n: int) -> tuple[list[int], list[int], list[int]]:
    """Keys, values and number of tags of each of n dense nodes."""
    marks = varints(data).tolist()
    keys, values, counts = [], [], [0] * n
    at = k = 0
    while k < len(marks):
        if marks[k] == 0:
            at, k = at + 1, k + 1
        else:
            keys.append(marks[k])
            values.append(marks[k + 1])
            counts[at] += 1
            k += 2
    return keys, values, counts


KINDS = ("node", "way")


def decoded_batch(blob: bytes, kinds: tuple[str, ...] = KINDS) -> pa.RecordBatch:
    """Rows of SCHEMA of the nodes and ways of a data blob, in columns; relations, and other ``kinds`` than those asked for, are left out.

    Dense nodes are running sums of packed differences, and so are the nodes of ways, those of all
    ways of a blob taken at once; places are whole numbers of the block's granularity.
    """
    body = dict(fields(blob))
    data = zlib.decompress(body[PACKED]) if PACKED in body else body.get(RAW, b"")
    strings, groups, block = [], [], {GRANULARITY: 100, LAT_OFFSET: 0, LON_OFFSET: 0}
    for key, value in fields(data):
        if key == STRINGS:
            strings = [v.decode("utf-8", "replace") for _, v in fields(value)]
        elif key == GROUP:
            groups.append(value)
        elif isinstance(value, int):
            block[key] = value - (1 << 64) if value >> 63 else value
    wanted = {key for kind, own in (("node", (DENSE, NODE)), ("way", (WAY,))) if kind in kinds for key in own}
    runs: list[tuple[bool, list]] = []  # neighbours of one kind, as messages
    for group in groups:
        for key, value in fields(group):
            if key in wanted:
                if key == DENSE or not runs or runs[-1][0] != key:
                    runs.append((key, []))
                runs[-1][1].append(value if key == DENSE else dict(fields(value)))

    def table(kind: str, ids, lat, lon, refs, first, keys, values, begin) -> pa.RecordBatch:
        n, words = len(ids), pa.array(strings, pa.string())
        named = [words.take(pa.array(np.asarray(x, np.int64))) for x in (keys, values)]
        place = [1e-9 * (block[offset] + block[GRANULARITY] * x) if x is not None else None for offset, x in ((LAT_OFFSET, lat), (LON_OFFSET, lon))]
        offsets = lambda x: pa.array(np.asarray(x, np.int32))
        columns = [
            pa.array([kind] * n, pa.string()), pa.array(np.asarray(ids, np.int64)), *(pa.array(x) if x is not None else pa.nulls(n, pa.float64()) for x in place),
            pa.ListArray.from_arrays(offsets(first), pa.array(refs)) if refs is not None else pa.nulls(n, pa.list_(pa.int64())), pa.MapArray.from_arrays(offsets(begin), *named),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    parts = []
    for key, found in runs:
        if key == DENSE:
            got = dict(fields(found[0]))
            ids, lat, lon = (np.cumsum(signed(varints(got.get(k, b"")))) for k in (ID, LAT, LON))
            keys, values, counts = _dense_tags(got.get(DENSE_TAGS, b""), len(ids))
            parts.append(table("node", ids, lat, lon, None, None, keys, values, np.r_[0, np.cumsum(counts, dtype=np.int64)]))
            continue
        (keys, begin), (values, _) = (_lists([_bytes(got.get(k, b"")) for got in found]) for k in (KEYS, VALUES))
        ids = np.array([got[ID] for got in found], np.uint64)
        if key == WAY:
            refs, first = _lists([_bytes(got.get(REFS, b"")) for got in found])
            parts.append(table("way", ids.astype(np.int64), None, None, _sums(refs, first), first, keys, values, begin))
        else:
            lat, lon = (signed(np.array([got[k] for got in found], np.uint64)) for k in (LAT, LON))
            parts.append(table("node", signed(ids), lat, lon, None, None, keys, values, begin))
    return pa.Table.from_batches(parts, _ARROW).combine_chunks().to_batches()[0] if parts else pa.RecordBatch.from_pylist([], _ARROW)


def decoded(blob: bytes) -> list[tuple]:
    """``decoded_batch`` as rows; tags are pairs."""
    return [tuple(row.values()) for row in decoded_batch(blob).to_pylist()]


def blob_table(blobs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of SCHEMA of a column ``blob`` of data blobs, of the ``kinds`` asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch["blob"]:
                yield decoded_batch(blob.as_py(), kinds)

    return blobs.select("blob").mapInArrow(run, SCHEMA)


class Blobs(InputPartition):
    """Data blobs of one file: places and sizes."""

    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return system, name


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], max(1, int(options.get("blobsPerPartition", 16)))

    def partitions(self) -> list[Blobs]:
        """Groups of data blobs: the headers alone are read, one seek a blob."""
        from pyarrow import fs

        system, name = _opened(self.path)
        found = [system.get_file_info(name)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.path.endswith(".pbf")]
        out = []
        for info in sorted(found, key=lambda f: f.path):
            with system.open_input_file(info.path) as file:
                spans, at = [], 0
                while at < info.size:
                    file.seek(at)
                    size = struct.unpack(">i", file.read(4))[0]
                    header = dict(fields(file.read(size)))
                    at += 4 + size
                    if header[BLOB_TYPE] == b"OSMData":
                        spans.append((at, header[BLOB_SIZE]))
                    at += header[BLOB_SIZE]
            out += [Blobs(info.path, spans[k : k + self.each]) for k in range(0, len(spans), self.each)]
        return out

    def read(self, partition: Blobs | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no blobs at all
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as file:
            for at, size in partition.spans:
                file.seek(at)
                yield decoded_batch(file.read(size))


class PbfSource(DataSource):
    """spark.read.format("osmpbf").load(path): rows of SCHEMA, a task for every ``blobsPerPartition`` blobs of a file or folder."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)


def read_pbf(spark: SparkSession, path: str, blobs_per_partition: int = 16) -> DataFrame:
    """Nodes and ways of map files (SCHEMA). Empty files have no rows."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osmpbf").option("blobsPerPartition", blobs_per_partition).load(path)


def map_nodes(rows: DataFrame) -> DataFrame:
    """node_id, lat, lon, tags of the nodes whose place is on the globe, as ``readers.read_osm_nodes`` has them."""
    return rows.where("kind = 'node' and abs(lat) <= 90 and abs(lon) <= 180").select(F.col("id").alias("node_id"), "lat", "lon", "tags")


def map_ways(rows: DataFrame) -> DataFrame:
    """way_id, nodes, tags of the ways of two nodes or more, as ``readers.read_osm_ways`` has them; ``readers.way_edges`` makes edges of both."""
    return rows.where("kind = 'way' and size(nodes) >= 2").select(F.col("id").alias("way_id"), "nodes", "tags")


# ---- writing

def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def _zigzag(x: int) -> int:
    return 2 * x if x >= 0 else -2 * x - 1


def _field(key: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(key << 3) + _varint(value)
    return _varint(key << 3 | 2) + _varint(len(value)) + value


def _written(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of all values, as one array of bytes, and where each ends."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> np.uint64(7 * k) != 0
    ends = np.cumsum(size)
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        low = (values[own] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[own] - size[own] + k] = low | np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def _differences(values: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Packed differences of each of many lists, whose values begin there in one array and end with the next."""
    step = np.diff(values, prepend=0)
    first = begin[:-1][begin[:-1] < begin[1:]]
    step[first] = values[first]
    data, ends = _written(((step << 1) ^ (step >> 63)).view(np.uint64))
    data, cut = data.tobytes(), np.r_[0, ends][begin].tolist()
    return [data[a:z] for a, z in zip(cut, cut[1:])]


def _blob(nodes: tuple, ways: tuple) -> bytes:
    """A data blob of columns: ids, lats, lons and tags of nodes, and ids, refs, where those of each way begin, and tags of ways; tags are lists of pairs."""
    strings: dict[str, int] = {"": 0}
    number = lambda s: strings.setdefault(s, len(strings))
    groups = []
    ids, lat, lon, tags = nodes
    if len(ids):
        marks = b"".join(b"".join(_varint(number(k)) + _varint(number(v)) for k, v in own) + b"\0" for own in tags)
        whole = [np.asarray(ids, np.int64), *(np.rint(np.asarray(x, float) * 1e7).astype(np.int64) for x in (lat, lon))]
        dense = b"".join(_field(k, _differences(x, np.array([0, len(x)]))[0]) for k, x in zip((ID, LAT, LON), whole))
        groups.append(_field(GROUP, _field(DENSE, dense + _field(DENSE_TAGS, marks))))
    ids, refs, begin, tags = ways
    for i, own, packed in zip(ids, tags, _differences(refs, begin)):
        keys, values = (b"".join([_varint(number(x[side])) for x in own]) for side in (0, 1))
        groups.append(_field(GROUP, _field(WAY, _field(ID, i) + _field(KEYS, keys) + _field(VALUES, values) + _field(REFS, packed))))
    table = _field(STRINGS, b"".join(_field(1, s.encode()) for s in strings))
    data = table + b"".join(groups)
    return _field(2, len(data)) + _field(PACKED, zlib.compress(data))


def encoded(nodes: list[tuple] = (), ways: list[tuple] = ()) -> bytes:
    """A data blob of nodes (id, lat, lon, tags), written densely, and ways (id, refs, tags)."""
    pairs = lambda rows: [list(tags.items()) for *_, tags in rows]
    refs = np.array([x for _, own, _ in ways for x in own], np.int64)
    begin = np.r_[0, np.cumsum([len(own) for _, own, _ in ways], dtype=np.int64)]
    return _blob((*([n[c] for n in nodes] for c in range(3)), pairs(nodes)), ([i for i, *_ in ways], refs, begin, pairs(ways)))


def framed(blob: bytes, kind: bytes = b"OSMData") -> bytes:
    """A blob as it stands in a file, after its header."""
    header = _field(BLOB_TYPE, kind) + _field(BLOB_SIZE, len(blob))
    return struct.pack(">i", len(header)) + header + blob


def table_blobs(rows: DataFrame, each: int = 8000) -> DataFrame:
    """``blob``: the rows of SCHEMA as data blobs of up to ``each`` nodes or ways."""

    def pick(batch: pa.RecordBatch, kind: str) -> dict:
        own = batch.filter(pc.equal(batch["kind"], kind))
        # taken anew, so that lists and tags begin at the first value, and none belong to a null
        tags, refs = own["tags"].cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), own["nodes"]
        bounds = lambda x: np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
        entries = pc.list_flatten(tags)
        pairs = list(zip(*(entries.field(c).to_pylist() for c in (0, 1))))
        of = bounds(tags).tolist()
        place = {c: own[c].to_numpy(zero_copy_only=False) for c in ("lat", "lon")}
        return place | {"id": own["id"].to_pylist(), "refs": pc.list_flatten(refs).to_numpy(zero_copy_only=False), "begin": bounds(refs), "tags": [pairs[a:z] for a, z in zip(of, of[1:])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, each):
                own = batch.slice(k, each)
                n, w = pick(own, "node"), pick(own, "way")
                out.append(_blob((n["id"], n["lat"], n["lon"], n["tags"]), (w["id"], w["refs"].astype(np.int64), w["begin"], w["tags"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["blob"])

    return rows.select(*(f.name for f in _ARROW)).mapInArrow(run, "blob binary")
