"""Removal of repeated byte strings: suffix buckets refined at later offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.llm.common import Polynomial, dropped, key_of, mixed, repeated, splitmix, with_nulls, written

#: Words of the grams that passages counted in words are filed under.
WORD_GRAM = 8
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])

#: Bytes of the initial buckets, and offsets that share one refinement bucket.
GRAM, STEP = 32, 128
#: Bytes of kept text after which a batch of results is sent on, so that memory doesn't grow with the batch.
HELD = 1 << 22
_ROW = "doc_id long, text_key long, at int, low int, high int, core long, hull long, whole boolean"


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by block prefixes and suffixes."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Buckets:
    """Fingerprints that name buckets: equal strings get equal names on every executor, without a global sort."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, max(1, length // 2))
        self.step = min(STEP, max(1, length // 2))
        self.grams, self.longer = Polynomial(31), Polynomial(47)
        self.salt = splitmix(2, 59)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, first start, last start), and the prefix sums: each run of starts whose string has its least q-gram at one position.

        The least q-gram of a string depends on the string alone, so equal strings have it at equal offsets.
        """
        n = len(data) - self.gram + 1
        sums, at = self.grams.sums(data), np.arange(n)
        names = mixed(self.grams.ranges(sums, at, at + self.gram))
        order = (names & ~np.uint64(2**31 - 1)) | at.astype(np.uint64)
        least = (window_least(order, self.length - self.gram + 1) & np.uint64(2**31 - 1)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        return least[begin], begin, np.r_[begin[1:] - 1, len(least) - 1], sums

    def named(self, sums: np.ndarray, short: np.ndarray, start, end) -> np.ndarray:
        """Names by two polynomials of different bases and keys, so that what one confuses the other tells apart."""
        return mixed(self.longer.ranges(sums, start, end)) + self.grams.ranges(short, start, end)

    def steps(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(at, low, high, core, hull, whether it is whole) for each anchor and range of offsets before it.

        core names what all strings of the range have in common, hull what they cover
        together. A unique core: none of them repeats. A repeated hull: all of them do.
        """
        at, begin, end, short = self.anchors(data)
        low, high = at - end, at - begin
        first, each = low // self.step, high // self.step - low // self.step + 1
        pick = np.repeat(np.arange(len(at)), each)
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[pick]
        at, low, high = at[pick], np.maximum(low[pick], step * self.step), np.minimum(high[pick], (step + 1) * self.step - 1)
        sums, a, tag = self.longer.sums(data), at - step * self.step, (step + 1).astype(np.uint64)
        core = mixed(self.named(sums, short, a, a + self.length - self.step + 1) ^ (self.salt[0] * tag))
        left, right = a - self.step + 1, a + self.length
        whole = (left >= 0) & (right <= len(data))  # else the hull isn't in the text, and names nothing
        hull = mixed(self.named(sums, short, np.maximum(left, 0), np.minimum(right, len(data))) ^ (self.salt[1] * tag))
        return at, low, high, core.astype(np.int64), hull.astype(np.int64), whole

    def strings(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return mixed(self.named(self.longer.sums(data), self.grams.sums(data), starts, starts + self.length)).astype(np.int64)


def _frame(columns: str, parts: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in columns.split(", ")]
    return pd.DataFrame({k: np.concatenate(x) for k, x in zip(names, zip(*parts))} if parts else {k: [] for k in names})


def _first(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(length)
        with np.errstate(over="ignore"):
            for batch in batches:
                parts, held = [], 0
                for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                    raw = _bytes(text)
                    if len(raw) < length:
                        continue
                    found = buckets.steps(np.frombuffer(raw, np.uint8))
                    n = len(found[0])
                    parts.append((np.full(n, doc_id, np.int64), np.full(n, key, np.int64), *[x.astype(np.int32) for x in found[:3]], *found[3:]))
                    held += n
                    if held > 100_000:
                        yield _frame(_ROW, parts)
                        parts, held = [], 0
                if parts:
                    yield _frame(_ROW, parts)

    return run


_NAME = "name long, doc_id long, text_key long, start int, open boolean"


def _strings(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(length)
        with np.errstate(over="ignore"):
            for batch in batches:
                parts, held = [], 0
                for doc_id, key, text, spans in zip(batch["doc_id"], batch["text_key"], batch["text"], batch["spans"]):
                    raw = _bytes(text)
                    starts = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
                    mine = np.concatenate([np.full(s["last"] + 1 - s["first"], s["open"]) for s in spans])
                    n = len(starts)
                    parts.append((buckets.strings(np.frombuffer(raw, np.uint8), starts), np.full(n, doc_id, np.int64), np.full(n, key, np.int64), starts.astype(np.int32), mine))
                    held += n
                    if held > 100_000:
                        yield _frame(_NAME, parts)
                        parts, held = [], 0
                if parts:
                    yield _frame(_NAME, parts)

    return run


class Passages:
    """Fingerprints of strings of ``words`` words, whatever white space stands between them."""

    def __init__(self, words: int):
        self.words, self.gram = words, min(WORD_GRAM, words)
        self.letters, self.order = Polynomial(71), Polynomial(83)

    def sums(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and prefix sums of the fingerprints of the words."""
        data = np.frombuffer(raw, np.uint8)
        edge = np.diff(np.r_[True, _SPACE[data], True].astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        names = mixed(self.letters.ranges(self.letters.sums(data), begin, end) + (end - begin).astype(np.uint64))
        self.order._grow(len(names) + 1)
        return begin, end, np.r_[np.uint64(0), np.cumsum(names * self.order.up[: len(names)])]

    def anchors(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first, last): each run of starts, in words, whose passage has its least gram at one place."""
        at = np.arange(len(sums) - self.gram)
        names = mixed(self.order.ranges(sums, at, at + self.gram))
        order = (names & ~np.uint64(2**31 - 1)) | at.astype(np.uint64)
        least = (window_least(order, self.words - self.gram + 1) & np.uint64(2**31 - 1)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        return names[least[begin]].astype(np.int64), begin, np.r_[begin[1:] - 1, len(least) - 1]

    def passages(self, sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return mixed(self.order.ranges(sums, starts, starts + self.words)).astype(np.int64)


_ANCHOR = "name long, doc_id long, text_key long, first int, last int"


def _anchored(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Passages(words)
        with np.errstate(over="ignore"):
            for batch in batches:
                parts, held = [], 0
                for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                    raw = _bytes(text)
                    if len(raw) < 2 * words - 1:
                        continue
                    _, _, sums = kernel.sums(raw)
                    if len(sums) <= words:
                        continue
                    name, first, last = kernel.anchors(sums)
                    n = len(name)
                    parts.append((name, np.full(n, doc_id, np.int64), np.full(n, key, np.int64), first.astype(np.int32), last.astype(np.int32)))
                    held += n
                    if held > 100_000:
                        yield _frame(_ANCHOR, parts)
                        parts, held = [], 0
                if parts:
                    yield _frame(_ANCHOR, parts)

    return run


def _passages(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Passages(words)
        with np.errstate(over="ignore"):
            for batch in batches:
                parts, held = [], 0
                for doc_id, key, text, spans in zip(batch["doc_id"], batch["text_key"], batch["text"], batch["spans"]):
                    raw = _bytes(text)
                    begin, end, sums = kernel.sums(raw)
                    starts = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
                    n = len(starts)
                    parts.append((kernel.passages(sums, starts), np.full(n, doc_id, np.int64), np.full(n, key, np.int64), begin[starts].astype(np.int32), end[starts + words - 1].astype(np.int32)))
                    held += n
                    if held > 100_000:
                        yield _frame(_ANCHOR, parts)
                        parts, held = [], 0
                if parts:
                    yield _frame(_ANCHOR, parts)

    return run


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): null is an empty text; text_key tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(key_of().alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _asked(narrow: DataFrame, spans: DataFrame, fields: list[str]) -> DataFrame:
    """Texts with the spans asked of them, each once; a text without any is left out."""
    mine = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*fields)).alias("spans"))  # of one document
    return narrow.join(mine, ["doc_id", "text_key"])


def repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, first, last): bytes [first, last) of passages of ``words`` words that also stand elsewhere.

    The same refinement over words: a passage is filed under its least gram of WORD_GRAM
    words (its initial bucket), so equal passages are filed alike; only passages whose bucket
    repeats are named and counted themselves.
    """
    narrow = _narrow(docs)
    rows = written(narrow.mapInPandas(_anchored(words), _ANCHOR), "anchors")
    live = written(repeated(rows, "name").where("again").select("doc_id", "text_key", "first", "last"), "live")
    dropped(rows)
    named = written(_asked(narrow, live, ["first", "last"]).mapInPandas(_passages(words), _ANCHOR), "passages")
    out = written(repeated(named, "name").where("again").select("doc_id", "text_key", "first", "last").distinct(), "repeats")
    dropped(live, named)
    return out


_COUNTS = "n_bytes long, n_removed long, n_spans long"


def _runs(spans) -> list[list[int]]:
    """Disjoint runs [first, last) that the spans cover together, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(decoded: bool, carried: list[str]):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, spans, *rest in zip(batch["doc_id"], batch["text"], batch["spans"], *[batch[c] for c in carried]):
                raw = _bytes(text)
                runs = _runs(spans)
                kept, end = [], 0
                for a, b in runs:
                    kept.append(raw[end:a])
                    end = b
                kept = b"".join([*kept, raw[end:]])
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(runs), kept.decode("utf-8", "ignore") if decoded else kept, *rest))
                held += len(kept)
                if held > HELD:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return run


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, text_key, first, last): starts of strings of ``length`` bytes that also start elsewhere.

    Bucket-pointer refinement on a sparse suffix array. Every string is filed under its least
    q-gram (initial buckets, one suffix in about a hundred). Buckets are refined by the names
    of longer strings at fixed offsets from that q-gram: first the core of STEP neighbouring
    starts, then their hull, and only where the core repeats and the hull doesn't, the strings
    themselves; names found in one round are used in the next, and what is alone in its bucket
    leaves. Bucket names are 64-bit fingerprints under the q-gram's own, by two polynomials,
    as ranks would need a global sort. Names are counted with map-side combining and joined
    back by ``repeated``, which takes hot passages out of the shuffle. Of equal hulls one
    stands for all. A table that nothing reads again is deleted at once.
    """
    narrow = _narrow(docs)
    rows = written(narrow.mapInPandas(_first(length), _ROW), "buckets")
    cores = written(repeated(rows, "core").where("again").drop("again"), "cores")
    dropped(rows)
    cores = cores.withColumn("hull", F.when(F.col("whole"), F.col("hull")))
    hulls = written(repeated(cores, "hull").drop("whole"), "hulls")
    settled = hulls.where("again").select("doc_id", "text_key", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    open_ = hulls.where("again is null")
    others = hulls.where("again").groupBy("core", "hull").agg(F.min(F.struct("doc_id", "text_key", "at", "low", "high")).alias("r"))
    others = others.join(open_.select("core").distinct(), "core", "left_semi").select("r.*", F.lit(False).alias("open"))
    asked = open_.select("doc_id", "text_key", "at", "low", "high", F.lit(True).alias("open")).unionByName(others)
    asked = asked.select("doc_id", "text_key", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"), "open")
    names = written(_asked(narrow, asked, ["first", "last", "open"]).mapInPandas(_strings(length), _NAME), "strings")
    found = repeated(names, "name").where("again and open").select("doc_id", "text_key", F.col("start").alias("first"), F.col("start").alias("last"))
    out = written(settled.unionByName(found).distinct(), "spans")
    dropped(hulls, names)
    return out


def cut_repeats(docs: DataFrame, length: int | None = 400, decoded: bool = False, words: int | None = None, carry: list[str] = ()) -> DataFrame:
    """Documents without the bytes that a repeated string of ``length`` bytes covers; one row per input row.

    With ``words``, repeated passages of so many words go too, however few bytes they have;
    ``length`` None leaves those alone to go.
    doc_id, n_bytes, n_removed, n_spans, kept (binary; ``decoded``: a string, without the
    bytes of characters that a cut has split, made in the same Python pass), then the columns
    of ``carry``. Strings are judged on the input: all occurrences go, the first one too, overlaps included. Null is an empty
    text; texts under ``length`` bytes (``words`` words) stay whole; a row that repeats makes
    its own text repeated; an empty table gives an empty result. One document's spans are
    gathered in one task, with its text. Null doc_ids stay null.
    """
    keys = ["doc_id", "text_key"]
    gathered = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct("first", "last")).alias(name))
    spans = [repeated_words(docs, words)] if words else []
    if length:
        spans.append(repeated_spans(docs, length).withColumn("last", F.col("last") + length))
    both = spans[0] if len(spans) == 1 else spans[0].unionByName(spans[1])
    narrow = docs.select(key_of().alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    out = narrow.join(gathered(both, "spans"), keys, "left")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", _COUNTS, f"kept {'string' if decoded else 'binary'}", *[f"`carried_{c}` {kinds[c]}" for c in carry]])
    out = out.mapInPandas(_cut(decoded, [f"carried_{c}" for c in carry]), schema)
    return with_nulls(out, "doc_id").withColumnsRenamed({f"carried_{c}": c for c in carry})
