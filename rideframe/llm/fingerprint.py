"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import key_of, with_nulls, written

#: A term is a word, cut every 16 code points.
TERM = r"[^\x20\x09-\x0D]{1,16}"
LANE = 4
DIGITS = 6


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift) if shift else bits
    return (part.bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) / F.lit(float(1 << width))


def _sample(lane: Column, j: int) -> tuple[Column, Column, Column]:
    """Gamma(2, 1) scale, log of a Gamma(2, 1) rank and uniform shift of a term for sample LANE * lane + j."""
    one = F.xxhash64("term", lane * LANE + F.lit(j))
    two = F.xxhash64(one)
    scale = -F.log(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    rank = F.log(-F.log(_uniform(two, 0, 21) * _uniform(two, 21, 21)))
    return scale, rank, _uniform(two, 42, 21)


def weighted_samples(df: DataFrame, keys: list[str], texts: list[str], samples: int) -> DataFrame:
    """keys and one fingerprint column per text column: hex components of DIGITS digits, one per sample.

    Ioffe's scheme: with weight w, t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the
    term of least a and its t are the sample. Two texts agree in a sample with probability
    sum(min weights) / sum(max weights). A term's weight is its count times the square of its
    length: long words tell texts apart, and no corpus statistics are needed. ``df`` must have
    one row per key and be hash partitioned by a key column, so that terms are counted where
    the text is. Samples are taken LANE at a time, which keeps the generated code small enough
    for the just-in-time compiler; the sampled value rides in the low bits of a long that
    orders by ln a, so a plain min() picks it.
    """
    lists = df.select(*keys, *[F.regexp_extract_all(c, F.lit(TERM), F.lit(0)).alias(f"l{i}") for i, c in enumerate(texts)])
    sizes = [F.size(f"l{i}") for i in range(len(texts))]
    # below the explode, or the sizes would be taken again for every word
    lists = lists.select(*keys, F.array(*[sum(sizes[1 : i + 1], sizes[0]) for i in range(len(texts))]).alias("ends"), F.concat(*[f"l{i}" for i in range(len(texts))]).alias("words"))
    words = lists.select(*keys, "ends", F.posexplode_outer("words").alias("pos", "word"))
    inside = [(F.col("pos") < F.col("ends")[i]) & (F.col("pos") >= (F.col("ends")[i - 1] if i else F.lit(0))) for i in range(len(texts))]
    terms = words.select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"), F.length("word").alias("size"), *[F.when(x, 1).otherwise(0).alias(f"c{i}") for i, x in enumerate(inside)])
    terms = terms.groupBy(*keys, "term").agg(F.max("size").alias("size"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(texts))])
    logs = terms.select(*keys, "term", *[F.when(F.col(f"c{i}") > 0, F.log(F.col(f"c{i}") * F.col("size") * F.col("size"))).alias(f"w{i}") for i in range(len(texts))], F.explode(F.sequence(F.lit(0), F.lit(samples // LANE - 1))).alias("lane"))
    for j in range(LANE):
        scale, rank, shift = _sample(F.col("lane"), j)
        logs = logs.withColumns({f"r{j}": scale, f"l{j}": rank, f"b{j}": shift})
    least = []
    for i in range(len(texts)):
        for j in range(LANE):
            t = F.floor(F.col(f"w{i}") / F.col(f"r{j}") + F.col(f"b{j}"))
            order = F.floor((F.col(f"l{j}") - F.col(f"r{j}") * (t - F.col(f"b{j}") + 1) + 1000) * F.lit(float(1 << 28)))
            value = F.xxhash64("term", t).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))
            least.append(F.min(F.when(F.col(f"w{i}").isNotNull(), F.shiftleft(order, 4 * DIGITS).bitwiseOR(value))).alias(f"m{i}_{j}"))
    lanes = logs.groupBy(*keys, "lane").agg(*least)
    digits = lambda c: F.coalesce(F.lower(F.lpad(F.hex(F.col(c).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0")), F.lit("0" * DIGITS))
    parts = lanes.select(*keys, "lane", *[F.concat(*[digits(f"m{i}_{j}") for j in range(LANE)]).alias(f"p{i}") for i in range(len(texts))])
    joined = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lane", f"p{i}"))), lambda x: x[f"p{i}"]), "")
    return parts.groupBy(*keys).agg(*[joined(i).alias(f"{c}_fingerprint") for i, c in enumerate(texts)])


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples of two fingerprints: an estimate of generalised Jaccard similarity."""
    at = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: at(a, i) == at(b, i))) / F.lit(float(samples))


def ring(keys: DataFrame, rows: int) -> DataFrame:
    """(doc_id, h) -> (next_id, next_h): the next lower key, the first after the last.

    Keys are dealt by range into parts of about ``rows``, ordered inside each; only the first
    key of each part takes part in the global order.
    """
    parts = max(1, math.ceil(keys.count() / rows))
    dealt = written(keys.repartitionByRange(parts, F.col("doc_id").desc(), F.col("h").desc()).withColumn("part", F.spark_partition_id()), "ring")
    order = [F.col("doc_id").desc(), F.col("h").desc()]
    inner = dealt.withColumn("next", F.lead(F.struct("doc_id", "h")).over(Window.partitionBy("part").orderBy(*order)))
    heads = dealt.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    over = Window.orderBy(F.col("head").desc())
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    out = inner.join(F.broadcast(heads), "part")  # one row per `rows` keys
    return out.select("doc_id", "h", "n_chars", F.coalesce("next", "after").alias("next")).select("doc_id", "h", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def edited_fingerprints(docs: DataFrame, samples: int = 32, ring_rows: int = 100_000) -> DataFrame:
    """Fingerprints of every text and of its edited text; one row per input row.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last floor(n / 3) code points replaced by the first as many of
    the document that follows by descending doc_id. Null is an empty text; a text without
    words has the fingerprint of no terms, and two of those are alike (1.0). Rows of one
    doc_id with different texts follow each other by hash; rows that repeat in full are
    fingerprinted once and returned as often as given. Null doc_ids come last. An empty table gives an empty result.
    A very long text is as many terms as it has, summed up before the shuffle.
    """
    rows = docs.select(key_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    keys = written(keys, "keys")
    after = written(ring(keys.drop("copies"), ring_rows), "after")
    needs = after.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"))
    texts = rows.join(needs, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    heads = texts.select(F.col("for_id").alias("doc_id"), F.col("for_h").alias("h"), F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("need").alias("cut"))
    edited = texts.select("doc_id", "h", "text").join(heads, ["doc_id", "h"])
    edited = edited.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("cut")), "head")).select("doc_id", "h", "text", "edited")
    prints = weighted_samples(edited.withColumn("sha", F.sha2(F.col("edited"), 256)), ["doc_id", "h", "sha"], ["text", "edited"], samples)
    prints = written(prints, "prints")
    out = prints.join(after, ["doc_id", "h"]).join(keys.select("doc_id", "h", "copies"), ["doc_id", "h"])
    other = prints.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("text_fingerprint").alias("next_fingerprint"))
    out = out.join(other, ["next_id", "next_h"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("text_fingerprint").alias("fingerprint"), "edited_fingerprint", likeness(F.col("text_fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("text_fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
    return with_nulls(out, "doc_id")
