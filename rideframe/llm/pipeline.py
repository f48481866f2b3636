"""A corpus pipeline over five of the text operators; every stage works on all that the stage before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty
tables: a null text is an empty one, a null id becomes a negative one made from the text, rows
of one id that differ in text are documents of their own, and an empty table stays empty.
Further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rideframe.llm import jaccard, mixing, packing, substrings
from rideframe.llm.common import dropped, written
from rideframe.llm.queries import identified

#: Repeated strings of so many bytes go, and repeated passages of over 50 words, however few bytes they have.
PASSAGE_BYTES, PASSAGE_WORDS = 400, 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def with_ids(docs: DataFrame) -> DataFrame:
    """A document without an id gets a negative one from its text."""
    made = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    return docs.withColumn("doc_id", F.coalesce("doc_id", made))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told go on, with that language; the others go. Repeated rows all go on."""
    docs = with_ids(docs).withColumn("text_key", text_key())
    found = identified(spark, docs).where("kept").select("doc_id", "text_key", F.col("lang").alias("told")).dropDuplicates(["doc_id", "text_key"])
    return docs.join(found, ["doc_id", "text_key"]).withColumn("lang", F.col("told")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stands for its class (the least id) stays, once."""
    docs = with_ids(docs).withColumn("text_key", text_key())
    found = jaccard.jaccard_classes(docs).where("doc_id = class_id and text_key = class_key").select("doc_id", "text_key").distinct()
    return docs.join(found, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE_BYTES bytes, and the passages of PASSAGE_WORDS words, that also stand elsewhere; all documents go on."""
    cut = substrings.cut_repeats(with_ids(docs), length=PASSAGE_BYTES, words=PASSAGE_WORDS, decoded=True, carry=["lang", "source"])
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, however long; a row that repeats adds its copies to the first."""
    docs = with_ids(docs)
    mix = mixing.mix_sources(docs).where("copies > 0").groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"))
    texts = docs.withColumn("tie", F.xxhash64("text")).dropDuplicates(["doc_id", "tie"])
    return texts.join(mix, ["doc_id", "tie"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document in sequences of 2048 tokens; repeated rows are packed once each, and long texts are cut into pieces."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed),
]

#: Tokens, similarity classes and repeated strings are beyond SQL on whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
