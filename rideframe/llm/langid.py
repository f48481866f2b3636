"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rideframe.llm.common import join_small, key_of, with_nulls, written

BINS = 1 << 15
#: Rows of the sample that the text model is fitted on, in equal parts per language, of which each has LANGUAGE_ROWS at least.
SAMPLE_ROWS = 2000
LANGUAGE_ROWS = 50
#: Stands for every language that the model doesn't know.
UNKNOWN = "und"
#: Trigrams of a text that count as independent evidence, at most.
EVIDENCE = 60.0


def trigram_bins(text: str) -> np.ndarray:
    """Hash bins of the letter trigrams of every word, in lower case, with its borders."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    letter = (points >= 0x61) & (points <= 0x7A) | (points >= 0xC0)
    flat = np.where(letter, points, np.uint32(0x20))
    flat = np.r_[np.uint32(0x20), flat, np.uint32(0x20)]
    x = flat[:-2] * np.uint32(0x9E3779B1) ^ flat[1:-1] * np.uint32(0x85EBCA77) ^ flat[2:] * np.uint32(0xC2B2AE3D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((x ^ (x >> np.uint32(13))) & np.uint32(BINS - 1))[letter[: len(points)]]


class TextModel:
    """Multinomial trigram model: log likelihoods per language.

    Trigrams that a language lacks share a twentieth of its mass at most, so that one of few
    rows doesn't tell every text by chance. UNKNOWN, the last of the languages, spreads its
    trigrams evenly over the bins: a text that every language tells worse than that is in none
    of them, or noise. Where the fitted trigrams are few against the bins, unseen ones tell
    little, and UNKNOWN is the less likely.
    """

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + 0.05 * np.clip(counts.sum(axis=1, keepdims=True) / BINS, 1 / BINS, 1.0)
        chance = -np.log(BINS) - np.log1p(BINS / max(1.0, counts.sum()))
        self.logs = np.vstack([np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.full((1, BINS), chance)]).T.copy()

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        bins = trigram_bins(text)
        if not len(bins):
            return 0, np.zeros(len(self.languages))
        return len(bins), self.logs[bins].mean(axis=0) * min(len(bins), EVIDENCE)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            counts = sum(np.bincount(trigram_bins(x), minlength=BINS) for x in texts)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": counts[at]})


def fit_text_model(docs: DataFrame, rows: int = SAMPLE_ROWS) -> TextModel:
    """Fit on the labelled documents of least hash in each language: a bounded sample, the same on every run.

    The driver gets the sample's trigram counts, at most BINS numbers a language, and no texts.

    The languages are those of all labelled rows, however rare. Rows over the hash threshold
    of their language, which leaves twice its part on average, stay on the executors.
    """
    labelled = docs.where(f"lang is not null and text is not null and lang <> '' and lang <> '{UNKNOWN}'")
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    counts = labelled.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return TextModel([], np.zeros((0, BINS)))
    part = max(LANGUAGE_ROWS, rows // len(counts))
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 2 * part / r["count"]) * (1 << 40)))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = labelled.where(F.col("h") < F.element_at(limits, F.col("lang"))).withColumn("place", place).where(F.col("place") <= part)
    found = sample.select("lang", "text").mapInPandas(_counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r["lang"] for r in counts)
    table = np.zeros((len(languages), BINS))
    table[np.searchsorted(languages, found["lang"]), found["bin"]] = found["n"]
    return TextModel(languages, table)


def _evidence(model: TextModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model(x) for x in batch["text"]]
            logs = np.array([x for _, x in found]).reshape(len(found), -1)
            batch["n_trigrams"] = [n for n, _ in found]
            for i in range(len(model.languages)):
                batch[f"t{i}"] = logs[:, i]
            yield batch.drop(columns="text")

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def markup_language(html: Column) -> Column:
    """Primary tag of the language that the html element declares."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))


def address_language(url: Column) -> Column:
    """A two-letter first path element, or else the last label of the host."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"//[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return F.when(path != "", path).otherwise(F.element_at(F.split(host_of(url), r"\."), -1))


def identify_languages(docs: DataFrame, model: TextModel, declared: Column, address: Column, levels: list[Column], least: float = 0.5, strength: float = 20.0) -> DataFrame:
    """doc_id, text_key, lang, posterior, declared, n_trigrams, kept; one row per input row; text_key tells rows of one id apart.

    log posterior = log prior of the host + log P(declared | language) + log P(address
    suffix | language) + text log likelihood, normalised. ``levels`` names the host from
    coarse to fine; the prior of each level is its counts (languages by text alone, from a
    grouped aggregate over all rows) smoothed by ``strength`` rows of the level above. The
    tables of markup and address evidence come from the same counts, smoothed towards the
    value that names the language itself. Values that name no language of the model, and
    nulls, are evidence of their own kind ('other', 'none').

    UNKNOWN is fused like any language. kept is false if it is the likeliest, if the text has
    no letters or if the posterior is under ``least``; without labelled rows nothing is kept.
    Null texts are empty. Rows that repeat get equal results; an empty table gives an empty
    result. A very long text is read whole in one task.
    """
    langs = model.languages
    known = F.array(*[F.lit(x) for x in langs])
    value = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").when(F.array_contains(known, F.lower(c)), F.lower(c)).otherwise("other")
    names = [f"k{i}" for i in range(len(levels))]
    rows = docs.select(key_of().alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), value(declared).alias("declared"), value(address).alias("address"), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for c, k in zip(levels, names)], F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(["doc_id long", "text_key long", "declared string", "address string", *[f"{k} string" for k in names], "n_trigrams long", *[f"t{i} double" for i in range(len(langs))]])
    rows = rows.mapInPandas(_evidence(model), schema)
    best = F.greatest(*[F.col(f"t{i}") for i in range(len(langs))]) if len(langs) > 1 else F.col("t0")
    first = F.lit(None).cast("int")
    for i in reversed(range(len(langs))):
        first = F.when(F.col(f"t{i}") == best, i).otherwise(first)
    rows = written(rows.withColumn("by_text", F.when(F.col("n_trigrams") > 0, first)), "evidence")

    n = [F.sum(F.when(F.col("by_text") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(langs))]
    total = sum((F.col(f"n{i}") for i in range(1, len(langs))), F.col("n0"))
    prior = rows.agg(*n).select(*[((F.coalesce(f"n{i}", F.lit(0)) + 1.0) / (F.coalesce(total, F.lit(0)) + float(len(langs)))).alias(f"p{i}") for i in range(len(langs))])
    above: list[str] = []
    for k in range(len(levels)):
        keys = names[: k + 1]
        counts = rows.groupBy(*keys).agg(*n)
        counts = counts.join(prior, above) if above else counts.crossJoin(F.broadcast(prior))  # prior: one row here
        prior = written(counts.select(*keys, *[((F.col(f"n{i}") + strength * F.col(f"p{i}")) / (total + strength)).alias(f"p{i}") for i in range(len(langs))]), f"prior{k}")
        above = keys
    out = join_small(rows, prior, above) if above else rows.crossJoin(F.broadcast(prior))

    def table(column: str) -> list[Column]:
        """log P(value | language) for each language, as literal lookups: languages + 2 values."""
        found = {(r[column], r["by_text"]): r["count"] for r in rows.where("by_text is not null").groupBy(column, "by_text").count().collect()}
        values = [*langs, "other", "none"]
        logs = []
        for i, lang in enumerate(langs):
            c = np.array([found.get((v, i), 0) + (5.0 if v == lang else 1.0) for v in values])
            logs.append(F.element_at(F.create_map(*[F.lit(x) for pair in zip(values, np.log(c / c.sum()).tolist()) for x in pair]), F.col(column)))
        return logs

    mark, suffix = table("declared"), table("address")
    out = out.withColumns({f"s{i}": F.log(F.col(f"p{i}")) + mark[i] + suffix[i] + F.col(f"t{i}") for i in range(len(langs))})
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(langs))]) if len(langs) > 1 else F.col("s0")
    mass = sum((F.exp(F.col(f"s{i}") - F.col("top")) for i in range(1, len(langs))), F.exp(F.col("s0") - F.col("top")))
    name = F.lit(None).cast("string")
    for i in reversed(range(len(langs))):
        name = F.when(F.col(f"s{i}") == F.col("top"), langs[i]).otherwise(name)
    out = out.withColumn("top", top).select("doc_id", "text_key", name.alias("lang"), (1.0 / mass).alias("posterior"), "declared", "n_trigrams")
    return with_nulls(out, "doc_id").withColumn("kept", (F.col("n_trigrams") > 0) & (F.col("lang") != UNKNOWN) & (F.col("posterior") >= least))
