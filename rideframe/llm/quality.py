"""Quality rules by tokeniser fertility, with rejection bands per language or script."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rideframe.llm.common import join_small, key_of, with_nulls, written

#: The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: First code points of the script classes; a text without a language is banded by its most frequent class.
SCRIPTS = [(0, "other"), (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "other"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]
#: Words whose encodings a worker remembers.
CACHE = 300_000

METRICS = {"chars_per_token": 1000, "fallback_share": 1000, "evenness": 1000}
#: Least reach of a band beyond its quartiles, in rounded units: a few pieces more or less never reject a text.
LEAST_REACH = {"chars_per_token": 10, "fallback_share": 40, "evenness": 5}
_MEASURED = "doc_id long, group string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_pieces long, chars_per_token double, fallback_share double, evenness double"


def tokenizer_folder() -> str:
    import public_tokenizers

    return public_tokenizers.path("").rstrip("/")


class _Fertility(dict):
    """word -> (ids in the byte-level vocabulary as uint32 bytes, pieces and byte fallbacks in the piece vocabulary)."""

    def __init__(self, folder: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.fallback = {i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i)}

    def __missing__(self, word: bytes) -> tuple[bytes, int, int]:
        text = word.decode("utf-8", "replace")
        pieces = self.pieces.encode(text)
        out = np.array(self.bpe.encode_ordinary(" " + text), "<u4").tobytes(), len(pieces), sum(map(self.fallback.__contains__, pieces))
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out


def repeat_words(words: list) -> int:
    """Words inside a 3-word window that the text has twice or more, first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(windows) == len(set(windows)):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = end = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def base_counts(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words of the text, then word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return words, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.searchsorted([x for x, _ in SCRIPTS], points, "right") - 1
    totals = Counter()
    for kind, n in enumerate(np.bincount(kinds, minlength=len(SCRIPTS))):
        totals[SCRIPTS[kind][1]] += int(n) * (SCRIPTS[kind][1] != "other")
    return min(totals.items(), key=lambda x: (-x[1], x[0]))[0] if text else "other"


def _measure(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Fertility(folder)
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                words, chars, symbols, lines, repeats = base_counts(text)
                seen = list(map(known.__getitem__, words))
                ids = np.frombuffer(b"".join(x[0] for x in seen), "<u4")
                pieces, fallbacks = sum(x[1] for x in seen), sum(x[2] for x in seen)
                entropy = 1.0
                if len(ids) > 1:
                    share = np.unique(ids, return_counts=True)[1] / len(ids)
                    entropy = float(-(share * np.log(share)).sum() / np.log(len(ids)))
                rows.append((doc_id, f"lang:{lang}" if lang else f"script:{script(text)}", len(words), chars, symbols, lines, repeats, len(ids), pieces, chars / max(1, len(ids)), fallbacks / max(1, pieces), entropy))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _MEASURED.split(", ")])

    return run


def measure(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Base counts and fertility metrics of every text; one row per input row.

    Every word is encoded alone, with a space before it, so an encoding is made once per
    distinct word and worker. evenness is the entropy of the token ids over its maximum for
    as many tokens (1 for up to one token). group is the declared language, or the script
    where none is declared. A null or empty text has no words and zeros.
    """
    columns = {c.lower() for c in docs.columns}
    lang = F.col("lang").cast("string") if "lang" in columns else F.lit(None).cast("string")
    narrow = docs.select(key_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    return narrow.mapInPandas(_measure(folder or tokenizer_folder()), _MEASURED)


def bands(measured: DataFrame, width: float, least: int) -> DataFrame:
    """Bands [q1 - width * iqr, q3 + width * iqr] per group, length class and metric, over all rows; they reach LEAST_REACH at least.

    Quartiles come from exact histograms of the rounded metrics, so reruns agree and a hot
    language is combined before the shuffle. A class of under ``least`` rows uses the band of
    all classes of its group, a group of under ``least`` rows that of all groups; where all
    rows are fewer there is no band and nothing is rejected.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m) * scale).cast("long").alias("value")) for m, scale in METRICS.items()]))
    long = measured.where("n_words > 0").select("group", "class", values.alias("m")).select("group", "class", "m.metric", "m.value")
    histogram = long.groupBy("group", "class", "metric", "value").agg(F.count("*").alias("n"))
    histogram = histogram.select(F.explode(F.array(*[F.struct(F.when(F.lit(a), F.col("group")).alias("group"), F.when(F.lit(b), F.col("class")).alias("class")) for a, b in ((True, True), (True, False), (False, False))])).alias("g"), "metric", "value", "n")
    histogram = histogram.groupBy("g.group", "g.class", "metric", "value").agg(F.sum("n").alias("n"))
    keys = ["group", "class", "metric"]
    w = Window.partitionBy(*keys)
    run = histogram.withColumns({"upto": F.sum("n").over(w.orderBy("value")), "all": F.sum("n").over(w)})
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("value")))
    found = run.groupBy(*keys).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("all").alias("all")).where(F.col("all") >= least)
    least_reach = F.element_at(F.create_map(*[F.lit(x) for pair in LEAST_REACH.items() for x in pair]), F.col("metric"))
    reach = F.greatest(F.lit(width) * (F.col("q3") - F.col("q1")), least_reach)
    return found.select(*keys, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def fertility_rules(docs: DataFrame, folder: str | None = None, width: float = 1.5, least: int = 50, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Verdict per document from base rules and tokeniser-fertility bands; one row per input row.

    doc_id, counts, metrics, base_failed, kept and reason ('base', or the metric that is out
    of its band, or null). Bands are fitted on the rows that pass the base rules, per language
    (or script) and length class (power of two of words). Null, empty and wordless texts fail
    the base rules; repeated rows get equal verdicts; an empty table gives an empty result. A
    very long text is measured whole in one task.
    """
    measured = measure(docs, folder).withColumn("class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    measured = written(measured.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))), "fertility")
    limits = written(bands(measured.where(~F.col("base_failed")), width, least), "bands")
    wide = limits.groupBy("group", "class").pivot("metric", list(METRICS)).agg(F.first(F.struct("low", "high")))
    levels = []
    for level, (a, b) in enumerate((("group is not null", "class is not null"), ("group is not null", "class is null"), ("group is null", "class is null"))):
        levels.append(wide.where(f"{a} and {b}").select("group", "class", *[F.col(m).alias(f"{m}_{level}") for m in METRICS]))
    out = join_small(measured, levels[0], ["group", "class"])
    out = join_small(out, levels[1].drop("class"), ["group"])
    out = out.join(F.broadcast(levels[2].drop("group", "class")), F.lit(True), "left")  # one row at most
    verdict = F.when(F.col("base_failed"), "base")
    for m, scale in METRICS.items():
        band = F.coalesce(*[F.col(f"{m}_{level}") for level in range(3)])
        verdict = verdict.when(~F.round(F.col(m) * scale).between(band["low"], band["high"]), m)
    out = out.withColumn("reason", verdict)
    return with_nulls(out, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), "reason", "group", "n_tokens", "n_pieces", *METRICS)
