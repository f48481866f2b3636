"""Token files, whitened embeddings and time partitions against plain versions, with every odd case."""

import glob
import hashlib
import random
import zlib
from datetime import datetime, timedelta
from fractions import Fraction

import brute
import numpy as np
import pyarrow.orc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rideframe.llm import chat, packing, pipeline, queries, sharding, timeparts, tokenfiles, whitening

DOCS = "doc_id long, text string, shard int, ids string"


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def local(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def test_token_files_equal_the_vocabulary(spark, encode):
    rng = random.Random(1)
    words = ["ab", "Straße", "漢字", "🙂", "x1", "\n", "  ", "<|endoftext|>", "don't"]
    docs = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), 1, "x") for i in range(200)]
    docs += [(601, "", 1, "x"), (602, None, None, None), (603, "long words " * 40_000, 1, "x")]
    rng.shuffle(docs)
    path = tokenfiles.write_token_files(spark.createDataFrame(docs, DOCS).repartition(5))
    got = {r.doc_id: r for r in tokenfiles.token_checksums(tokenfiles.read_token_files(spark, path)).collect()}
    at = 0
    for i, text, *_ in sorted(docs):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    whole = [i for r in tokenfiles.read_token_files(spark, path).orderBy("start").collect() for i in r.ids]
    assert len(whole) == at


def test_token_files_of_repeated_and_missing_ids(spark, encode):
    docs = spark.createDataFrame([(None, "b", 0, ""), (None, "a", 0, ""), (None, "a", 0, ""), (5, "c d", 0, ""), (5, "c d", 0, ""), (5, "e", 0, "")], DOCS)
    rows = tokenfiles.token_checksums(tokenfiles.read_token_files(spark, tokenfiles.write_token_files(docs))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, None, 5, 5, 5]
    assert [r.start for r in rows] == [0, 2, 4, *np.cumsum([6, rows[3].n_tokens, rows[4].n_tokens]).tolist()]
    assert tokenfiles.read_token_files(spark, tokenfiles.write_token_files(docs.limit(0))).count() == 0


def scanned(df):
    """Rows that the file scan of a collected frame put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_token_files_are_pruned_by_index_and_bloom_filter(spark):
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = tokenfiles.write_token_files(docs, stripe_bytes=1 << 16)
    files = sorted(glob.glob(local(path) + "/*.orc"))
    assert max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1  # stripes are read in parallel
    rows = spark.read.schema(tokenfiles.SCHEMA).orc(path)
    assert scanned(rows) == 20_000
    assert 0 < scanned(rows.where("doc_id = 20000")) <= 2000  # the row index
    assert sum(scanned(rows.where(f"doc_id = {k}")) > 0 for k in range(1001, 1061, 2)) <= 3  # ids within the ranges that no document has
    assert rows.where("doc_id = 20000").collect()[0].n_tokens > 1


def test_double_double_is_exact():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 100)) * 10.0 ** rng.integers(-8, 8, (2, 100))
    for f, exact in ((whitening.two_sum, lambda x, y: Fraction(x) + Fraction(y)), (whitening.two_product, lambda x, y: Fraction(x) * Fraction(y))):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(e) == exact(x, y) for h, e, x, y in zip(high, low, a, b))
    x = np.array([1e16, 1.0, -1e16, 1e-3] * 25)
    high, low = whitening.total(x, np.zeros(100))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - sum(map(Fraction, x))) < Fraction(1, 10**20)


def exact_whitening(rows, k=8):
    x = np.array(rows, dtype=object)
    n = len(rows)
    apart = n * x - x.sum(axis=0)
    cov = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in apart.T.dot(apart)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return (apart**2).sum(axis=1), apart.astype(float) / n @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


@pytest.fixture
def many_merges(monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)


def test_whitening_equals_exact_arithmetic(spark, many_merges):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.01, 3, 12)).astype("float32")
    data = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    data += [(0, data[0][1], "x", 1)] * 40  # repeated rows
    good = len(data)
    odd = [None, [], [1.0] * 5, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11]
    data += [(1000 + i, v, "x", 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n string, component int").repartition(7)
    got = whitening.whitened_embeddings(df).collect()
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in d[1]] for d in data[:good]]
    deviation, white, explained = exact_whitening(x)
    assert len(got) == 8 * good and {r.n for r in got} == {good}
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    sign = {}
    for r in got:
        if r.vec_id < 1000:
            assert r.deviation == deviation[r.vec_id]
            want = white[r.vec_id, r.component - 1]
            assert abs(abs(r.whitened) - abs(want)) < 1e-9
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
            if abs(want) > 1e-6:
                assert sign.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)


def test_whitening_of_few_equal_and_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened_embeddings(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whitening.whitened_embeddings(spark.createDataFrame([], kind)).count() == 0
    same = whitening.whitened_embeddings(spark.createDataFrame([(None, [1.0, 2.0])] * 3, kind)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in same)
    huge = whitening.whitened_embeddings(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], kind)).collect()
    assert len(huge) == 6 and all((r.deviation is None) == (r.vec_id != 3) and r.n == 3 for r in huge)
    flat = whitening.whitened_embeddings(spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(5)], kind)).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in flat)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part int"


def clicks(n, seed=1):
    rng = random.Random(seed)
    at, out = datetime(2024, 1, 3), []
    for i in range(n):
        at += timedelta(minutes=rng.expovariate(1 / 40))
        out.append((i, at, at + timedelta(hours=rng.choice([0, 0, 1, 900])), rng.choice("ab"), i % 3))
    crowd = datetime(2024, 2, 7, 13)
    out += [(7, crowd + timedelta(seconds=i % 50), crowd, "c", 0) for i in range(n // 3)]  # one hour, many ties
    out += [(7, crowd, crowd, "c", 0)] * (n // 6)  # repeated rows
    out += [(50_000 + i, None, at, None, None) for i in range(n // 8)]  # no moment
    out += [(None, at, None, None, 1), (None, None, None, None, None), (1, datetime(1970, 1, 1), at, "x", 1), (2, datetime(2024, 2, 29, 23, 59, 59, 999999), at, "x", 1)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,limit", [(150, 3), (300, 20), (40, 1)])
def test_time_partitions_equal_brute_force(spark, n, limit):
    data, early = clicks(n), datetime(2024, 3, 1)
    df = spark.createDataFrame(data, CLICKS).repartition(5)
    before = F.col("arrived_at") < F.lit("2024-03-01").cast("timestamp_ntz")
    start = timeparts.write_layout(df.where(before), queries.click_moment(), limit, ["arrived_at", "click_id"])
    first = {local(r.path) for r in start.paths().collect()}
    final = timeparts.write_layout(df, queries.click_moment(), limit, ["arrived_at", "click_id"], is_new=~before, previous=start)
    rows = timeparts.layout_report(final, "click_id").collect()
    got = {(r.leaf, r.part): (r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in rows}
    assert len(got) == len(rows) and got == brute.relayout(data, limit, early)
    paths = {local(r.path): r for r in rows}
    assert set(paths) == set(glob.glob(local(final.folder) + "/**/*.parquet", recursive=True))
    assert all((p in first) != r.rewritten for p, r in paths.items())
    for p, r in paths.items():
        held = pq.ParquetFile(p).read()
        assert ",".join(held.column_names) == r.columns and len(held) == r.n_rows <= limit
        ids = ",".join("" if x is None else str(x) for x in held["click_id"].to_pylist())
        assert hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256


def test_time_partitions_of_nothing(spark):
    df = spark.createDataFrame([], CLICKS)
    layout = timeparts.write_layout(df, queries.click_moment(), 1, ["click_id"])
    again = timeparts.write_layout(df, queries.click_moment(), 1, ["click_id"], previous=layout)
    assert timeparts.layout_report(again, "click_id").count() == 0


def test_a_second_rewrite_touches_nothing(spark):
    df = spark.createDataFrame(clicks(200), CLICKS)
    one = timeparts.write_layout(df, queries.click_moment(), 15, ["arrived_at", "click_id"])
    paths = {r.path for r in one.paths().collect()}
    two = timeparts.write_layout(df, queries.click_moment(), 15, ["arrived_at", "click_id"], previous=one)
    assert {r.path for r in two.paths().collect()} == paths
    assert two.files.where("not stays").isEmpty()


def test_repeated_rows_without_an_id_are_packed_in_many_blocks(spark):
    """All rows alike: each has a place of its own, and no block has them all."""
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    out = packing.best_fit_packing(docs, block_rows=100)
    assert out.count() == 2000 and out.select("sequence_id", "offset").distinct().count() == 2000
    assert "spot" not in out.columns


def test_stage_cuts_bytes_and_words(spark):
    """Text without spaces and long words go by their bytes, short words by their number."""
    chinese = "".join(chr(0x4E00 + i * 37 % 2000) for i in range(400))
    long_words = " ".join(chr(97 + i % 26) * 30 for i in range(40))
    short_words = " ".join(f"w{i % 9}x{i}" for i in range(52))
    texts = [(chinese, 1), (chinese, 2), (long_words, 3), (long_words, 4), (short_words, 5), (short_words, 6), ("alone here", 7)]
    docs = spark.createDataFrame([(i, f"{chr(96 + i)}{i}{i} {t} {i}{i}z", "x", "s", 1) for t, i in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, "").collect()}
    assert all(t not in got[i] and 4 <= len(got[i]) <= 10 for t, i in texts[:6]) and got[7] == "g77 alone here 77z"


def test_empty_tables_of_shards_conversations_and_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, slot string")
    assert sharding.assign_shards(empty, "k", ["a", "b"], 11).collect() == []
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "some text", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.llm_page_languages(spark, str(tmp_path)).collect() == []
