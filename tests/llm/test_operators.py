"""The text operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import urllib.parse

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rideframe.llm import chat, fingerprint, html, jaccard, langid, mixing, packing, quality, queries, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, n int"


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [make(rng.randint(1, 200)) for _ in range(60)]
    base, passage = make(150), make(90)
    for k in range(25):  # near copies of each other
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[0]] * 5 + [make(40) + " " + passage + " " + make(30) for _ in range(6)]
    out += ["", "   ", "one", "a b c d", make(6000), "x" * 3000, "ab " * 700, "line\nline\nother\nline", "é ß 漢字 🙂 " * 60, "<|endoftext|> a  b\tc d"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "hot", "hot", "hot"][i % 6], len(t), "x", 1) for i, t in enumerate(texts())] + [(900, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_equals_brute_force(docs, rows, empty):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == brute.classes([r[:2] for r in rows])
    small = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_classes(docs, block_rows=7).collect()}
    assert small == got  # blocks against each other lose and repeat nothing
    assert jaccard.jaccard_classes(empty).count() == 0


def test_prefix_is_shortened_to_the_target():
    assert [jaccard.chosen_depth(0.8, t) for t in (0.9, 0.999, 0.9999)] == [8, 7, 6]
    assert jaccard.chosen_depth(0.8, 0.9999, {8: 10**6}) == 8  # many links, all found by the longest prefix
    assert jaccard.chosen_depth(0.8, 0.9999, {8: 10**6}, {8: 10**6, 5: 10**3}) == 5
    assert jaccard.chosen_depth(0.8, 0.9999, {8: 10, 0: 10}) == jaccard.FLOOR


def test_planted_copies_miss_as_chance_has_it(spark):
    forest, shingles = jaccard.Forest(), jaccard.Shingles(5)
    with np.errstate(over="ignore"):
        for n_words in (9, 40, 160):
            found = sum(forest.planted(shingles(" ".join(f"{k}w{i}" for i in range(n_words))), 0.8, 100) for k in range(30))
            n = n_words - 4
            lost = int(n / 9 + 1e-9)
            new = lost + ((n - lost) / (n + lost + 1) >= 0.8 - 1e-9)
            alike = (n - lost) / (n + new)
            assert found.sum() == 3000 and alike >= 0.8
            for depth in (4, 6, 8):
                chance = (1 - alike**depth) ** jaccard.TREES
                assert abs(found[:depth].sum() / 3000 - chance) < 0.005 + chance
        assert forest.planted(shingles("a b c d e f g"), 0.8).sum() == 0  # three shingles: nothing else is that near
        assert forest.planted(shingles("w " * 3 + " ".join(map(str, range(5000)))), 0.8, 4).sum() == 4


def test_planted_links_count_a_set_once(docs, rows):
    signed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    twice = signed.unionByName(signed)
    schema = "doc_id long, text_key long, n int, set_a long, set_b long, signature array<long>, planted array<long>"
    counted = [jaccard.planted_links(x.mapInPandas(jaccard._signed(5, 0.8), schema).where("n > 0").withColumn("rep", F.xxhash64("set_a", "set_b", "n"))) for x in (signed, twice)]
    assert counted[0] == counted[1] and sum(counted[0].values()) >= 100
    assert jaccard.chosen_depth(0.8, 0.9999, counted[0]) in (5, 6)


def test_quality_counts_equal_brute_force(docs, rows, empty):
    got = {r.doc_id: r for r in quality.fertility_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        r = got[i]
        want = brute.base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.fertility_rules(empty).count() == 0


def test_substrings_equal_brute_force(docs, rows, empty):
    for length in (400, 60):
        out = substrings.cut_repeats(docs, length).withColumn("sha", F.sha2("kept", 256)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out} == brute.cut([r[:2] for r in rows], length)
    assert substrings.cut_repeats(empty).count() == 0


def test_cut_results_go_on_in_parts_and_stay_whole(monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 10)
    texts = ["abcdef", "", "x" * 40, "né", "tail"]
    batch = pd.DataFrame({"doc_id": range(5), "text": texts, "spans": [None] * 5})
    parts = list(substrings._cut(True, [])(iter([batch, batch.head(0)])))
    assert len(parts) > 1
    assert [(r.doc_id, r.kept, r.n_removed) for p in parts for r in p.itertuples()] == [(i, t, 0) for i, t in enumerate(texts)]


def test_packing_is_gapless_and_tight(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.best_fit_packing(docs).collect()
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, *_ in rows:
        assert sorted(pieces[i]) == brute.pieces(lambda t: model.encode(t, add_special_tokens=False).ids, text)
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.best_fit_packing(empty).count() == 0


def test_plan_is_best_fit_over_counts():
    rows = packing.plan({5: 3, 4: 2, 3: 4, 1: 7}, 10)
    assert sum(r[3] for r in rows) == 16
    assert max(r[2] + r[3] for r in rows) == 5  # 42 units: no fewer than five sequences


def test_mixing_meets_targets(docs, rows, empty):
    out = mixing.mix_sources(docs, block_rows=5, fan_in=3).collect()
    again = mixing.mix_sources(docs.repartition(7), block_rows=5, fan_in=3).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken <= 2 * r.size and r.size == len(brute.WORD.findall(dict(x[:2] for x in rows)[r.doc_id] or ""))
    want = brute.targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert mixing.mix_sources(empty).count() == 0


def test_fingerprints(docs, rows, empty):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, ring_rows=10).collect()}
    order, text, prints = sorted(got, reverse=True), {r[0]: r[1] or "" for r in rows}, {}
    for k, i in enumerate(order):
        a, b = text[i], text[order[(k + 1) % len(order)]]
        n = len(a) // 3
        assert got[i].n_chars == len(a)
        assert got[i].edited_sha256 == hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()
        assert prints.setdefault(a, got[i].fingerprint) == got[i].fingerprint
        same = sum(x == y for x, y in zip(*[re.findall("." * 6, f) for f in (got[i].fingerprint, got[i].edited_fingerprint)])) / 32
        assert got[i].near_edited == same
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c " * 200), (1, "d e f g"), (1, "d e f g"), (2**60 + 1, "h i j k l m")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    for f in (jaccard.jaccard_classes, quality.fertility_rules, fingerprint.edited_fingerprints, substrings.cut_repeats, packing.best_fit_packing, mixing.mix_sources):
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in f(df).select("doc_id").collect()) == [(False, 0), (True, 1), (True, 1), (True, 2**60 + 1)], f
    found = queries.identified(spark, df).collect()
    assert len(found) == 4 and all(r.kept for r in found)


def test_languages(spark, docs, empty):
    words = {"en": "the of and thing over with that", "de": "der die und nicht schön auch über"}
    rng = random.Random(1)
    train = [(i, " ".join(rng.choices(words[lang].split(), k=20)), lang, f"host-{lang}") for i, lang in enumerate(["en", "de"] * 40)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    model = langid.fit_text_model(df)
    tests = [(1, "und der über", "en", "host-de"), (2, "the thing", None, "host-en"), (3, "12 34", "en", "host-en"), (4, None, None, None)]
    t = spark.createDataFrame(tests, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang, r.kept) for r in langid.identify_languages(t, model, F.col("lang"), F.lit(None).cast("string"), [F.col("source")]).collect()}
    assert got[1] == ("de", True) and got[2] == ("en", True) and not got[3][1] and not got[4][1]
    assert queries.identified(spark, empty).count() == 0
    held = spark.createDataFrame([(i, " ".join(rng.choices(words[lang].split(), k=6)), lang, "x") for i, lang in enumerate(["en", "de"] * 50)], "doc_id long, text string, truth string, source string")
    out = langid.identify_languages(held, model, F.lit(None).cast("string"), F.lit(None).cast("string"), [F.col("source")]).join(held.select("doc_id", "truth"), "doc_id")
    assert out.where("lang = truth").count() >= 95


def test_addresses(spark):
    df = spark.createDataFrame([("http://a.b.de/x", "<!doctype html><html class=x lang='FR-be'>"), ("https://u@B.example.com:80/en/3", None), (None, "")], "url string, html string")
    got = df.select(langid.host_of(F.col("url")), langid.address_language(F.col("url")), langid.markup_language(F.col("html"))).collect()
    assert [tuple(r) for r in got] == [("a.b.de", "de", "fr"), ("b.example.com", "en", ""), ("", "", "")]


def test_chat_round_trip(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\nok %3C| %25 <|escaped|>"
    data = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, None, None), (2, 5, "a\nb<|im_end|>", "plain 50%"), (2, 5, "a\nb<|im_end|>", "plain 50%"), (None, 0, "assistant", "x <|im_start"), (3, 1, "assistant", ""), (3, 0, "system", "<|escaped|>")]
    out = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 4
    for r in out:
        own = sorted(((x[1], x[2] or "", x[3] or "") for x in data if x[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        back = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        back = [b.replace("%3C|", "<|").replace("%25", "%") if s.escaped else b for b, s in zip(back, r.loss_spans)]
        assert back == [x[2] for x in own if x[1] == "assistant"]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sharding_moves_few(spark):
    names = [f"s{i}" for i in range(12)]
    before, after = sharding.fill(names, 1009), sharding.fill(names[:5] + names[6:], 1009)
    counts = [before.count(i) for i in range(12)]
    assert max(counts) - min(counts) <= 1
    rest = names[:5] + names[6:]
    moved = sum(names[a] != rest[b] for a, b in zip(before, after) if a != 5)
    assert moved < 0.1 * 1009
    df = spark.createDataFrame([(None, 1, "x"), ("a", 2, "y"), ("a", 3, "z")], "k string, v int, SLOT string")
    out = sharding.assign_shards(df, "k", names, 1009).collect()
    assert len(out) == 3 and len({r.shard for r in out if r.k == "a"}) == 1
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1><p>The best site with news for all.</p></header>
<div id="cookie-notice"><p>We use cookies to make this site work.</p></div><nav><a href=x>Home</a></nav><main><article><h1>Title &amp; more</h1>
<p>First   paragraph with <a href=u>a link</a> inside.</p><p><b>Short.<br><p>Next &#8364; one<!-- > no --></p><div class="ad">Buy now</div><form><label>Mail</label></form>
<ul><li>one<li>two</ul></article><section id="comments"><p>A long reader comment that goes on and on.</p></section></main><aside><p>Related text to read.</p></aside>
<footer>All rights</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_language_fusion_equals_a_plain_version(spark):
    """Posteriors of every row from the text model's logs, host levels and tables of evidence, all by hand."""
    rng = random.Random(12)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["strasse", "wagen", "hund"], "cc": ["perro", "coche", "calle"]}
    rows = []
    for i in range(40):
        lang = rng.choice("abc") * 2
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.choice([0, 1, 1, 2, 5])))
        rows.append((i, text, rng.choice([lang, None, "xx", lang]), rng.choice([lang, "", "zz"]), rng.choice(["h1", "h2", None]), rng.choice(["p", "q"])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, suffix string, host string, path string")
    model = langid.fit_text_model(spark.createDataFrame([(k, " ".join(w), lang) for k, (lang, w) in enumerate(words.items())], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify_languages(df, model, F.col("lang"), F.col("suffix"), [F.col("host"), F.col("path")]).collect()}

    assert model.languages == ["aa", "bb", "cc", langid.UNKNOWN]
    for i, (lang, posterior, kept) in brute.fused(model, [(*r[:4], r[4:]) for r in rows]).items():
        assert got[i].lang == lang and abs(got[i].posterior - posterior) < 1e-9 and got[i].kept == kept


def test_page_languages_equal_a_plain_version_and_agree_without_the_markup(spark):
    """Every page of the smallest tables; with its markup withheld, text, address and host tell the declared language."""
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.llm_page_languages(spark, folder).collect()}
    pages = queries.table(spark, folder, "pages")
    texts = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    model = langid.fit_text_model(queries.table(spark, folder, "documents"))
    rows = []
    for r in pages.collect():
        host = (urllib.parse.urlsplit(r.url or "").hostname or "").lower()
        path = re.match(r"/([a-z]{2})(?:/|$)", urllib.parse.urlsplit(r.url or "").path.lower())
        labels = host.split(".")
        declared = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", r.html or "", re.I)
        rows.append((r.page_id, texts[r.page_id], declared and declared[1].lower(), path[1] if path else labels[-1], (labels[-1], ".".join(labels[-2:]), host)))
    want = brute.fused(model, rows)
    assert len(got) == len(rows) == len(want)
    for i, (lang, posterior, kept) in want.items():
        assert (got[i].lang, got[i].kept) == (lang, kept) and abs(got[i].posterior - posterior) < 1e-9
    withheld = brute.fused(model, [(i, t, None, a, h) for i, t, _, a, h in rows])
    told = [(declared, withheld[i][0]) for i, text, declared, *_ in rows if declared in model.languages and text]
    assert len(told) >= 10 and sum(x == y for x, y in told) >= 0.9 * len(told)


def test_html(spark):
    want = "Title & more\n\nFirst paragraph with a link inside.\n\nShort.\n\nNext € one\n\none\n\ntwo"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p><"), (5, "u", "<script>x")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_pages(df).collect()}
    assert got[1] == (want, len(want))
    assert got[2] == got[3] == got[5] == ("", 0)


def test_class_names_are_taken_word_by_word(spark):
    article = "<h1>Title</h1><p>A first paragraph of some words that tells the story, and then goes on.</p><p>Second one.</p>"
    whole = "Title\n\nA first paragraph of some words that tells the story, and then goes on.\n\nSecond one."
    pages = [f'<div class="main-content no-sidebar">{article}</div>', f'<div class="post type-post tag-news">{article}</div>', f'<div class="post"><div class="entry-header"><h1>Title</h1></div>{article[14:]}</div>', f'<div class="site-header"><p>Site of news</p></div><div id="mainContent">{article}</div><div class="post-comments"><p>I read all of this and think it is good.</p></div><div class="left-sidebar"><p>More.</p></div>']
    for page in pages:
        assert html.main_text(f"<html><body>{page}</body></html>") == whole, page


BODY = "<h1>Title of it</h1><p>" + "some words of the article stand here " * 9 + "</p><p>Short one.</p><p>" + "and more of them stand here too " * 9 + "</p>"
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">part {i}</a></li>' for i in range(5)) + "</ul></nav>"


def whole_page(inner):
    return html.main_text(f"<html><body>{NAV}{inner}<footer>&copy; all rights</footer></body></html>")


def test_wrappers_with_names_of_other_parts_keep_the_article():
    whole = whole_page(f"<article>{BODY}</article>")
    side = '<div class="sidebar"><h3>More</h3><p>other text stands here</p></div>'
    pages = [
        f'<div class="content-sidebar-wrap"><main>{BODY}</main>{side}</div>', f'<div class="layout-with-sidebar"><article>{BODY}</article></div>', f'<div id="wrapper" class="nav-collapsed"><main>{BODY}</main></div>',
        f'<div class="ad-free-layout"><article>{BODY}</article></div>', f'<div class="search-page"><article>{BODY}</article></div>', f'<form id="page">{NAV}<article>{BODY}</article></form>', f'<div class="nav-open">{NAV}<div class="post-content">{BODY}</div>{side}</div>',
    ]
    for page in pages:
        assert whole_page(page) == whole, page
        assert html.main_text(f"<html><body>{page}</body></html>") == whole, page
    assert "Short one." in whole and "part" not in whole


def test_articles_of_readers_and_links_are_not_the_text():
    whole = whole_page(f"<article>{BODY}</article>")
    comment = "<article><p>" + "a reader says very much of this " * 30 + "</p></article>"
    for other in (f'<div class="comments">{comment * 3}</div>', f'<div class="related-posts">{comment}</div>', '<section id="comments"><p>good</p></section>', f'<aside><article>{BODY}</article></aside>'):
        assert whole_page(f"<article>{BODY}</article>{other}") == whole, other


def test_sections_and_paragraphs_are_named_for_their_subject():
    for inner, text in [
        ('<section id="side-effects"><p>Some side effects are known and listed here.</p></section>', "Some side effects are known and listed here."),
        ('<section id="related-work"><h2>Related work</h2><p>Others did this before.</p></section>', "Related work\n\nOthers did this before."),
        ('<p id="share-price">The share price rose by ten.</p>', "The share price rose by ten."),
        ('<section class="comments-area"><p>good</p></section>', None),
    ]:
        got = whole_page(f"<article>{BODY}{inner}</article>")
        assert text is None and "good" not in got or text is not None and got.endswith(text)
    assert html.main_text("<body><p>One short.</p><p>Two short words.</p><p>Last.</p></body>") == "One short.\n\nTwo short words.\n\nLast."


def test_html_of_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some text.</p>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.page_id, r.text, r.n_chars) for r in html.extract_pages(df).collect()] == [(1, "Some text.", 10)]
    assert html.extract_pages(df.where("false")).count() == 0


def test_pages_of_open_elements_take_linear_time():
    import time

    took = []
    for n in (20_000, 40_000):
        begin = time.perf_counter()
        html.blocks("<i><div>" + "<b>" * n + "</i>" * n + "x")
        html.blocks("<li><p>" * n + "</b></td>" * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 4 * took[0] + 0.2


def test_words_density_and_neighbours_decide():
    """Without one of them the tree is worse on held-out pages: names alone do not tell menus in an article or pages without names."""
    x, y = html.labelled_blocks(seed=99, pages=80)
    x0, y0 = html.labelled_blocks()

    def score(keep):
        model = html.grow(x0[:, keep], y0, 8)
        return np.mean([html.judge(model, row) == bool(label) for row, label in zip(x[:, keep], y)])

    everything = list(range(len(html.FEATURES)))
    whole = score(everything)
    assert whole > score([6, 7, 8, 9, 10]) + 0.03  # neither words nor density
    assert whole > score([0, 1, *range(6, 11)]) + 0.004  # no neighbours


def test_tree_on_held_out_pages():
    x, y = html.labelled_blocks(seed=99, pages=80)
    right = sum(html.judge(html.tree(), row) == bool(label) for row, label in zip(x, y))
    assert right / len(y) >= 0.95


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op7_sharding"])
def test_sql(spark, name):
    con = duckdb.connect()
    data = "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    columns = want.columns
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[columns.index(c)] for c in order]) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, data)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == docs.where(F.col("text").rlike("[a-zA-Z]")).count()
    one = corpus_pipeline.near_duplicates(spark, kept, data)
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in one.collect()} == {i for i, v in brute.classes(pairs).items() if v[0] == i}
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, one, data).collect()}
    before = [(r.doc_id, r.text) for r in one.collect()]
    assert cut == brute.cut_both(before, 400, 51)  # the stage cuts by bytes and by words
    assert sum(map(len, cut.values())) <= sum(map(len, brute.cut_words(before, 51).values()))
    assert corpus_pipeline.run(spark, data).count() > 0


def test_pipeline_on_nulls_and_repeats(spark):
    import corpus_pipeline

    words = " ".join(f"word{i} runs over the old stone bridge" for i in range(30))
    rows = [(None, words, "en", "web", 1), (None, "another text without any id at all here", None, None, None), (1, None, "en", "web", 0), (2, "", None, "web", 0), (3, "the quick brown fox jumps over the dog", "en", None, 38), (3, "the quick brown fox jumps over the dog", "en", None, 38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.packed(spark, docs, "").count() == 6 and corpus_pipeline.packed(spark, docs.where("false"), "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.COLUMNS
        assert {words, rows[1][1], rows[4][1]} >= {r.text for r in out.collect() if r.text} and out.where("doc_id < 0").count() >= (0 if stage is corpus_pipeline.mixed_sources else 2)
        assert stage(spark, docs.where("false"), "").count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs, "").where("doc_id = 3").count() == 1
    taken = corpus_pipeline.mixed_sources(spark, docs, "").where("doc_id = 3").count()
    assert taken <= 4  # both rows, at most twice


def test_pipeline_cuts_repeated_passages_of_51_short_words(spark):
    import corpus_pipeline

    rng = random.Random(5)
    make = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    passage, short = make(51, 2), make(50, 2)
    assert len(passage) < 400
    rows = [(i, f"{make(60, 5)} {passage}\n{make(60, 5)}") for i in range(2)] + [(i, f"{make(60, 5)} {short} {make(60, 5)}") for i in (2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, docs, "").collect()}
    for i, text in rows:
        assert got[i] == (text.replace(passage, "") if i < 2 else text)


def test_texts_in_no_modelled_language_are_rejected(spark):
    rng = random.Random(7)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    odd = ["Быстрая лиса прыгает через ленивую собаку и бежит дальше по дороге домой", "我们今天去学校学习中文因为这个语言非常有意思也很难", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", noise]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(-1 - i, t, "en", "src0") for i, t in enumerate(odd)], docs.schema)
    few = spark.createDataFrame([(-9, "kaikki ihmiset syntyvät vapaina ja tasavertaisina", "fi", "src0")], docs.schema)
    model = langid.fit_text_model(docs.unionByName(few))  # a language of one row draws no other texts
    out = langid.identify_languages(docs.unionByName(more), model, F.col("lang"), F.lit(None).cast("string"), [F.col("source")]).collect()
    assert len([r for r in out if r.doc_id < 0]) == 4
    assert all(r.kept == (r.doc_id >= 0 and r.n_trigrams > 0) and (r.doc_id >= 0 or r.lang == langid.UNKNOWN) for r in out)


def test_rare_languages_are_modelled(spark):
    words = {"en": "the of and thing over with that", "fi": "kaikki ihmiset syntyvät vapaina tasavertaisina oikeuksiltaan"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang, "web") for i, lang in enumerate(["en"] * 600 + ["fi"] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit_text_model(df, rows=20)
    assert set(model.languages) >= {"en", "fi"}
    out = langid.identify_languages(df, model, F.col("lang"), F.lit(None).cast("string"), [F.col("source")]).join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert out.where("kept and lang = truth").count() == len(rows)


def test_symbols_and_byte_fallbacks_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    texts = [r.text for r in docs.where("lang = 'en'").where(F.size(F.split("text", " ")) > 80).orderBy("doc_id").limit(3).collect()]
    exotic = [" ".join("\U00010380\U00010381" if i % 10 == 0 else w for i, w in enumerate(t.split())) for t in texts]
    planted = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(exotic)], docs.schema)
    out = [r for r in quality.fertility_rules(docs.unionByName(planted)).collect() if not r.base_failed]
    ridden = [r.kept for r in out if r.doc_id >= 0 and r.n_symbols > r.n_words]
    clean = [r.kept for r in out if r.doc_id >= 0 and 10 * r.n_symbols <= r.n_words]
    assert not any(r.kept for r in out if r.doc_id < 0) and sum(r.doc_id < 0 for r in out) == 3
    assert len(ridden) > 20 and sum(ridden) < 0.4 * len(ridden)
    assert len(clean) > 500 and sum(clean) > 0.95 * len(clean)


def test_collisions_follow_generalised_jaccard(spark, docs, rows):
    from collections import Counter

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    pairs = []
    for share in (0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 1.0) * 3:
        a = rng.choices(vocabulary, k=80)
        pairs.append((" ".join(a), " ".join(w if rng.random() < share else rng.choice(vocabulary) for w in a)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "doc_id long, a string, b string").repartition("doc_id")
    out = fingerprint.weighted_samples(df, ["doc_id"], ["a", "b"], 512)
    got = {r.doc_id: r.near for r in out.select("doc_id", fingerprint.likeness(F.col("a_fingerprint"), F.col("b_fingerprint"), 512).alias("near")).collect()}
    for i, texts in enumerate(pairs):
        x, y = ({w: n * len(w) ** 2 for w, n in Counter(t.split()).items()} for t in texts)
        want = sum(min(x.get(w, 0), y.get(w, 0)) for w in {*x, *y}) / sum(max(x.get(w, 0), y.get(w, 0)) for w in {*x, *y})
        assert abs(got[i] - want) < 4 * (want * (1 - want) / 512) ** 0.5 + 0.01
    prints = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, ring_rows=10).collect()}
    order = sorted(prints, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        parts = [re.findall("." * 6, prints[k].fingerprint) for k in (a, b)]
        assert prints[a].near_next == sum(p == q for p, q in zip(*parts)) / 32


def test_bands_equal_brute_force(spark):
    rng = random.Random(12)
    measured = [(rng.choice(["lang:en", "lang:en", "lang:de", "script:han"]), rng.randrange(5, 8), rng.choice([0, 60, 90]), *(round(rng.gauss(3, 1), 2) for _ in range(3))) for _ in range(700)]
    df = spark.createDataFrame(measured, "group string, class int, n_words long, chars_per_token double, fallback_share double, evenness double")
    got = {(r.group, r["class"], r.metric): (r.low, r.high) for r in quality.bands(df, 1.5, 50).collect()}
    want = {}
    for metric, at in (("chars_per_token", 3), ("fallback_share", 4), ("evenness", 5)):
        keyed = {}
        for m in measured:
            if m[2] > 0:
                for key in ((m[0], m[1]), (m[0], None), (None, None)):
                    keyed.setdefault(key, []).append(round(m[at] * 1000))
        for key, values in keyed.items():
            if len(values) >= 50:
                values.sort()
                q1, q3 = (values[-int(-len(values) * q // 1) - 1] for q in (0.25, 0.75))
                reach = max(1.5 * (q3 - q1), quality.LEAST_REACH[metric])
                want[(*key, metric)] = (q1 - reach, q3 + reach)
    assert got == want
