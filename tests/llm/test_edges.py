"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from quilt.llm import catalogue, decontam, html_blocks, html_crf, line_dedup, mixing, near_copies, quality, secret_scan, simhash, token_count, tokenfile, url_rank

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, fp string, kept string, spans string, d string, hash string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "b"), (None, "", None), (None, "null id text " * 30, None), (3, LONG, "a"), (4, "   \n\n \t", "b"), (5, "x" * 20_000, "c"), (-7, "one two three", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, 0, *["clash"] * 7) for i, t, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (None, "w1 w2 w3"), (3, " ".join(f"w{i}" for i in range(5, 30)))], "item_id long, text string")


def test_quality(docs, none):
    got = quality.quality(docs, with_text=True)
    assert got.count() == len(ROWS) and quality.quality(none).count() == 0
    blank = got.where("doc_id = 2 OR doc_id = 4").collect()
    assert [(r.n_words, r.word_chars, r.base_failed, r.kept, r.text) for r in blank] == [(0, 0, True, False, "")] * 2
    assert quality.kept_documents(docs).columns == docs.columns


def test_near_duplicates(docs, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    assert {c for i, _, c in got if i in (1, -7)} == {-7}
    zero = [x for x in got if x[1] == "0" * 16]
    assert {i for i, _, _ in zero} == {2, 4, None} and {c for _, _, c in zero} == {2}
    assert [c for i, f, c in got if i is None and f != "0" * 16] == [None]
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((i is None, i) for i in (-7, 2, None, 3, 5))


def test_rows_without_id_in_near_dedup(spark):
    """A single null id is kept where nothing resembles it, whether or not ids repeat; unnamed near copies leave one row."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, "one two three four five six"), (None, " ".join(words)), (2, "quite another text of some words")]
    near = [(None, " ".join([*words[:199], last])) for last in "xy"]
    for extra, ids in (([], [1, 2, None]), ([rows[0]], [1, 2, None]), (near, [1, 2, None]), ([(7, near[0][1])], [1, 2, 7])):
        kept = near_copies.one_of_each(spark.createDataFrame(rows + extra, "doc_id long, text string"))
        assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == ids


def test_token_files(spark, docs, none, tmp_path):
    path = catalogue.tokenizer_path()
    for df, n in ((docs, len(ROWS)), (none, 0)):
        schema = tokenfile.write(df, f"file://{tmp_path}/{n}", path)
        got = tokenfile.digests(spark, f"file://{tmp_path}/{n}", schema).orderBy("start").collect()
        assert len(got) == n
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    counts = token_count.token_counts(docs, path)
    assert sorted(r.n_tokens + 1 for r in counts.collect()) == sorted(r.n_tokens for r in tokenfile.digests(spark, f"file://{tmp_path}/{len(ROWS)}", schema).collect())
    assert token_count.token_counts(none, path).count() == 0
    assert counts.where("doc_id = 2").first().n_bytes == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    assert all(r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    assert sum({(r.source_size, r.target): r.target for r in got}.values()) == pytest.approx(total)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_secrets(docs, none):
    got = secret_scan.secrets(docs)
    assert got.count() == len(ROWS) and secret_scan.secrets(none).count() == 0
    assert got.where("doc_id = 2").first().spans == ""


def test_decontamination(docs, none, benchmark):
    got = {(r.doc_id, r.n_words): r for r in decontam.search(docs, benchmark).collect()}
    assert got[1, 3].items == [1] and got[1, 3].n_hit == 3 and got[2, 0].n_hit == 0
    assert got[3, 60_000].items == [3] and got[3, 60_000].n_hit == 62 * 25 + 62 * 3 - (0 if 60_000 % 977 > 29 else 3)
    assert decontam.search(none, benchmark).count() == 0
    assert decontam.search(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    whole = decontam.search(docs, benchmark).select("doc_id", "n_hit", "spans", "items")
    blocks = decontam.search(docs, benchmark, table_bytes=10).select("doc_id", "n_hit", "spans", "items")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, blocks.collect()))


def test_decontamination_of_odd_tables(spark, docs):
    """String ids on either side; columns named like the results stay as they are in the stage."""
    named = spark.createDataFrame([("x", "one two three"), (None, "w1 w2 w3 w4")], "item_id string, text string")
    got = decontam.search(docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), named).collect()
    assert {r.doc_id for r in got if r["items"] == ["x"]} == {"1", "-7"} and {r.doc_id for r in got if r.n_hit and not r["items"]} == {"3"}
    clash = docs.withColumns({"items": F.lit("clash"), "n_hit": F.lit(9), "c0": F.lit(1)})
    kept = decontam.clean_documents(clash, named)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {2, 4, 5, None} and kept.where("items <> 'clash' OR n_hit <> 9").count() == 0


def test_search_table_against_all_windows():
    """Few words, so windows share blocks and suffixes; the table's size is as estimated."""
    import pickle
    import random

    rng = random.Random(6)
    make = lambda n, k: " ".join(rng.choice("abcde"[:k]) for _ in range(n))
    items = [(i, make(rng.randint(0, 20), 2)) for i in range(30)]
    tables = decontam.WuManber(items)
    plain = {i: decontam.windows_of(decontam.words_of(t)) for i, t in items}
    for _ in range(300):
        words = decontam.words_of(make(rng.randint(0, 40), rng.choice((2, 2, 3))))
        spans, found = tables.search(words)
        hit, want = set(), set()
        for i, ws in plain.items():
            for w in ws:
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        want.add(i)
                        hit |= set(range(k, k + len(w)))
        assert found == want and {p for a, b in spans for p in range(a, b)} == hit
    big = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(1000))) for i in range(50)]
    assert len(pickle.dumps(decontam.WuManber(big))) < decontam.WORD_BYTES * 50_000 + sum(len(t) for _, t in big)


def test_stage_drops_single_items(spark, docs, benchmark):
    """One planted passage of one item, with an id or without, is enough for the stage; n_items >= 2 is the query's column alone."""
    item = " ".join(f"w{i}" for i in range(5, 30))
    rows = [(1, f"before it {item} after it"), (2, "before it " + " ".join(item.split()[4:12])), (3, " ".join(item.split()[:7])), (4, "says W1, w2; w3!"), (5, None)]
    stage = decontam.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert stage.columns == ["doc_id", "text"] and sorted(r.doc_id for r in stage.collect()) == [3, 5]


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs)
    assert got.count() == len(ROWS) and line_dedup.dedup_lines(none).count() == 0
    assert got.where("n_deleted > 0").count() == 0


def test_urls(spark):
    link = '<a href="http://bad.net/es/1">x</a>'
    pages = spark.createDataFrame(
        [(1, None, None, "c"), (2, "nothing", "", "c"), (3, "http://Bad.NET/es/2?q", "", "c"), (4, "x://friend.org/p#f", link, "c"), (5, "http://www.example.com/en/", "", "c"), (6, "http://example.com", "", "c"), (None, "http://a.com/", link, "c")],
        "page_id long, url string, html string, verdict string",
    )
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rank.judge_urls(pages).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("bad.net", "/es/2", "net/es/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[4] == ("friend.org", "/p", None, "block")  # it links to a blocked host
    assert got[6] == ("example.com", "", None, "allow") and got[None][2] == "com/"
    assert url_rank.judge_urls(pages.limit(0)).count() == 0


def test_urls_of_rare_hosts_among_millions(spark):
    """A host with one blocked page of 1.2 million is a seed like any other, as it is in a small table."""
    for n in (10, 1_200_000):
        many = spark.range(n).selectExpr("id AS page_id", "'http://big.net/es/' AS url", "CAST(NULL AS STRING) AS html")
        few = spark.createDataFrame([(-1, "http://rare.net/es/1", ""), (-2, "http://rare.net/other", ""), (-3, "http://friend.org/", '<a href="http://rare.net/es/1">x</a>')], many.schema)
        got = {r.page_id: (r.verdict, r.distrust) for r in url_rank.judge_urls(many.unionByName(few)).where("page_id < 0").collect()}
        assert {v for v, _ in got.values()} == {"block"}
        assert got[-2][1] == pytest.approx(0.15 * url_rank.SCALE / (n + 1), rel=0.01)


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "u", "", "c"), (2, "u", "", "c"), (None, "u", "<p>" * 3000 + "x", "c"), (3, "u", "<article><p>A b &amp; c d.</p><p>E f\n g h i j.</p></article><footer>&copy; z</footer>", "c")], "page_id long, url string, html string, text string")
    got = html_crf.main_text(pages)
    assert got.count() == 5 and html_crf.main_text(pages.limit(0)).count() == 0
    assert got.where("page_id = 3").first().text == "A b & c d.\nE f g h i j."
    assert [r.text for r in got.where("page_id < 3").collect()] == ["", "", ""]


def test_chrome_phrase_late_in_a_long_block():
    block = html_blocks.Block("word " * 200 + "all rights reserved.", (), 0)
    assert "chrome-long" in html_blocks.text_features(block, 0, 1, None)
