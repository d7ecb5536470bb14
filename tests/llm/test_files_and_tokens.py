"""Archives, pages, token ids, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import html as entities
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marketspark.llm import byte_bpe, html_extract, warc

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- archives


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def expected(rows):
    least, out = {}, []
    for i, _, body, _ in rows:
        if i is not None:
            least[body or ""] = min(least.get(body or "", i), i)
    for i, _, body, _ in rows:
        data = (body or "").encode()
        first = least.get(body or "")
        later = first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


def test_archives_round_trip_over_small_ranges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"http://x/{k}", "".join(rng.choice("abc<>é\n\r") for _ in range(rng.choice([0, 5, 900, 60_000]))), "z") for k in range(40)]
    rows += [(100 + k, "u", rows[2][2], None) for k in range(5)] + [(200, None, None, None), (201, "a\r\nWARC-Type: x", "", None), (None, "n", "only null", None), (None, "n", rows[2][2], None), rows[3]]
    pages = pages_of(spark, rows)
    assert rows_of(warc.archived(pages, f"file://{tmp_path}/one").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(rows)
    for size in (997, 40_000, 1 << 24):
        again = warc.read(spark, f"file://{tmp_path}/one", range_bytes=size, payloads=True)
        assert again.count() == len(rows)
        stored = {r.record_id: bytes(r.payload).decode() for r in again.where("record_type = 'response'").collect()}
        assert stored["urn:page:2"] == rows[2][2] and all(stored[f"urn:page:{k}"] == rows[k][2] for k in range(40) if f"urn:page:{k}" in stored)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "one").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    assert warc.archived(pages.where("false")).count() == 0


def test_reader_skips_what_is_no_record(spark, tmp_path):
    good = warc.member("urn:page:1", "http://x", b"payload", None)
    junk = warc.MAGIC + b"\x00" * 30 + gzip.compress(b"no header") + warc.MAGIC
    (tmp_path / "mixed").write_bytes(junk + good + junk + good[:-3])
    found = warc.read(spark, f"file://{tmp_path}/mixed", range_bytes=11).collect()
    assert [(r.record_id, r.payload_bytes) for r in found] == [("urn:page:1", 7)]


def test_long_urls_come_back(spark, tmp_path):
    rng = random.Random(4)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000))
    urls = ["http://x/" + noise, "http://x/" + "a" * 3_000_000, "http://x/" + noise[::-1]]
    rows = [(1, urls[0], "one"), (2, urls[1], "two"), (3, urls[2], "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/archive")
    found = warc.read(spark, f"file://{tmp_path}/archive").collect()
    assert sorted((r.record_id, r.record_type, r.target_uri, r.refers_to) for r in found) == [
        ("urn:page:1", "response", urls[0], None), ("urn:page:2", "response", urls[1], None), ("urn:page:3", "revisit", urls[2], "urn:page:1"),
    ]


def test_small_payloads_may_stay_responses(spark, tmp_path):
    pages = pages_of(spark, [(1, "u", "aa", None), (2, "u", "aa", None), (3, "u", "a" * 50, None), (4, "u", "a" * 50, None)])
    found = warc.archived(pages, f"file://{tmp_path}/small", min_revisit=10)
    assert {r.page_id: r.refers_to for r in found.collect()} == {1: None, 2: None, 3: None, 4: 3}


# --- pages


def test_page_regions():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body class="single post"><div id="cookie-banner"><p>We use cookies to improve things.</p></div>
    <header class="site-header"><a href="/">Site</a><p>Tagline of the site, which is long enough to look like prose.</p></header><ul class="menu"><li><a href=1>Home</a><li><a href=2>News</a></ul>
    <div class="content"><h2>Real title</h2><p>First para with <a href=x>link</a> &amp; more&nbsp;text.<p>Short.<ul><li>one item<li>two</ul><!-- no -->
    <div class="advert"><p>Buy this excellent product right now, it is the best.</p></div><blockquote>Quo<b>te</b>.<br>Next</blockquote><form><p>Sign up to our letter</p></form>
    <div id="comments"><article class="comment"><p>Nice article, I really enjoyed reading this.</p></article></div></div><aside><p>Related reading of many words.</p></aside><footer>&copy; 2020</footer></body></html>"""
    assert html_extract.extract(page).split("\n") == ["Real title", "First para with link & more text.", "Short.", "one item", "two", "Quote. Next"]
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav><!-- ") == ""
    assert html_extract.extract("<p>a" + "<div>" * 3000 + "b" * 200_000) == "a\n" + "b" * 200_000


def test_open_comments_end_the_page_in_markup_only():
    body = "<article><p>Body</p></article>"
    for before in ("<script><!-- var a=1;</script>", "<style><!-- p {}</style>", '<p title="<!--"></p>', "<!-- c --!>", "<!-->", "<!--->", "<!-- a -- b > c -->"):
        assert html_extract.extract(before + body) == "Body"
    assert html_extract.extract(f"{body}<p>seen</p><!-- open <article><p>Not seen</p></article>").startswith("Body")
    assert "Not" not in html_extract.extract(f"{body}<!-- open <article><p>Not seen</p></article>")


def test_wrappers_do_not_hide_the_page():
    prose = "<p>A paragraph that is long enough to be read as prose by the weights.</p>"
    text = prose[3:-4]
    for page in (
        f'<body class="comments-open">{prose}</body>', f'<html class="no-comments"><body>{prose}', f"<body><form>{prose}</form></body>",
        f'<form><nav>Home</nav><div class="content">{prose}</div></form>', f"<h1>x</h1><form><article>{prose}</article></form>",
        f'<div class="comments-wrap"><article>{prose}</article></div>', f'<div id="discussion"><main>{prose}</main></div>',
    ):
        assert html_extract.extract(page).split("\n")[-1] == text, page
    for page in (
        f'<article>{prose}</article><section id="comments"><article>{prose * 3}</article></section>', f"<article>{prose}</article><form>{prose * 3}</form>".replace(prose * 3, "<p>Your name here.</p>"),
        f'<form><article>{prose}</article><div class="comments"><p>Nice words by a reader of it.</p></div></form>',
    ):
        assert html_extract.extract(page) == text, page
    assert html_extract.extract(f'<article hidden>{prose}</article>') == html_extract.extract(f'<div class="comments"><article class="comment">{prose}</article></div>') == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 9)
        evidence = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label):
            return sum(max(e, 0) if not x else max(-e, 0) for e, x in zip(evidence, label)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(evidence, edges)) == pytest.approx(best)


@needs_tables
def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in html_extract.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert rows_of(html_extract.main_texts(odd)) == [(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert html_extract.main_texts(odd.where("false")).count() == 0


# --- tokens


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return byte_bpe.default_table()


def test_ids_equal_the_tokenizer_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary
    library, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Encoder(ranks, pattern)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("ab cde  \n\t'sétlß 日本12½Ⅷ_-=!#\U0001F600\x85​AB\r") for _ in range(rng.randint(0, 80)))
        assert own.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 3000, "ab" * 900, "=" * 500, " " * 999 + "x", "thonatheoneseaen" * 90, "zu und die der " * 120_000):
        assert own.encode(text) == library.encode_ordinary(text)


def test_heap_and_scan_merge_alike(vocabulary):
    rng = random.Random(4)
    for _ in range(400):
        word = bytes(rng.choice(b"abcdethinor ") for _ in range(rng.randint(1, 40)))
        assert byte_bpe.merge_short(word, vocabulary[0]) == byte_bpe.merge_long(word, vocabulary[0])


def test_round_trip_of_odd_documents(spark, odd_docs, no_docs, vocabulary):
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in byte_bpe.round_trip(odd_docs, *vocabulary, keep_ids=True).collect():
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
            assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    coded = byte_bpe.encode(odd_docs, *vocabulary)
    assert {r.doc_id: bytes(r.data).decode() for r in byte_bpe.decode(coded, vocabulary[0]).collect() if r.doc_id} == {k: v for k, v in texts.items() if k}
    assert byte_bpe.round_trip(no_docs, *vocabulary, keep_ids=True).count() == 0


# --- registered


@needs_tables
@pytest.mark.parametrize("name", ["op1_warc", "op2_quality_rules", "op3_decontamination", "op11_line_dedup", "op12_merkle_manifest", "op13_spelling_variants"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.select(*columns)) == sorted(result.fetchall(), key=repr)


@needs_tables
def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@needs_tables
def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage keeps the columns, and drops exactly what its operator rejects of its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or after.columns == docs.columns
        counts.append(after.count())
        before, docs = docs, after
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert docs.join(before.select("doc_id", F.sha2("text", 256).alias("s")), "doc_id").where("s <> decoded_sha256").count() == 0


def test_stages_take_odd_and_no_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "an item that no text has anywhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("_id", "_h", "_gone", "_held_doc", "base", "fp", "key")})
    for docs in (odd_docs, no_docs, clash):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            left = stage(spark, docs, str(tmp_path))
            assert k == 4 or left.columns == docs.columns
            left.collect()
