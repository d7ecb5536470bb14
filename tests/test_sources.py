"""Archives, ragged CSV, tagged documents, JSON payloads, publishing and ingest."""

import hashlib
import io
import json
import random
from datetime import date
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from marketspark.operators import mutate
from marketspark.operators.quality import assert_unique
from marketspark.plans import filings, isin
from marketspark.sources import archives, documents, payloads
from marketspark.streaming.ingest import BLOCK_BYTES, ingest_new_files, stored_files, whole_files

NAMES = ["calc_date", "security_name", "shares_today"]


def definition(i, key):
    line = f"#{i:3d} {'label':<34}{key:<30} S 20 0"
    return line + " " * (78 - len(line))


def archive(lines):
    buffer = io.BytesIO()
    with ZipFile(buffer, "w") as z:
        z.writestr("m.txt", "\n".join(lines).encode("latin-1"))
    return buffer.getvalue()


def table(spark, *contents):
    return spark.createDataFrame([(hashlib.sha256(c).hexdigest(), bytearray(c), len(c)) for c in contents], "source_sha256 string, raw_bytes binary, source_bytes long")


HEAD = ["*", *[definition(i + 1, n) for i, n in enumerate(NAMES)]]


def parse(spark, lines):
    rows = archives.dictionary_rows(archives.archive_lines(table(spark, archive(lines))), NAMES)
    return archives.archive_observations(rows, {"security_name": "security_name"}, {"shares_today": "shares_today"}, ["shares_today"])


def test_dictionary_archive_with_and_without_last_field(spark):
    got = parse(spark, [*HEAD, "|20200131| Café |1000|", "|20200231|B|5", "|20200131|C|x|", "|20200131|D||"]).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.observation_date, r.security_name, r.shares_today, r.parse_status) for r in got] == [
        (5, date(2020, 1, 31), "Café", 1000.0, "shares_present"), (6, None, "B", 5.0, "invalid_date"),
        (7, date(2020, 1, 31), "C", None, "invalid_number"), (8, date(2020, 1, 31), "D", None, "no_shares")]


def test_changed_dictionary_fails(spark):
    with pytest.raises(Exception, match="unexpected field dictionary"):
        parse(spark, [*HEAD[:-1], "|20200131|B|"]).collect()
    with pytest.raises(Exception, match="does not fit"):
        parse(spark, [*HEAD, "|20200131|B"]).collect()


def test_archive_without_rows_fails(spark):
    with pytest.raises(Exception, match="without data rows"):
        parse(spark, HEAD).collect()


def test_tampered_bytes_fail(spark):
    bad = table(spark, archive(HEAD)).withColumn("source_sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="do not match digest"):
        archives.archive_lines(bad).collect()


def test_archive_is_stored_once(spark):
    first = table(spark, b"one")
    both = table(spark, b"one", b"two")
    assert archives.new_archives(first, both).count() == 1
    with pytest.raises(Exception, match="different bytes"):
        archives.new_archives(first.withColumn("source_bytes", F.lit(99).cast("long")), both).collect()


def test_ragged_csv_and_profile(spark):
    text = (",Date,ISIN,CompanyName,MktCap\n1,2020-01-31,US0378331005,Apple, Inc,5\n2,2020-01-31,US0378331005,Apple Inc,6\n3,2020-02-29,US0378331005,\"Apple, Inc\",7\n"
            "4,2020-01-31,NA,NA,NA\n5,2020-01-31,,Blank,1\n6,2020-01-31,US0378331006,Bad,1\n7,2020-01-31\n")
    rows = archives.parse_ragged_csv(table(spark, text.encode())).cache()
    got = [(r.source_row_number, r.raw_company_name, r.field_count, r.parse_status) for r in rows.orderBy("source_row_number").collect()]
    assert got == [(2, "Apple, Inc", 6, "valid_isin"), (3, "Apple Inc", 5, "valid_isin"), (4, "Apple, Inc", 5, "valid_isin"), (5, "NA", 5, "na_padding"),
                   (6, "Blank", 5, "blank_isin"), (7, "Bad", 5, "invalid_isin"), (8, None, 2, "unexpected_width")]
    profile = isin.isin_profile(rows).first()
    assert (profile.name_variants, profile.rows, profile.conflicting_duplicate, profile.latest_mktcap_as_supplied) == (2, 3, True, 7.0)
    assert isin.duplicate_listings(rows).count() == 2
    names = spark.createDataFrame([("US0378331005 ", "APPLE INC.")], "isin string, name string")
    assert isin.isin_name_comparison(rows, names).first().name_status == "exact_normalized_alias"


def test_a_profile_parses_its_list_once(spark):
    """Valid rows, and names of both lists, are written once; spans, names and conflicts read these."""
    text = ",Date,ISIN,CompanyName,MktCap\n1,2020-01-31,US0378331005,Apple, Inc,5\n2,2020-01-31,US0378331005,Apple Inc,6\n"
    rows = archives.parse_ragged_csv(table(spark, text.encode()))
    names = rows.select("isin", F.col("raw_company_name").alias("name"))
    for result, status in ((isin.isin_profile(rows), "rows"), (isin.isin_name_comparison(rows, names), "name_status")):
        assert "MapInArrow" not in result._jdf.queryExecution().executedPlan().toString()
        assert result.first()[status] in (2, "exact_normalized_alias")


def python_rows(text):
    import csv
    import io

    return list(csv.reader(io.StringIO(text, newline="")))


def test_csv_records_equal_pythons(spark, tmp_path, monkeypatch):
    """Blank rows, doubled quotes, quotes inside plain fields and quoted line breaks, with blocks that end within quotes."""
    rng = random.Random(6)
    monkeypatch.setattr(archives, "LINES", 3)
    pieces = ["a", "b c", '"x, y"', '"two\nlines"', '"say ""so"""', 'in"side', '"end"tail', '"\r\n\n"', "", "é", '""', '"a""\n""b"', '"1\n2\n3\n4\n5"']
    texts = ["\n".join(",".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\r"]) for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n"]) for _ in range(20)]
    texts += ["\ufeffa,b\n1,2\n", 'x,"open\nto the end', "a\n\n\nb\n"]
    got = {}
    for r in archives.csv_records(archives.stored_lines(table(spark, *[t.encode() for t in texts]))).collect():
        got.setdefault(r.source_sha256, []).append((r.record, r.fields))
    for text in texts:
        rows = [f for _, f in sorted(got[hashlib.sha256(text.encode()).hexdigest()])]
        assert rows == python_rows(text.removeprefix("\ufeff")), text


def test_csv_lines_in_any_layout_give_the_same_records(spark):
    """Lines dealt over tasks out of order are runs of one line each."""
    text = 'h\na,"open\n\nstill, open\nend",b\nplain,1\n\n"x"\n' * 7
    lines = archives.stored_lines(table(spark, text.encode())).repartition(5, "seq").sortWithinPartitions(F.desc("seq")).localCheckpoint()
    assert [r.fields for r in archives.csv_records(lines).orderBy("record").collect()] == python_rows(text)


def test_whole_csv_records_are_split_where_they_lie(spark):
    """No line of a plain file meets a shuffle or is sorted: a run is split in its task."""
    text = "".join(f"{i},2020-01-31,US0378331005,Apple, Inc,{i}\n" for i in range(100))
    records = archives.csv_records(archives.stored_lines(table(spark, text.encode())))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
    assert [r.fields for r in records.orderBy("record").collect()] == python_rows(text)


def test_a_large_csv_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(1)
    text = ",Date,ISIN,CompanyName,MktCap\n" + "".join(
        f'{i},2020-01-31,US0378331005,{rng.choice(["Apple, Inc", chr(34) + "Apple" + chr(10) + "Inc" + chr(34), "Apple"])},{i}\n' for i in range(3000))
    (tmp_path / "big.csv").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = archives.text_lines(spark, str(tmp_path / "big.csv"))
        assert lines.rdd.getNumPartitions() > 4 and lines.select("block").distinct().count() > 4
        records = archives.csv_records(lines)
        got = [r.fields for r in records.orderBy("record").collect()]
        assert archives.ragged_rows(records).where("parse_status = 'valid_isin'").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == python_rows(text)


HTML = """<html><ix:header><xbrli:context id="c1"><xbrli:period><xbrli:instant>2024-01-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrldi:explicitMember dimension="us-gaap:StatementClassOfStockAxis">us-gaap:CommonClassAMember</xbrldi:explicitMember><xbrli:instant>2024-02-01</xbrli:instant></xbrli:context></ix:header>
<ix:nonFraction name="dei:EntityCommonStockSharesOutstanding" contextRef="c2" scale="3"><b>1,234</b></ix:nonFraction>
<ix:nonFraction name="dei:EntityCommonStockSharesOutstanding" contextRef="c1" sign="-">5</ix:nonFraction>
<ix:nonFraction name="us-gaap:CommonStockSharesOutstanding" contextRef="c1" xsi:nil="true"></ix:nonFraction>
<ix:nonFraction name="us-gaap:CommonStockSharesOutstanding" contextRef="c1">—</ix:nonFraction>
<ix:nonNumeric name="dei:EntityCommonStockSharesOutstanding" contextRef="c1">77</ix:nonNumeric>
<ix:nonNumeric name="dei:TradingSymbol" contextRef="c2"> abc </ix:nonNumeric><ix:nonNumeric name="dei:Security12bTitle" contextRef="c2">Class A</ix:nonNumeric></html>"""


def test_tagged_document(spark):
    elements = documents.tagged_elements(spark.createDataFrame([(1, HTML), (2, None)], "doc long, html string"), "doc", "html").cache()
    facts = documents.extract_facts(elements, "doc")
    got = [(r.shares_outstanding, r.shares_as_of_date, r.class_member) for r in facts.orderBy("position").collect()]
    assert got == [(1234000.0, date(2024, 2, 1), "us-gaap:CommonClassAMember"), (-5.0, date(2024, 1, 31), None)]
    meta = documents.extract_class_metadata(elements, "doc")
    assert tuple(meta.select("class_member", "trading_symbol", "security_title").first()) == ("us-gaap:CommonClassAMember", "ABC", "Class A")
    row = filings.class_share_candidates(facts, meta, "doc").first()
    assert (row.trading_symbol, row.symbol_mapping_status) == ("ABC", "mapped_unique_symbol")


def test_json_rows_skip_what_does_not_parse(spark):
    good = json.dumps([{"date": "2020-01-02", "split": "2/1"}, {"date": "bad"}, {"split": "1/1"}])
    df = spark.createDataFrame([("a", good), ("b", "{broken"), ("c", None)], "k string, p string")
    rows = payloads.json_observations(df, "p", {"day": ("date", "date"), "split": ("split", "string")}, ["day"]).collect()
    assert [tuple(r) for r in rows] == [("a", date(2020, 1, 2), "2/1")]
    periods = json.dumps({"2020-03-31": {"commonStockSharesOutstanding": "0", "filing_date": ""}, "x": {"date": "2020-06-30", "commonStockSharesOutstanding": "12.5", "filing_date": "2020-07-01"}})
    rows = payloads.json_map_rows(spark.createDataFrame([("a", periods)], "k string, p string"), "p").orderBy("period_date").collect()
    assert [(r.period_date, r.filing_date, r.shares_outstanding) for r in rows] == [(date(2020, 3, 31), None, None), (date(2020, 6, 30), date(2020, 7, 1), 12.5)]


def test_bulk_day_alias_and_date(spark):
    def response(rows):
        raw = json.dumps(rows).encode()
        return spark.createDataFrame([(date(2019, 8, 23), bytearray(raw), hashlib.sha256(raw).hexdigest())], "requested_date date, raw_response_bytes binary, response_sha256 string")

    def bar(code, day="2019-08-23", low=1.0):
        return {"date": day, "code": code, "open": 1.5, "high": 2.0, "low": low, "close": 1.5, "volume": 3}

    known = spark.createDataFrame([(date(2019, 8, 23), t) for t in ("BRK.A", "X-Y", "Z")], "date date, ticker string")
    got = payloads.bulk_day_rows(response([bar("BRK-A"), bar("X-Y"), bar("Z", low=5.0), bar("Q")]), known).collect()
    assert sorted((r.ticker, r.provider_code, r.bar_valid, r.close) for r in got) == [("BRK.A", "BRK-A", True, 1.5), ("X-Y", "X-Y", True, 1.5), ("Z", "Z", False, None)]
    with pytest.raises(Exception, match="another date"):
        payloads.bulk_day_rows(response([bar("Z", "2019-08-22")]), known).collect()


def test_publish_keeps_the_old_version_when_a_check_fails(spark, tmp_path):
    folder = str(tmp_path / "t")
    mutate.publish_atomic(spark.range(3), folder)
    with pytest.raises(ValueError):
        mutate.publish_atomic(spark.range(3).union(spark.range(1)), folder, lambda t: assert_unique(t, ["id"]))
    assert mutate.read_published(spark, folder).count() == 3


def test_seed_must_match_exactly_one_span(spark):
    seed = spark.createDataFrame([("A", date(2020, 1, 5))], "ticker string, event_date date")
    span = [("A", date(2020, 1, 1), date(2020, 1, 31), 7)]
    spans = spark.createDataFrame(span, "ticker string, start_date date, end_date date, security_id long")
    args = ("ticker", "event_date", "start_date", "end_date", "security_id")
    assert mutate.resolve_seed(seed, spans, *args).first().security_id == 7
    with pytest.raises(Exception, match="matches 2 spans"):
        mutate.resolve_seed(seed, spans.union(spans), *args).collect()
    with pytest.raises(Exception, match="matches 0 spans"):
        mutate.resolve_seed(seed, spans.where("security_id = 0"), *args).collect()


def test_ingest_is_resumable(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"one")
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    ingest_new_files(*args).awaitTermination(120)
    (folder / "b.bin").write_bytes(b"two")
    (folder / "copy.bin").write_bytes(b"one")
    ingest_new_files(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_plain_documents_are_walked_like_others(monkeypatch):
    def tolerant(text):
        parser = documents._Elements()
        parser.feed(text)
        parser.close()
        return parser.rows

    fact = '<ix:nonFraction NAME="dei:EntityCommonStockSharesOutstanding" scale="3" contextRef="c1">5 <b>&amp;</b>\n0</ix:nonFraction>'
    context = '<x:context id="c1"><instant>1999-01-02</instant><x:explicitMember dimension="d">A &lt; B</x:explicitMember></x:context>'
    plain = ["", "text", context + fact, f"<DIV>{fact}<br/>{fact}</DIV >tail", "<instant>a<instant>b</instant>c</instant>", "<instant/>x<p>", "<instant>never closed"]
    odd = [f"<!-- {fact} -->{fact}", f"<script>{fact}</script>{fact}", f"<a href=x>{fact}", "a < b" + fact, fact.replace('"3"', '"&#51;"'), fact + "a &amp", "</p x=\"1\">" + fact, fact + "<instant"]
    for text in [*plain, *odd]:
        assert documents._walk(text) == tolerant(text), text
    assert all(documents._plain_events(t) is not None for t in plain) and all(documents._plain_events(t) is None for t in odd)

    wanted = tolerant(context + fact)
    monkeypatch.setattr(documents._Elements, "feed", lambda *_: pytest.fail("a plain document went to the tolerant parser"))
    assert documents._walk(context + fact) == wanted


def test_ingest_stores_files_in_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    content = {"a b%.bin": random.Random(1).randbytes(2 * BLOCK_BYTES + 5), "one.bin": b"\xff\x00"}
    for name, data in content.items():
        (folder / name).write_bytes(data)
    ingest_new_files(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    blocks = spark.read.parquet(str(tmp_path / "out"))
    assert blocks.count() == 4 and blocks.where(F.length("raw_bytes") > BLOCK_BYTES).count() == 0
    want = {(hashlib.sha256(d).hexdigest(), len(d)) for d in content.values()}
    assert {(r.source_sha256, r.source_bytes) for r in stored_files(blocks).collect()} == want
    assert {bytes(r.raw_bytes) for r in whole_files(blocks).collect()} == set(content.values())
