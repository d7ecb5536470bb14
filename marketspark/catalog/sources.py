"""Queries for sources, sinks, mutations, checks and filing documents (SRC, SNK, MUT, DQ, STR-1, TB-58, TB-64, TB-75 to TB-81)."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.catalog.views import CHECKS
from marketspark.operators import mutate as U
from marketspark.operators import quality as Q
from marketspark.plans import filings as G
from marketspark.plans import isin as N
from marketspark.sources import archives as A
from marketspark.sources import documents as D
from marketspark.sources import payloads as Y
from marketspark.sources import readers, sinks
from marketspark.streaming.ingest import ingest_new_files, stored_files


def _folder(v):
    """A place for written output: the checkpoint folder, as it is shared on a cluster."""
    from marketspark.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(v.spark)
    return f"{base}/out-{uuid4().hex}"


@query("src1_read_table", "SELECT * FROM nation")
def _(v):
    return readers.read_table(v.spark, v.folder, "nation")


@query("src2_read_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def _(v):
    return readers.read_parquet(v.spark, f"{v.folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("src3_json_observations", "SELECT l_orderkey, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem WHERE l_linenumber <> 7", doubles="price:2")
def _(v):
    item = F.struct(F.to_date("l_shipdate").cast("string").alias("date"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("close"), F.col("l_quantity").cast("long").alias("volume"))
    landed = v.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("payload"))
    return Y.json_observations(landed, "payload", {"date": ("date", "date"), "price": ("close", "double"), "volume": ("volume", "bigint")}, ["date", "price"])


@query("src4_json_map_rows", "SELECT ticker, period_date, filing_date, CASE WHEN currency_symbol = 'USD' THEN shares_outstanding END AS shares_outstanding, currency_symbol FROM filings", doubles="shares_outstanding:2")
def _(v):
    value = F.struct(F.col("period_date").cast("string").alias("date"), F.col("filing_date").cast("string").alias("filing_date"), "currency_symbol",
                     F.when(F.col("currency_symbol") == "USD", F.col("shares_outstanding").cast("string")).otherwise("0").alias("commonStockSharesOutstanding"))
    entry = F.struct(F.col("period_date").cast("string").alias("k"), value.alias("v"))
    landed = v.filings.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return Y.json_map_rows(landed, "payload")


def _entities(v):
    members = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.sort_array(F.collect_list("s_name")).alias("tickers"))
    shorter = F.transform(F.slice("tickers", 1, F.greatest(F.size("tickers") - 1, F.lit(0))), lambda t: F.concat(F.lit("X"), F.substring(t, -1, 1)))
    former = F.array(F.struct(F.lower("n_name").alias("name"), F.lit("1990-01-01").alias("from"), F.lit("1995-01-01").alias("to")))
    return members.select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("cik"), F.col("n_name").alias("name"), "tickers", shorter.alias("exchanges"), former.alias("formerNames"))).alias("payload"))


@query("src5_submission_tickers", """SELECT lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, s_name AS ticker, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) < count(*) OVER (PARTITION BY s_nationkey) THEN 'X' || s_name[-1:] END AS exchange FROM supplier""")
def _(v):
    return Y.explode_submissions(_entities(v), "payload")["ticker"]


@query("src5_submission_former_names", "SELECT DISTINCT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, lower(n_name) AS former_name, '1990-01-01' AS from_date, '1995-01-01' AS to_date FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _(v):
    return Y.explode_submissions(_entities(v), "payload")["former_name"]


def _blocks(v):
    s = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("a"), F.to_date("o_orderdate").cast("string").alias("d"), F.col("o_orderpriority").alias("f"))))
    grouped = v.orders.groupBy("o_custkey").agg(s.alias("s"))
    block = F.struct(F.col("s.a").alias("accessionNumber"), F.col("s.d").alias("filingDate"), F.col("s.f").alias("form"))
    return grouped.select("o_custkey", F.to_json(block).alias("payload"))


@query("src6_zip_columns", """SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS "accessionNumber", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "filingDate", o_orderpriority AS form FROM orders""")
def _(v):
    return Y.zip_columns(_blocks(v), "payload", ["accessionNumber", "filingDate", "form"])


@query("tb81_filing_selection", "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filing_date, o_orderpriority AS form FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(v):
    rows = Y.zip_columns(_blocks(v), "payload", ["accessionNumber", "filingDate", "form"])
    typed = rows.select("o_custkey", F.col("accessionNumber").alias("accession"), F.to_date("filingDate").alias("filing_date"), "form")
    return G.select_filings(typed, "filing_date", "form", "1996-01-01", "1998-06-30", ["1-URGENT", "2-HIGH"])


@query("src7_flatten_facts", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS entity_name, CASE WHEN l_returnflag = 'R' THEN 'shares' ELSE 'units' END AS unit, l_extendedprice AS shares_outstanding, CAST(l_shipdate AS DATE) AS shares_as_of_date, CAST(l_shipdate AS DATE) AS filed_date, l_linestatus AS form, CAST(l_orderkey AS VARCHAR) AS accession_number FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""", doubles="shares_outstanding:2")
def _(v):
    day = F.to_date("l_shipdate").cast("string")
    fact = F.struct(F.col("l_extendedprice").alias("val"), day.alias("end"), day.alias("filed"), F.col("l_linestatus").alias("form"), F.col("l_orderkey").cast("string").alias("accn"))
    unit = F.when(F.col("l_returnflag") == "R", "shares").otherwise("units")
    per_order = v.lineitem.join(v.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_suppkey", "s_name", "l_orderkey", unit.alias("u")).agg(F.collect_list(fact).alias("f"))
    units = F.create_map(F.col("u"), F.col("f"))
    facts = F.create_map(F.lit("dei"), F.create_map(F.lit(D.CONCEPTS[0][4:]), F.struct(units.alias("units"))))
    landed = per_order.select(F.to_json(F.struct(F.col("l_suppkey").cast("string").alias("cik"), F.col("s_name").alias("entityName"), facts.alias("facts"))).alias("payload"))
    return Y.flatten_facts(landed, "payload", "dei", D.CONCEPTS[0][4:])


@query("src8_ticker_map", "SELECT s_name AS ticker, CASE WHEN s_acctbal > 0 THEN CAST(s_nationkey AS VARCHAR) END AS cik, CASE WHEN s_acctbal > 5000 THEN lower(s_name) END AS old_ticker, s_acctbal < 0 AS flat_file_only FROM supplier")
def _(v):
    value = F.struct(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("string")).alias("cik"), F.when(F.col("s_acctbal") > 5000, F.lower("s_name")).alias("old_ticker"), F.when(F.col("s_acctbal") < 0, True).alias("flat_file_only"))
    landed = v.supplier.select(F.to_json(F.create_map("s_name", value)).alias("payload"))
    return Y.explode_ticker_map(landed, "payload")


def _zip_bytes(texts: pd.Series) -> pd.Series:
    import io
    from zipfile import ZIP_DEFLATED, ZipFile, ZipInfo

    out = []
    for text in texts:
        buffer = io.BytesIO()
        with ZipFile(buffer, "w", ZIP_DEFLATED) as archive:
            archive.writestr(ZipInfo("data.txt"), text.encode("latin-1"))
        out.append(buffer.getvalue())
    return pd.Series(out)


_FIELDS = ("calc_date", "security_name", "security_code", "shares_today", "closing_shares")


def _archives(v):
    """One self-describing ZIP archive per week and table, made from the order lines."""
    from pyspark.sql import types as T

    def definition(i, name):
        return f"#{i:3d} {'field':<34}{name:<30} S 20 0".ljust(A.DEFINITION_WIDTH)[: A.DEFINITION_WIDTH]

    head = "\n".join(["*", *[definition(i + 1, n) for i, n in enumerate(_FIELDS)]])
    line = F.concat(F.lit("|"), F.concat_ws("|", F.date_format("l_shipdate", "yyyyMMdd"), F.concat(F.lit(" S"), F.col("l_suppkey")), F.col("l_partkey").cast("string"),
                    F.when(F.col("l_tax") <= 0.005, "bad").otherwise(F.col("l_quantity").cast("long").cast("string")), F.when(F.col("l_discount") <= 0.005, "").otherwise(F.col("l_linenumber").cast("string"))), F.lit("|"))
    text = v.lineitem.groupBy(F.date_trunc("week", "l_shipdate").alias("w")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body")).select(F.concat(F.lit(head + "\n"), F.col("body")).alias("text"))
    zipped = F.pandas_udf(_zip_bytes, T.BinaryType())
    return v.keep("archives", lambda: text.select(zipped("text").alias("raw_bytes")).withColumns({"source_sha256": F.sha2("raw_bytes", 256), "source_bytes": F.length("raw_bytes").cast("long")}))


CHECKS["d_archive"] = """SELECT CAST(l_shipdate AS DATE) AS observation_date, 'S' || l_suppkey AS security_name, CAST(l_partkey AS VARCHAR) AS security_code, CASE WHEN l_tax <= 0.005 THEN 'bad' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS shares_today_raw, CASE WHEN l_discount <= 0.005 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS closing_shares_raw,
    CASE WHEN l_tax > 0.005 THEN l_quantity END AS shares_today, CASE WHEN l_discount > 0.005 THEN CAST(l_linenumber AS DOUBLE) END AS closing_shares, CASE WHEN l_tax <= 0.005 THEN 'invalid_number' ELSE 'shares_present' END AS parse_status FROM lineitem"""


def _archive_rows(v):
    return A.dictionary_rows(A.archive_lines(_archives(v)), _FIELDS, len(_FIELDS))


@query("src10_dictionary_archive", "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CAST(l_partkey AS VARCHAR) AS code, 'S' || l_suppkey AS name FROM lineitem")
def _(v):
    item = F.col("item")
    return _archive_rows(v).select(F.to_date(item["calc_date"], "yyyyMMdd").cast("string").alias("day"), item["security_code"].alias("code"), item["security_name"].alias("name"))


@query("tb58_archive_observation", "SELECT * FROM d_archive")
def _(v):
    rows = A.archive_observations(_archive_rows(v), {"security_name": "security_name", "security_code": "security_code"}, {"shares_today": "shares_today", "closing_shares": "closing_shares"}, ["shares_today", "closing_shares"])
    return rows.drop("source_sha256", "source_row_number")


@query("dq11_stored_digest", "SELECT count(DISTINCT date_trunc('week', l_shipdate)) AS archives FROM lineitem", ints="archives")
def _(v):
    return _archives(v).select(Q.digest_matches("raw_bytes", "source_sha256").alias("b")).agg(F.count("b").alias("archives"))


@query("src9_archive_files")
def _(v):
    files = A.archive_files(v.spark, f"{v.folder}/*.parquet")
    return A.new_archives(files.limit(0), files).select("source_sha256", "source_bytes")


_ISIN = "'US' || upper(substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 9)) || CAST(l_linenumber AS VARCHAR)"


def _csv_files(v):
    isin = F.concat(F.lit("US"), F.upper(F.substring(F.md5(F.col("l_suppkey").cast("string")), 1, 9)), F.col("l_linenumber").cast("string"))
    name = F.when(F.col("l_tax") >= 0.075, F.concat(F.lit("Firm "), F.col("l_suppkey"), F.lit(", Inc"))).otherwise(F.concat(F.lit("Firm "), F.col("l_suppkey")))
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.to_date("l_shipdate").cast("string"), F.when(F.col("l_discount") <= 0.005, "").otherwise(isin), name, F.when(F.col("l_quantity") <= 1, "x").otherwise(F.col("l_extendedprice").cast("string")))
    body = v.lineitem.groupBy(F.date_trunc("week", "l_shipdate").alias("w")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    raw = F.encode(F.concat(F.lit(",Date,ISIN,CompanyName,MktCap\n"), F.col("b")), "UTF-8")
    return v.keep("csv_files", lambda: body.select(raw.alias("raw_bytes")).withColumn("source_sha256", F.sha2("raw_bytes", 256)))


CHECKS["d_csv"] = f"""SELECT CAST(l_orderkey AS VARCHAR) AS source_index, CAST(l_shipdate AS DATE) AS observation_date, CASE WHEN l_discount <= 0.005 THEN '' ELSE {_ISIN} END AS isin, 'Firm ' || l_suppkey || CASE WHEN l_tax >= 0.075 THEN ', Inc' ELSE '' END AS raw_company_name, CASE WHEN l_quantity > 1 THEN l_extendedprice END AS mktcap_as_supplied, CASE WHEN l_tax >= 0.075 THEN 6 ELSE 5 END AS field_count FROM lineitem"""


@query("src11_ragged_csv", "SELECT *, CASE WHEN mktcap_as_supplied IS NULL THEN 'invalid_date_or_cap' WHEN isin = '' THEN 'blank_isin' ELSE 'isin' END AS status FROM d_csv", doubles="mktcap_as_supplied:2")
def _(v):
    rows = A.parse_ragged_csv(_csv_files(v))
    status = F.when(F.col("parse_status").isin("valid_isin", "invalid_isin"), "isin").otherwise(F.col("parse_status"))
    return rows.select("source_index", "observation_date", "isin", "raw_company_name", "mktcap_as_supplied", "field_count", status.alias("status"))


def _listing(v):
    return A.parse_ragged_csv(_csv_files(v))  # not kept: the rows are several times the size of the files


CHECKS |= {
    "d_code": "SELECT DISTINCT isin FROM d_csv WHERE isin <> '' AND mktcap_as_supplied IS NOT NULL",
    "d_digit": "SELECT isin, array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS d FROM d_code",
    "d_place": "SELECT isin, CAST(substr(d, i, 1) AS INT) * CASE WHEN (length(d) - i) % 2 = 1 THEN 2 ELSE 1 END AS x FROM (SELECT isin, d, unnest(range(1, length(d) + 1)) AS i FROM d_digit) p",
    "d_checked": "SELECT isin, sum(x // 10 + x % 10) % 10 = 0 AS valid FROM d_place GROUP BY isin",
    "d_valid": "SELECT c.*, raw_company_name AS name FROM d_csv c JOIN d_checked k USING (isin) WHERE k.valid AND c.mktcap_as_supplied IS NOT NULL",
}


@query("tb64_isin_profile", """SELECT isin, min(observation_date) AS first_date, max(observation_date) AS last_date, count(DISTINCT name) AS name_variants, count(*) AS rows, string_agg(DISTINCT name, ' | ' ORDER BY name) AS all_names,
    (SELECT bool_or(n > 1) FROM (SELECT count(DISTINCT (name, mktcap_as_supplied)) AS n FROM d_valid w WHERE w.isin = v.isin GROUP BY observation_date) x) AS conflicting_duplicate FROM d_valid v GROUP BY isin""", ints="name_variants rows")
def _(v):
    return N.isin_profile(_listing(v)).drop("latest_name", "latest_mktcap_as_supplied")  # the latest among equal dates depends on the row number


@query("tb64_invalid_isins", "SELECT isin, count(*) AS rows FROM d_csv JOIN d_checked USING (isin) WHERE NOT valid AND mktcap_as_supplied IS NOT NULL GROUP BY isin", ints="rows")
def _(v):
    return N.invalid_isins(_listing(v))


@query("tb64_duplicate_listings", "SELECT * FROM (SELECT observation_date, isin, name, mktcap_as_supplied, count(*) OVER (PARTITION BY observation_date, isin) AS listings FROM d_valid) d WHERE listings > 1", ints="listings", doubles="mktcap_as_supplied:2")
def _(v):
    return N.duplicate_listings(_listing(v)).drop("source_row_number")


@query("tb64_isin_name_comparison", """WITH own AS (SELECT DISTINCT isin, name FROM d_valid), ref AS (SELECT DISTINCT isin, upper(name) || CASE WHEN name LIKE '%Inc' THEN '' ELSE ' INC' END AS name FROM d_valid WHERE observation_date >= DATE '1998-01-01')
    SELECT o.isin, CASE WHEN NOT EXISTS (SELECT 1 FROM ref r WHERE r.isin = o.isin) THEN 'no_reference_isin' WHEN bool_or(EXISTS (SELECT 1 FROM ref r WHERE r.isin = o.isin AND regexp_replace(upper(r.name), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(o.name), '[^A-Z0-9]', '', 'g'))) THEN 'exact_normalized_alias' ELSE 'name_review' END AS name_status FROM own o GROUP BY o.isin""")
def _(v):
    rows = _listing(v).where("parse_status = 'valid_isin' AND observation_date >= DATE '1998-01-01'")
    name = F.col("raw_company_name")
    known = rows.select("isin", F.concat(F.upper(name), F.when(name.endswith("Inc"), "").otherwise(" INC")).alias("name"))
    return N.isin_name_comparison(_listing(v), known).drop("best_name_similarity")


def _documents(v):
    """A tagged document per order: a context, a fact and a symbol for each of its lines."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string").alias("d"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag", "l_tax")))

    def context(x, i):
        return F.concat(F.lit('<xbrli:context id="c'), i.cast("string"), F.lit('"><period><instant>'), x["d"], F.lit('</instant></period><xbrldi:explicitMember dimension="us-gaap:StatementClassOfStockAxis">Class'), x["l_returnflag"], F.lit("</xbrldi:explicitMember></xbrli:context>"))

    def fact(x, i):
        nil = F.when(x["l_tax"] <= 0.005, ' xsi:nil="true"').otherwise("")
        return F.concat(F.lit('<p>x <ix:nonFraction name="dei:EntityCommonStockSharesOutstanding" scale="3" contextRef="c'), i.cast("string"), F.lit('"'), nil, F.lit(">"), x["q"].cast("string"), F.lit(",0</ix:nonFraction></p>"))

    def symbol(x, i):
        return F.concat(F.lit('<ix:nonNumeric name="dei:TradingSymbol" contextRef="c'), i.cast("string"), F.lit('"> s'), (x["l_suppkey"] % 2).cast("string"), F.lit(" </ix:nonNumeric>"))

    grouped = v.lineitem.groupBy("l_orderkey").agg(rows.alias("r"))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform("r", context), ""), F.array_join(F.transform("r", fact), "\n"), F.array_join(F.transform("r", symbol), ""), F.lit("</body></html>"))
    return grouped.select("l_orderkey", html.alias("html"))


def _elements(v):
    return v.keep("elements", lambda: D.tagged_elements(_documents(v), "l_orderkey", "html"))


CHECKS["d_fact"] = "SELECT l_orderkey, CAST(l_shipdate AS DATE) AS shares_as_of_date, l_quantity * 10000 AS shares_outstanding, 'Class' || l_returnflag AS class_member, 'S' || (l_suppkey % 2) AS symbol, l_tax > 0.005 AS stated FROM lineitem"


@query("src12_document_facts", "SELECT l_orderkey, shares_as_of_date, shares_outstanding, 'dei' AS taxonomy, class_member FROM d_fact WHERE stated", doubles="shares_outstanding:0")
def _(v):
    return D.extract_facts(_elements(v), "l_orderkey").select("l_orderkey", "shares_as_of_date", "shares_outstanding", "taxonomy", "class_member")


@query("src13_class_metadata", "SELECT l_orderkey, class_member, symbol AS trading_symbol FROM d_fact")
def _(v):
    return D.extract_class_metadata(_elements(v), "l_orderkey").select("l_orderkey", "class_member", "trading_symbol")


@query("src12_page_elements")
def _(v):
    return D.tagged_elements(v.pages, "page_id", "html")


def _facts(v):
    return v.keep("facts", lambda: D.extract_facts(_elements(v), "l_orderkey"))


@query("tb75_filing_shares", """SELECT l_orderkey, max(shares_as_of_date) AS shares_as_of_date, sum(shares_outstanding) AS shares_outstanding, CASE WHEN count(*) = 1 THEN 'dei_single' ELSE 'dei_sum_classes' END AS resolution_method, count(*) AS component_count, 'dei:EntityCommonStockSharesOutstanding' AS source_concept
    FROM (SELECT DISTINCT l_orderkey, shares_as_of_date, shares_outstanding, class_member FROM d_fact WHERE stated) f WHERE shares_as_of_date = (SELECT max(g.shares_as_of_date) FROM d_fact g WHERE g.l_orderkey = f.l_orderkey AND g.stated) GROUP BY l_orderkey""", doubles="shares_outstanding:0", ints="component_count")
def _(v):
    return G.resolve_filing_shares(_facts(v), ["l_orderkey"])


def _metadata(v):
    return v.keep("class_metadata", lambda: D.extract_class_metadata(_elements(v), "l_orderkey"))


def _class_rows(v):
    return G.class_share_candidates(_facts(v), _metadata(v), "l_orderkey")


CHECKS["d_class"] = """SELECT f.l_orderkey, f.shares_as_of_date, f.shares_outstanding, f.class_member, CASE WHEN m.n = 1 THEN m.s END AS trading_symbol, CASE WHEN m.n = 1 THEN 'mapped_unique_symbol' ELSE 'ambiguous_trading_symbol' END AS symbol_mapping_status FROM d_fact f JOIN (SELECT l_orderkey, class_member, count(DISTINCT symbol) AS n, min(symbol) AS s FROM d_fact GROUP BY 1, 2) m USING (l_orderkey, class_member) WHERE f.stated"""


@query("tb76_class_candidate", "SELECT * FROM d_class", doubles="shares_outstanding:0")
def _(v):
    return _class_rows(v).select("l_orderkey", "shares_as_of_date", "shares_outstanding", "class_member", "trading_symbol", "symbol_mapping_status")


@query("tb76_filing_audit", """SELECT f.l_orderkey, count(*) FILTER (WHERE f.stated) AS fact_rows, count(*) AS metadata_rows, count(*) FILTER (WHERE f.stated) AS class_fact_rows, (SELECT count(*) FROM d_class c WHERE c.l_orderkey = f.l_orderkey AND c.trading_symbol IS NOT NULL) AS mapped_rows FROM d_fact f GROUP BY f.l_orderkey HAVING count(*) FILTER (WHERE f.stated) > 0""", ints="fact_rows metadata_rows class_fact_rows mapped_rows")
def _(v):
    return G.class_filing_audit(_class_rows(v), _facts(v), _metadata(v), "l_orderkey")


_CLASS = """SELECT o_custkey AS cik, o_orderpriority AS class_member, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession_number, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 450000 THEN 'B' ELSE 'a' END END AS trading_symbol, CASE WHEN o_orderstatus = 'F' THEN 'mapped_unique_symbol' ELSE 'no_trading_symbol' END AS symbol_mapping_status FROM orders"""


@query("tb77_class_symbol_evidence", f"""WITH c AS ({_CLASS}), h AS (SELECT cik, class_member, count(DISTINCT upper(trading_symbol)) AS n, min(upper(trading_symbol)) AS s FROM c WHERE trading_symbol IS NOT NULL GROUP BY 1, 2)
    SELECT c.cik, c.class_member, c.accession_number, CASE WHEN c.cik < 10 THEN 'documented_ticker_change' WHEN h.n IS NULL THEN 'no_symbol_evidence' WHEN h.n > 1 THEN 'multiple_historical_symbols' WHEN EXISTS (SELECT 1 FROM c e WHERE e.cik = c.cik AND e.class_member = c.class_member AND e.trading_symbol IS NOT NULL AND e.filing_date <= c.filing_date)
        THEN CASE WHEN EXISTS (SELECT 1 FROM c e WHERE e.cik = c.cik AND e.class_member = c.class_member AND e.trading_symbol IS NOT NULL AND e.filing_date >= c.filing_date) THEN 'bracketed_same_symbol' ELSE 'earlier_evidence_only' END ELSE 'later_evidence_only' END AS evidence_status,
    CASE WHEN c.cik < 10 THEN CASE WHEN c.filing_date < DATE '1998-01-01' THEN 'OLD' ELSE 'NEW' END WHEN h.n = 1 THEN h.s END AS possible_symbol FROM c LEFT JOIN h USING (cik, class_member) WHERE c.trading_symbol IS NULL""")
def _(v):
    changes = v.orders.where("o_custkey < 10").select(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("class_member")).distinct().withColumns({"change_date": F.lit("1998-01-01").cast("date"), "symbol_before": F.lit("OLD"), "symbol_after": F.lit("NEW")})
    return G.class_symbol_evidence(v.sql(_CLASS), changes).select("cik", "class_member", "accession_number", "evidence_status", "possible_symbol")


@query("src14_bulk_day", """SELECT date, replace(ticker, '#', '.') AS ticker, replace(ticker, '#', '-') AS provider_code, CASE WHEN volume > 40 THEN NULL ELSE close END AS close, volume <= 40 AS bar_valid FROM vendor_bars""", doubles="close")
def _(v):
    row = F.struct(F.col("date").cast("string").alias("date"), F.replace("ticker", F.lit("#"), F.lit("-")).alias("code"), F.col("close").alias("open"), F.when(F.col("volume") > 40, F.col("close") / 2).otherwise(F.col("close")).alias("high"), F.col("close").alias("low"), "close", "volume")
    landed = v.vendor_bars.groupBy(F.col("date").alias("requested_date")).agg(F.encode(F.to_json(F.collect_list(row)), "UTF-8").alias("raw_response_bytes")).withColumn("response_sha256", F.sha2("raw_response_bytes", 256))
    known = v.vendor_bars.select("date", F.replace("ticker", F.lit("#"), F.lit(".")).alias("ticker"))
    return Y.bulk_day_rows(landed, known).select("date", "ticker", "provider_code", "close", "bar_valid")


@query("src15_values", """SELECT o.o_orderkey, q.weight FROM orders o JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3)) q(priority, weight) ON q.priority = o.o_orderpriority""", ints="weight")
def _(v):
    weights = readers.values_df(v.spark, [("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3)], "o_orderpriority string, weight long")
    return v.orders.join(weights, "o_orderpriority").select("o_orderkey", "weight")


@query("src16_evidence", "SELECT ticker, provider_symbol, date, close, adjusted_close, volume FROM validation_bars", doubles="close adjusted_close")
def _(v):
    rows = v.validation_bars.withColumns({"low": F.col("close"), "high": F.col("close"), "retrieved_at": F.col("date").cast("timestamp")})
    return readers.as_evidence(rows, "price_validation").select("ticker", "provider_symbol", "date", "close", "adjusted_close", "volume")


@query("snk1_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", doubles="o_totalprice:2")
def _(v):
    path = _folder(v)
    sinks.write_parquet(v.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return v.spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("snk2_csv", "SELECT s_suppkey, s_name FROM supplier")
def _(v):
    path = _folder(v)
    sinks.write_csv(v.supplier.select("s_suppkey", "s_name"), path)
    return v.spark.read.schema("s_suppkey long, s_name string").option("header", True).csv(path)


@query("snk3_summary", "SELECT count(*) AS rows, count(DISTINCT security_id) AS entities, min(date) AS min_date, max(date) AS max_date, avg(target) AS positive_rate FROM signals", doubles="positive_rate", ints="rows entities")
def _(v):
    path = _folder(v)
    sinks.write_json(sinks.export_summary(v.signals, "security_id", "date", "target"), path)
    return v.spark.read.schema("rows long, entities long, min_date date, max_date date, positive_rate double").json(path)


@query("snk4_materialize", "SELECT security_id, date, volume FROM bars")
def _(v):
    return sinks.materialize(v.bars.select("security_id", "date", "volume"), _folder(v))


@query("snk5_stage_view", "SELECT security_id, count(*) AS n FROM bars GROUP BY security_id", ints="n")
def _(v):
    sinks.stage_view(v.bars, "staged_bars")
    return v.spark.sql("SELECT security_id, count(*) AS n FROM staged_bars GROUP BY security_id")


def _old(v):
    return v.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _new(v):
    return v.orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))


@query("mut1_append_new", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'N' END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'")
def _(v):
    return U.append_new(_old(v), _new(v), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("mut2_upsert", "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'")
def _(v):
    return U.upsert(_old(v), _new(v), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("mut3_replace_keys", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT 'O', o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def _(v):
    rows = v.orders.select("o_orderstatus", "o_orderkey")
    incoming = v.orders.where("o_orderstatus = 'O' AND o_totalprice > 100000").select("o_orderstatus", (F.col("o_orderkey") + 1000000000).alias("o_orderkey"))
    return U.replace_keys(rows, incoming, ["o_orderstatus"])


@query("mut5_ensure_columns", "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS guard_status, s_name FROM supplier")
def _(v):
    return U.ensure_columns(v.supplier.select("s_suppkey", "s_name"), {"guard_status": "string", "s_name": "string"})


@query("mut8_publish", "SELECT s_suppkey, s_name FROM supplier")
def _(v):
    folder = _folder(v)
    U.publish_atomic(v.supplier.select("s_suppkey", "s_name"), folder, lambda t: Q.assert_unique(t, ["s_suppkey"]))
    return U.read_published(v.spark, folder)


@query("mut9_snapshot", "SELECT n_nationkey, n_name FROM nation")
def _(v):
    return U.snapshot(v.nation.select("n_nationkey", "n_name"), _folder(v), "nation")


@query("dq1_schema", "SELECT o_orderkey FROM orders")
def _(v):
    return Q.validate_schema(v.orders, ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("dq2_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", ints="rows")
def _(v):
    return Q.duplicate_keys(v.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq3_orphans", "SELECT security_id, date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM vendor_bars v WHERE v.security_id = b.security_id AND v.date = b.date)")
def _(v):
    return Q.orphans(v.bars.select("security_id", "date"), v.vendor_bars, ["security_id", "date"])


@query("dq4_assignments", "SELECT c_custkey AS o_custkey, count(o_orderkey) AS assignments FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1", ints="assignments")
def _(v):
    return Q.assignment_problems(v.customer.select(F.col("c_custkey").alias("o_custkey")), v.orders, "o_custkey")


@query("dq5_row_drift", "SELECT (SELECT count(*) FROM bars) AS rows_before, (SELECT count(*) FROM vendor_bars) AS rows_after, abs((SELECT count(*) FROM vendor_bars) - (SELECT count(*) FROM bars)) / (SELECT count(*) FROM bars) AS drift", ints="rows_before rows_after", doubles="drift")
def _(v):
    return Q.row_drift(v.bars, v.vendor_bars)


@query("dq6_values", "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (l_discount BETWEEN 0.01 AND 0.09)) AS discount, 0 AS price FROM lineitem", ints="rows discount price")
def _(v):
    return Q.violation_counts(v.lineitem, {"discount": F.col("l_discount").between(0.01, 0.09), "price": Q.finite("l_extendedprice")})


@query("dq7_leakage", "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') AS date_outside, count(*) FILTER (WHERE target_end_date <= date) AS label_not_after_date, count(*) FILTER (WHERE target_end_date > DATE '2000-12-31') AS label_outside FROM signals", ints="rows date_outside label_not_after_date label_outside")
def _(v):
    return Q.violation_counts(v.signals, Q.leakage_rules("1996-01-01", "2000-12-31"))


@query("dq8_constraints", "SELECT count(*) AS rows, count(*) FILTER (WHERE filing_date IS NULL) AS filed, count(*) FILTER (WHERE period_date > filing_date OR filing_date IS NULL) AS ordered FROM landed_filings", ints="rows filed ordered")
def _(v):
    return Q.violation_counts(v.landed_filings, {"filed": F.col("filing_date").isNotNull(), "ordered": F.col("period_date") <= F.col("filing_date")})


@query("dq9_table_counts", "SELECT 'bars' AS table_name, count(*) AS rows, count(DISTINCT security_id) AS entities FROM bars UNION ALL SELECT 'vendor', count(*), count(DISTINCT security_id) FROM vendor_bars", ints="rows entities")
def _(v):
    return Q.table_counts({"bars": v.bars, "vendor": v.vendor_bars}, "security_id")


@query("dq10_unpublished", "SELECT b.security_id, b.date, b.volume FROM bars b LEFT JOIN vendor_bars v ON v.security_id = b.security_id AND v.date = b.date WHERE b.volume IS DISTINCT FROM v.volume")
def _(v):
    return Q.unpublished(v.bars.select("security_id", "date", "volume"), v.vendor_bars, ["security_id", "date"], "volume", "volume")


@query("str1_resumable_ingest")
def _(v):
    folder = _folder(v)
    for _ in range(2):  # the second run finds nothing new
        ingest_new_files(v.spark, v.folder, f"{folder}/table", f"{folder}/state", "*.parquet").awaitTermination()
    return stored_files(v.spark.read.parquet(f"{folder}/table")).select("source_sha256", "source_bytes")


@query("run1_evaluate_and_persist")
def _(v):
    from marketspark.plans.models import evaluate_and_persist, prediction_frame

    rows = v.signals.withColumn("ticker", F.col("security_id").cast("string"))
    return evaluate_and_persist(prediction_frame(rows, "score", 5), _folder(v), "score", 5)
