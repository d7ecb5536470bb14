"""Queries for projections, predicates and scalar functions (FN-*), sets (SET-*) and order (TK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.functions import scalars as S
from marketspark.functions.text import name_similarity
from marketspark.operators import ranking as R
from marketspark.operators import selection as P
from marketspark.operators import sets as O


@query("fn01_projection", """SELECT s_suppkey AS supplier, s_name AS name, CAST(round(s_acctbal, 0) AS BIGINT) AS balance,
    CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""", ints="balance")
def _(v):
    return O.project(v.supplier, {
        "supplier": "s_suppkey", "name": "s_name", "balance": F.round("s_acctbal", 0).cast("bigint"),
        "nation": F.col("s_nationkey").cast("string"),
    })


@query("fn02_exclude", "SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def _(v):
    return v.orders.drop("o_totalprice", "o_orderpriority")


@query("fn03_filter", """SELECT p_partkey, p_name, p_size FROM part
    WHERE (p_size BETWEEN 10 AND 20 OR p_type IN ('ECONOMY', 'PROMO')) AND NOT p_name LIKE 'red%' AND p_brand <> 'Brand#1'""")
def _(v):
    rows = O.filter_rows(
        v.part, F.col("p_size").between(10, 20) | F.col("p_type").isin("ECONOMY", "PROMO"),
        ~F.col("p_name").like("red%"), F.col("p_brand") != "Brand#1",
    )
    return rows.select("p_partkey", "p_name", "p_size")


@query("fn04_status_cascade", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'large_done'
    WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 300000 THEN 'large_open' ELSE 'other' END AS status FROM orders""")
def _(v):
    large, done = F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "F"
    status = S.status_case([(done & large, "large_done"), (done, "done"), (large, "large_open")], "other")
    return v.orders.select("o_orderkey", status.alias("status"))


@query("fn05_safe_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount / NULLIF(l_tax, 0) AS ratio FROM lineitem", doubles="ratio")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.safe_div("l_discount", "l_tax").alias("ratio"))


@query("fn06_overlay", """SELECT b.security_id, b.date, COALESCE(c.close, b.close) AS close, COALESCE(c.volume, b.volume) AS volume,
    CASE WHEN c.close IS NULL THEN 'native' ELSE 'vendor' END AS source
    FROM bars b LEFT JOIN vendor_bars c ON c.security_id = b.security_id AND c.date = b.date AND c.volume > 20""", doubles="close")
def _(v):
    patch = v.vendor_bars.where("volume > 20").select(
        "security_id", "date", F.col("close").alias("new_close"), F.col("volume").alias("new_volume"))
    joined = v.bars.join(patch, ["security_id", "date"], "left")
    return joined.select(
        "security_id", "date", S.overlay("new_close", "close").alias("close"), S.overlay("new_volume", "volume").alias("volume"),
        F.when(F.col("new_close").isNull(), "native").otherwise("vendor").alias("source"))


@query("fn07_null_tolerant_guard", """SELECT d.doc_id, COALESCE(l.toxic = 1, FALSE) AS toxic, NOT COALESCE(l.quality = 1, FALSE) AS not_good
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(v):
    joined = v.documents.select("doc_id").join(v.labels, "doc_id", "left")
    return joined.select("doc_id", S.is_true(F.col("toxic") == 1).alias("toxic"), S.not_true(F.col("quality") == 1).alias("not_good"))


@query("fn08_distinct_from", """SELECT d.doc_id, l.quality IS DISTINCT FROM l.toxic AS differs
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(v):
    joined = v.documents.select("doc_id").join(v.labels, "doc_id", "left")
    return joined.select("doc_id", S.distinct_from("quality", "toxic").alias("differs"))


@query("fn09_regex_match", "SELECT doc_id, regexp_matches(upper(text), '(^| )WARRANTY?([ ,(]|$)|LICENSE') AS hit FROM documents")
def _(v):
    return v.documents.select("doc_id", F.upper("text").rlike("(^| )WARRANTY?([ ,(]|$)|LICENSE").alias("hit"))


@query("fn10_canonical_code", r"""SELECT p_partkey, replace(regexp_replace(upper(code), '_OLD[0-9]*$', ''), '-', '.') AS canonical,
    regexp_replace(upper(concat(code, '.us')), '\.US$', '') AS bare
    FROM (SELECT p_partkey, concat(p_brand, '-', p_type, CASE WHEN p_size > 25 THEN concat('_old', p_size) ELSE '' END) AS code FROM part) x""")
def _(v):
    code = F.concat("p_brand", F.lit("-"), "p_type", F.when(F.col("p_size") > 25, F.concat(F.lit("_old"), F.col("p_size"))).otherwise(""))
    return v.part.select("p_partkey", S.canonical_code(code).alias("canonical"),
                         S.strip_market_suffix(F.concat(code, F.lit(".us"))).alias("bare"))


@query("fn11_text_key", """SELECT p_partkey, upper(trim(p_name)) || '|' || upper(trim(p_brand)) AS key,
    p_brand || '_E' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS episode FROM part""")
def _(v):
    return v.part.select("p_partkey", S.text_key("p_name", "p_brand").alias("key"),
                         F.concat("p_brand", F.lit("_E"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("episode"))


@query("fn12_normalized_name", """SELECT c_custkey, regexp_replace(upper(trim(c_name)), '[^A-Z0-9]', '', 'g') AS name,
    regexp_replace(upper(trim(c_name)), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(trim(replace(c_name, '#', ' - '))), '[^A-Z0-9]', '', 'g') AS same FROM customer""")
def _(v):
    other = S.alphanumeric(F.replace("c_name", F.lit("#"), F.lit(" - ")))
    return v.customer.select("c_custkey", S.alphanumeric("c_name").alias("name"), (S.alphanumeric("c_name") == other).alias("same"))


@query("fn13_stable_hash", """SELECT d.doc_id, md5(COALESCE(CAST(d.doc_id AS VARCHAR), '<NULL>') || '|' || COALESCE(CAST(l.quality AS VARCHAR), '<NULL>') || '|' || COALESCE(d.lang, '<NULL>')) AS fingerprint,
    sha256(COALESCE(d.lang, '<NULL>') || '|' || COALESCE(CAST(l.toxic AS VARCHAR), '<NULL>')) AS digest
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(v):
    joined = v.documents.select("doc_id", "lang").join(v.labels, "doc_id", "left")
    return joined.select("doc_id", S.stable_hash("doc_id", "quality", "lang").alias("fingerprint"),
                         S.stable_hash("lang", "toxic", bits=256).alias("digest"))


@query("fn14_date_parts", """SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS later, EXTRACT(YEAR FROM o_orderdate) AS year FROM orders""", ints="days year")
def _(v):
    return v.orders.select("o_orderkey", S.day_difference(F.lit("1995-01-01").cast("date"), F.to_date("o_orderdate")).alias("days"),
                           F.date_add(F.to_date("o_orderdate"), 30).alias("later"), F.year("o_orderdate").alias("year"))


@query("fn15_numeric", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(l_extendedprice) AS log_price, exp(-l_discount) AS decay,
    abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax) AS low, round(l_extendedprice / 1000, 1) AS thousands
    FROM lineitem""", doubles="log_price decay gap high low thousands")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ln("l_extendedprice").alias("log_price"),
                             F.exp(-F.col("l_discount")).alias("decay"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
                             F.greatest("l_discount", "l_tax").alias("high"), F.least("l_discount", "l_tax").alias("low"),
                             F.round(F.col("l_extendedprice") / 1000, 1).alias("thousands"))


@query("fn16_ratio_matches", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_tax * 2 - l_discount) <= 1e-6 * greatest(1.0, abs(l_discount)) AS matches FROM lineitem""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.ratio_matches(F.col("l_tax") * 2, "l_discount").alias("matches"))


@query("fn17_log_ratio_within", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_tax > 0 AND l_discount > 0 THEN abs(ln(l_tax / l_discount)) <= ln(1.26) END AS close_by FROM lineitem""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.log_ratio_within("l_tax", "l_discount", 1.26).alias("close_by"))


@query("fn18_scale_band", """SELECT o_orderkey, CASE WHEN r IS NULL THEN 'not_comparable' WHEN r BETWEEN 800 AND 1250 THEN 'near_1000x_high'
    WHEN r BETWEEN 0.0008 AND 0.00125 THEN 'near_1000x_low' WHEN r BETWEEN 0.8 AND 1.25 THEN 'near_1x' ELSE 'other_ratio' END AS band
    FROM (SELECT o_orderkey, o_totalprice / NULLIF(CASE o_orderstatus WHEN 'F' THEN 250.0 WHEN 'O' THEN 250000.0 ELSE 0.0 END, 0) AS r FROM orders) x""")
def _(v):
    base = F.when(F.col("o_orderstatus") == "F", 250.0).when(F.col("o_orderstatus") == "O", 250000.0).otherwise(0.0)
    return v.orders.select("o_orderkey", S.scale_band(S.safe_div("o_totalprice", base)).alias("band"))


@query("fn19_freshness", """SELECT o_orderkey, CASE WHEN a <= 120 THEN 'fresh' WHEN a <= 180 THEN 'acceptable' WHEN a <= 365 THEN 'stale' ELSE 'very_stale' END AS freshness
    FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS a FROM orders) x""")
def _(v):
    age = S.day_difference(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date"))
    return v.orders.select("o_orderkey", S.freshness("o_orderkey", age).alias("freshness"))


@query("fn20_valid_isin", r"""WITH codes AS (SELECT p_partkey, 'US' || upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 9)) || CAST(p_size % 10 AS VARCHAR) AS isin FROM part),
    digits AS (SELECT p_partkey, isin, array_to_string(list_transform(string_split(isin, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS d FROM codes),
    parts AS (SELECT p_partkey, isin, unnest(range(1, length(d) + 1)) AS i, d FROM digits),
    luhn AS (SELECT p_partkey, isin, sum(CASE WHEN (length(d) - i) % 2 = 1 THEN (CAST(substr(d, i, 1) AS INT) * 2) // 10 + (CAST(substr(d, i, 1) AS INT) * 2) % 10 ELSE CAST(substr(d, i, 1) AS INT) END) AS s FROM parts GROUP BY p_partkey, isin)
    SELECT p_partkey, isin, s % 10 = 0 AS valid FROM luhn""")
def _(v):
    isin = F.concat(F.lit("US"), F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 9)), (F.col("p_size") % 10).cast("string"))
    return v.part.select("p_partkey", isin.alias("isin")).withColumn("valid", S.valid_isin("isin"))


@query("fn21_parse_ratio", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS to_factor, CAST(k AS DOUBLE) AS for_factor, CAST(p_size AS DOUBLE) / k AS ratio
    FROM (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM part) x WHERE k <> 0 AND p_size <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0 OR p_size = 0""", doubles="ratio")
def _(v):
    text = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 3).cast("string"))
    return v.part.select("p_partkey", S.parse_ratio(text).alias("r")).select("p_partkey", "r.to_factor", "r.for_factor", "r.ratio")


@query("fn22_symbol_candidates", """SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [a || '.' || b || '.US', a || '-' || b || '.US'] ELSE [a || b || '.US'] END) AS symbol
    FROM (SELECT p_partkey, p_size, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b FROM part) x""")
def _(v):
    words = F.split("p_name", " ")
    code = F.concat(words[0], F.when(F.col("p_size") > 25, ".").otherwise(""), words[1])
    return v.part.select("p_partkey", F.explode(S.symbol_candidates(code)).alias("symbol"))


@query("fn23_normalize_cik", "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier")
def _(v):
    return v.supplier.select("s_suppkey", S.normalize_cik(F.concat(F.lit("CIK"), F.col("s_suppkey"))).alias("cik"))


@query("fn24_valid_bar", """SELECT security_id, date, 0 < low AND low <= least(o, close) AND greatest(o, close) <= high AND volume >= 0 AS ok
    FROM (SELECT *, CASE WHEN volume > 60 THEN high * 2 ELSE open END AS o FROM bars) b""")
def _(v):
    bars = v.bars.withColumn("open", F.when(F.col("volume") > 60, F.col("high") * 2).otherwise(F.col("open")))
    return bars.select("security_id", "date", S.valid_bar().alias("ok"))


@query("fn25_flat_zero_volume", """SELECT security_id, date, v = 0 AND open = high AND high = low AND low = close AS flat
    FROM (SELECT *, CASE WHEN volume < 10 THEN 0 ELSE volume END AS v FROM bars) b""")
def _(v):
    bars = v.bars.withColumn("volume", F.when(F.col("volume") < 10, 0).otherwise(F.col("volume")))
    return bars.select("security_id", "date", S.flat_zero_volume().alias("flat"))


_NAMES = """SELECT p_partkey, symbol, name, is_etf, is_test FROM (
    SELECT p_partkey, concat(upper(substr(p_name, 1, 3)), CASE WHEN p_size <= 2 THEN '$A' WHEN p_size <= 4 THEN '.WS' WHEN p_size <= 6 THEN '.U' WHEN p_size <= 8 THEN '.R' ELSE '' END) AS symbol,
    concat(p_name, CASE WHEN p_size <= 12 THEN ' common stock' WHEN p_size <= 14 THEN ' preferred stock' WHEN p_size <= 16 THEN ' - warrants' WHEN p_size <= 18 THEN ' senior notes due 2031'
        WHEN p_size <= 20 THEN ' depositary shares, preferred' WHEN p_size <= 22 THEN ' unit' WHEN p_size <= 24 THEN ' rights' WHEN p_size <= 26 THEN ' ETN' WHEN p_size <= 28 THEN ' closed-end fund'
        WHEN p_size <= 30 THEN ' american depositary receipt' WHEN p_size <= 32 THEN ' when-issued' WHEN p_size <= 34 THEN ' test company' WHEN p_size <= 36 THEN ' ordinary shares, preferred stock units' ELSE '' END) AS name,
    CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS is_etf, CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS is_test FROM part) x"""


@query("fn26_classify_instrument", f"""WITH named AS (SELECT *, upper(name) AS n FROM ({_NAMES}) y)
    SELECT p_partkey, CASE WHEN contains(symbol, '$') THEN 'Preferred Stock' WHEN ends_with(symbol, '.WS') OR ends_with(symbol, '.W') THEN 'Warrant' WHEN ends_with(symbol, '.U') THEN 'Unit'
    WHEN ends_with(symbol, '.R') THEN 'Right' WHEN is_test = 1 OR contains(n, 'TEST COMPANY') THEN 'Test Issue' WHEN is_etf = 1 THEN 'ETF' WHEN contains(n, 'WHEN-ISSUED') THEN 'When-Issued'
    WHEN (contains(n, 'PREFERRED STOCK') OR (contains(n, 'DEPOSITARY SHARE') AND contains(n, 'PREFERRED'))) AND NOT contains(n, 'COMMON STOCK') THEN 'Preferred Stock'
    WHEN contains(n, ' WARRANTS') THEN 'Warrant' WHEN ends_with(n, ' UNIT') THEN 'Unit' WHEN ends_with(n, ' RIGHTS') THEN 'Right' WHEN contains(n, ' ETN') THEN 'ETN'
    WHEN contains(n, 'NOTES DUE') THEN 'Notes' WHEN contains(n, 'CLOSED-END FUND') THEN 'FUND'
    WHEN contains(n, 'COMMON STOCK') OR contains(n, 'ORDINARY SHARE') OR contains(n, 'AMERICAN DEPOSITARY') THEN 'Common Stock' END AS instrument_type FROM named""")
def _(v):
    return v.sql(_NAMES).select("p_partkey", S.classify_instrument("symbol", "name", "is_etf", "is_test").alias("instrument_type"))


@query("fn27_unit_unverified", f"""SELECT p_partkey, regexp_matches(upper(name), 'DEPOSITARY|DEPOSITORY|\\bADS\\b|\\bADR\\b') OR (exchange IN ('NYSE', 'NASDAQ') AND currency <> 'USD') AS unverified
    FROM (SELECT p_partkey, name, CASE WHEN is_etf = 1 THEN 'NYSE' ELSE 'OTC' END AS exchange, CASE WHEN is_test = 1 THEN 'EUR' ELSE 'USD' END AS currency FROM ({_NAMES}) y) x""")
def _(v):
    x = v.sql(_NAMES).withColumn("exchange", F.when(F.col("is_etf") == 1, "NYSE").otherwise("OTC")).withColumn(
        "currency", F.when(F.col("is_test") == 1, "EUR").otherwise("USD"))
    return x.select("p_partkey", S.unit_unverified("name", "exchange", "currency").alias("unverified"))


@query("fn28_name_similarity")
def _(v):
    left = v.part.select(F.col("p_brand").alias("key"), F.col("p_name").alias("a"))
    right = v.part.select(F.col("p_brand").alias("key"), F.concat("p_type", F.lit(" "), "p_name").alias("b"))
    return name_similarity(left, right, "key", "a", "b")


@query("set1_union_sources", """SELECT s_name AS name, s_acctbal AS balance, 'supplier' AS source FROM supplier
    UNION ALL SELECT c_name, c_acctbal, 'customer' FROM customer""")
def _(v):
    return O.union_sources({
        "supplier": v.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "customer": v.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
    })


@query("set2_union_distinct", """SELECT security_id, date FROM bars UNION SELECT security_id, date FROM vendor_bars""")
def _(v):
    return O.union_distinct(v.bars.select("security_id", "date"), v.vendor_bars.select("security_id", "date"))


@query("tk1_ordered", """SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC NULLS LAST, lower(n_name)""")
def _(v):
    return O.ordered(v.nation.select("n_name", "n_regionkey"), F.col("n_regionkey").desc_nulls_last(), F.lower("n_name"))


@query("tk2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(v):
    return P.top_k(v.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20)


@query("tk3_top_k_per_entity", """WITH best AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1)
    SELECT * FROM best ORDER BY o_totalprice DESC NULLS LAST, o_custkey LIMIT 30""")
def _(v):
    return P.top_k_per_entity(v.orders.select("o_custkey", "o_totalprice", "o_orderkey"), "o_custkey",
                              [F.col("o_totalprice").desc_nulls_last()], [F.col("o_orderkey")], 30)


@query("tk4_hash_first_k", """SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|quality-sample'), c_custkey) AS sample_rank
    FROM customer QUALIFY sample_rank <= 20""", ints="sample_rank")
def _(v):
    return R.hash_first_k(v.customer.select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"], "quality-sample", 20)
