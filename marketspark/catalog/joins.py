"""Queries for the joins (JN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.operators import joins as J
from marketspark.operators.graph import connected_components
from marketspark.operators.sets import union_distinct


@query("jn01_inner", "SELECT security_id, date, b.close, v.close AS vendor_close FROM bars b JOIN vendor_bars v USING (security_id, date)", doubles="close vendor_close")
def _(v):
    vendor = v.vendor_bars.select("security_id", "date", F.col("close").alias("vendor_close"))
    return J.inner_join(v.bars.select("security_id", "date", "close"), vendor, ["security_id", "date"])


@query("jn02_left", "SELECT b.security_id, b.date, v.adjusted_close FROM bars b LEFT JOIN vendor_bars v ON v.security_id = b.security_id AND v.date = b.date", doubles="adjusted_close")
def _(v):
    return J.left_join(v.bars.select("security_id", "date"), v.vendor_bars.select("security_id", "date", "adjusted_close"), ["security_id", "date"])


@query("jn03_filtered", """SELECT o.o_orderkey, o.o_custkey, c.c_acctbal FROM orders o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'""")
def _(v):
    c = v.customer.withColumnRenamed("c_custkey", "o_custkey")
    return J.filtered_join(v.orders, c, ["o_custkey"], F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_custkey", "c_acctbal")


@query("jn04_using", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def _(v):
    return J.using_join(v.documents.select("doc_id", "lang"), v.labels.select("doc_id", "quality"), ["doc_id"])


@query("jn05_case_insensitive", """SELECT s_suppkey, n_name FROM (SELECT s_suppkey, lower(n_name) AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey) s
    JOIN nation ON upper(n_name) = upper(s.nation)""")
def _(v):
    left = v.supplier.join(v.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("nation"))
    return J.ci_join(left, v.nation.select("n_name"), "nation", "n_name").select("s_suppkey", "n_name")


@query("jn06_or_condition", """WITH refs AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS code, upper(split_part(p_name, ' ', 2)) AS canonical FROM part),
    wanted AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS symbol FROM part UNION SELECT 'RED')
    SELECT w.symbol, r.p_partkey, CASE WHEN r.code = w.symbol THEN 'exact_code' ELSE 'canonicalized_code' END AS method FROM wanted w JOIN refs r ON r.code = w.symbol OR r.canonical = w.symbol""")
def _(v):
    words = F.split(F.upper("p_name"), " ")
    refs = v.part.select("p_partkey", words[0].alias("code"), words[1].alias("canonical"))
    wanted = union_distinct(refs.select(F.col("canonical").alias("symbol")), refs.select(F.lit("RED").alias("symbol")))
    return J.or_join(wanted, refs, F.col("symbol"), F.col("code"), F.col("canonical"), "method").select("symbol", "p_partkey", "method")


@query("jn07_overlapping_pairs", """WITH spans AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate + INTERVAL 200 DAY AS DATE) AS last_day FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS o_orderkey_a, b.o_orderkey AS o_orderkey_b, greatest(a.first_day, b.first_day) AS overlap_start, least(a.last_day, b.last_day) AS overlap_end
    FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.first_day <= b.last_day AND b.first_day <= a.last_day""")
def _(v):
    spans = v.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("first_day"), F.date_add("o_orderdate", 200).alias("last_day"))
    pairs = J.overlapping_pairs(spans, ["o_custkey"], "o_orderkey", "first_day", "last_day")
    return pairs.select("o_custkey", "o_orderkey_a", "o_orderkey_b", "overlap_start", "overlap_end")


@query("jn08_interval", """SELECT s.o_custkey, s.first_day, c.event_id, c.day FROM (SELECT o_custkey, CAST(first_day + INTERVAL '7' YEAR AS DATE) AS first_day, CAST(last_day + INTERVAL '25' YEAR AS DATE) AS last_day FROM customer_spans) s
    JOIN clicks c ON c.user_id = s.o_custkey AND c.day BETWEEN s.first_day AND s.last_day""")
def _(v):
    spans = v.customer_spans.select(F.col("o_custkey").alias("user_id"), F.add_months("first_day", 84).alias("first_day"), F.add_months("last_day", 300).alias("last_day"))
    hits = J.interval_join(v.clicks, spans, ["user_id"], "day", "first_day", "last_day")
    return hits.select(F.col("user_id").alias("o_custkey"), "first_day", "event_id", "day")


@query("jn09_expand_sessions", """SELECT s.o_custkey, c.session_date FROM customer_spans s JOIN sessions c ON c.session_date BETWEEN s.first_day AND s.last_day""")
def _(v):
    return J.expand_sessions(v.customer_spans, v.sessions, "first_day", "last_day").select("o_custkey", "session_date")


@query("jn10_band", """SELECT s.act_symbol, s.ex_date, p.split_date, p.observation_id FROM splits s
    JOIN vendor_splits p ON p.provider_symbol = s.act_symbol || '.US' AND abs(date_diff('day', s.ex_date, p.split_date)) <= 45""")
def _(v):
    left = v.splits.withColumn("provider_symbol", F.concat("act_symbol", F.lit(".US"))).drop("to_factor", "for_factor")
    pairs = J.band_join(left, v.vendor_splits, ["provider_symbol"], "ex_date", "split_date", 45, 45)
    return pairs.select("act_symbol", "ex_date", "split_date", "observation_id")


@query("jn11_latest_within", """SELECT p.user_id, p.day, c.event_id, c.day AS click_day FROM purchases p JOIN clicks c ON c.user_id = p.user_id AND c.day BETWEEN p.day - INTERVAL 7 DAY AND p.day
    QUALIFY row_number() OVER (PARTITION BY p.user_id, p.day ORDER BY c.day DESC, c.event_id) = 1""")
def _(v):
    clicks = v.clicks.select("user_id", F.col("day").alias("click_day"), "event_id")
    found = J.latest_within(v.purchases, clicks, ["user_id"], "day", "click_day", 7, ["user_id", "day"], ["event_id"])
    return found.select("user_id", "day", "event_id", "click_day")


@query("jn12_next_within", """SELECT s.act_symbol, s.ex_date, min(b.date) AS trading_date FROM splits s JOIN bars b ON b.ticker = s.act_symbol AND b.date >= s.ex_date AND b.date <= s.ex_date + INTERVAL 7 DAY GROUP BY s.act_symbol, s.ex_date""")
def _(v):
    days = v.bars.select(F.col("ticker").alias("act_symbol"), "date")
    return J.next_within(v.splits.select("act_symbol", "ex_date"), days, ["act_symbol"], "ex_date", "date", 7, "trading_date")


_ASOF = """SELECT b.security_id, b.ticker, b.date, f.filing_date, f.shares_outstanding, date_diff('day', f.filing_date, b.date) AS age_days
    FROM bars b ASOF LEFT JOIN filings f ON b.ticker = f.ticker AND b.date >= f.filing_date"""


@query("jn13_asof", _ASOF, doubles="shares_outstanding:2", ints="age_days")
def _(v):
    joined = J.asof_join(v.bars, v.filings, ["ticker"], "date", "filing_date", {"filing_date": "filing_date", "shares_outstanding": "shares_outstanding"})
    return joined.select("security_id", "ticker", "date", "filing_date", "shares_outstanding", F.datediff("date", "filing_date").alias("age_days"))


@query("jn14_asof_chain", """SELECT b.security_id, b.date, f.filing_date, f.period_date, p.date AS period_price_date, p.close AS period_close FROM bars b
    ASOF LEFT JOIN filings f ON b.ticker = f.ticker AND b.date >= f.filing_date ASOF LEFT JOIN vendor_bars p ON p.security_id = b.security_id AND f.period_date >= p.date""", doubles="period_close")
def _(v):
    joined = J.asof_chain(v.bars, [
        dict(right=v.filings, on=["ticker"], left_time="date", right_time="filing_date", columns={"filing_date": "filing_date", "period_date": "period_date"}),
        dict(right=v.vendor_bars, on=["security_id"], left_time="period_date", right_time="date", columns={"period_price_date": "date", "period_close": "close"}),
    ])
    return joined.select("security_id", "date", "filing_date", "period_date", "period_price_date", "period_close")


@query("jn15_asof_max_age", f"""SELECT security_id, date, CASE WHEN age_days <= 60 THEN filing_date END AS filing_date, CASE WHEN age_days <= 60 THEN shares_outstanding END AS shares_outstanding FROM ({_ASOF}) x""", doubles="shares_outstanding:2")
def _(v):
    joined = J.asof_join(v.bars, v.filings, ["ticker"], "date", "filing_date", {"filing_date": "filing_date", "shares_outstanding": "shares_outstanding"}, max_age_days=60)
    return joined.select("security_id", "date", "filing_date", "shares_outstanding")


@query("jn16_newest_source", """SELECT b.security_id, b.date, f.filing_date, f.period_date FROM bars b JOIN filings f ON f.ticker = b.ticker AND date_diff('day', f.filing_date, b.date) BETWEEN 0 AND 365
    QUALIFY row_number() OVER (PARTITION BY b.security_id, b.date ORDER BY f.filing_date DESC, f.period_date DESC) = 1""")
def _(v):
    sources = v.filings.select("ticker", "filing_date", "period_date")
    found = J.asof_latest_source(v.bars.select("security_id", "ticker", "date"), sources, ["ticker"], "date", "filing_date", 365, ["security_id", "date"], [F.col("period_date").desc()])
    return found.select("security_id", "date", "filing_date", "period_date")


@query("jn17_nearest", """WITH m AS (SELECT s.act_symbol, s.ex_date, p.split_date, p.observation_id, abs(date_diff('day', s.ex_date, p.split_date)) AS day_distance FROM splits s
    LEFT JOIN vendor_splits p ON p.provider_symbol = s.act_symbol || '.US' AND abs(date_diff('day', s.ex_date, p.split_date)) <= 45)
    SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY act_symbol, ex_date ORDER BY day_distance, split_date) = 1""", ints="day_distance")
def _(v):
    left = v.splits.select("act_symbol", "ex_date", F.concat("act_symbol", F.lit(".US")).alias("provider_symbol"))
    right = v.vendor_splits.select("provider_symbol", "split_date", "observation_id")
    return J.nearest_join(left, right, ["provider_symbol"], "ex_date", "split_date", 45, ["act_symbol", "ex_date"], tie=["split_date"]).drop("provider_symbol")


@query("jn19_previous_session", """WITH c AS (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS p FROM sessions)
    SELECT b.security_id, b.date, c.p AS previous_date, q.close AS previous_close FROM bars b JOIN c ON c.session_date = b.date LEFT JOIN bars q ON q.security_id = b.security_id AND q.date = c.p""", doubles="previous_close")
def _(v):
    return J.prev_session_join(v.bars, v.sessions, "security_id", "date", {"previous_close": "close"}).select("security_id", "date", "previous_date", "previous_close")


@query("jn20_bracketed", """WITH c AS (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS p, lead(session_date) OVER (ORDER BY session_date) AS n FROM sessions)
    SELECT c.session_date, a.security_id FROM c JOIN bars a ON a.date = c.p JOIN bars b ON b.date = c.n AND b.security_id = a.security_id""")
def _(v):
    return J.continuing(v.bars, v.sessions, ["security_id"], "date").select("session_date", "security_id")


@query("jn21_previous_next_value", """SELECT u.user_id, u.day, (SELECT arg_max(p.value, p.day) FROM purchases p WHERE p.user_id = u.user_id AND p.day < u.day) AS before_value,
    (SELECT arg_min(p.value, p.day) FROM purchases p WHERE p.user_id = u.user_id AND p.day > u.day) AS after_value FROM user_days u""", doubles="before_value after_value")
def _(v):
    p = v.purchases.select("user_id", "day", F.col("value").alias("paid"))
    days = v.user_days.select("user_id", "day").join(p, ["user_id", "day"], "left")
    return J.prev_next_value(days, ["user_id"], "day", "paid", "before_value", "after_value", slice_days=7).drop("paid")


@query("jn22_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(v):
    open_orders = v.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return J.semi_join(v.customer.select("c_custkey"), open_orders, ["c_custkey"])


@query("jn23_anti", "SELECT security_id, date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM vendor_bars v WHERE v.security_id = b.security_id AND v.date = b.date)")
def _(v):
    return J.anti_join(v.bars.select("security_id", "date"), v.vendor_bars, ["security_id", "date"])


@query("jn24_event_between", """SELECT b.security_id, b.date, f.period_date, CASE WHEN f.period_date IS NULL THEN FALSE ELSE EXISTS (SELECT 1 FROM splits s WHERE s.act_symbol = b.ticker AND s.ex_date > f.period_date AND s.ex_date <= b.date) END AS intervening_split
    FROM bars b ASOF LEFT JOIN filings f ON b.ticker = f.ticker AND b.date >= f.filing_date""")
def _(v):
    dated = J.asof_join(v.bars, v.filings, ["ticker"], "date", "filing_date", {"period_date": "period_date"})
    events = v.splits.withColumnRenamed("act_symbol", "ticker")
    return J.has_event_between(dated, events, "ticker", "period_date", "date", "ex_date", "intervening_split").select("security_id", "date", "period_date", "intervening_split")


@query("jn25_latest_available", """WITH s AS (SELECT ticker, filing_date, CAST(filing_date + INTERVAL 7 DAY AS DATE) AS usable FROM filings)
    SELECT b.security_id, b.date, s.filing_date FROM bars b JOIN s ON s.ticker = b.ticker AND b.date >= s.usable AND date_diff('day', s.filing_date, b.date) <= 365
    WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.ticker = s.ticker AND n.filing_date > s.filing_date AND n.usable <= b.date)""")
def _(v):
    sources = v.filings.select("ticker", "filing_date", F.date_add("filing_date", 7).alias("usable"))
    kept = J.latest_available_source(v.bars, sources, ["ticker"], "date", "filing_date", "usable", 365)
    return kept.select("security_id", "date", "filing_date")


@query("jn26_tuple_in", "SELECT security_id, date, close FROM bars WHERE (ticker, date) IN (SELECT act_symbol, ex_date FROM dividends)", doubles="close")
def _(v):
    wanted = v.dividends.select(F.col("act_symbol").alias("ticker"), F.col("ex_date").alias("date"))
    return J.semi_join(v.bars, wanted, ["ticker", "date"]).select("security_id", "date", "close")


@query("jn27_conflicts", """SELECT b.security_id, b.date, b.volume, v.volume AS other_volume FROM bars b
    JOIN vendor_bars v ON v.security_id = b.security_id AND v.date = b.date WHERE b.volume <> v.volume""")
def _(v):
    return J.conflicts(v.bars.select("security_id", "date", "volume"), v.vendor_bars, ["security_id", "date"], "volume")


@query("jn28_provider_pair", """WITH c AS (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS p FROM sessions)
    SELECT b.security_id, b.date, x.close AS current_close, y.close AS previous_close FROM bars b JOIN c ON c.session_date = b.date
    JOIN vendor_bars x ON x.security_id = b.security_id AND x.date = b.date JOIN vendor_bars y ON y.security_id = b.security_id AND y.date = c.p""", doubles="current_close previous_close")
def _(v):
    dated = J.prev_session_join(v.bars, v.sessions, "security_id", "date", {}).select("security_id", "date", "previous_date")
    return J.provider_pair(dated, v.vendor_bars, "security_id", "date", "previous_date", ["close"]).drop("previous_date")


@query("jn29_connected_components", """WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem),
    both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    least_seen(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
        UNION SELECT e.b, min(s.component) FROM least_seen s JOIN both_ways e ON e.a = s.node JOIN recurring.least_seen o ON o.node = e.b WHERE s.component < o.component GROUP BY e.b)
    SELECT node, component FROM least_seen""")
def _(v):
    edges = v.lineitem.select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    return connected_components(edges, "a", "b")
