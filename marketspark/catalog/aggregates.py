"""Queries for the group aggregates (AG-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.functions.scalars import status_case
from marketspark.operators import aggregates as A
from marketspark.operators.ranking import exact_quantile


@query("ag01_summarize", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, avg(l_extendedprice) AS price, min(l_discount) AS low, max(l_discount) AS high
    FROM lineitem GROUP BY l_returnflag, l_linestatus""", doubles="quantity:2 price:2 low high", ints="n")
def _(v):
    return A.summarize(v.lineitem, ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), quantity=F.sum("l_quantity"),
                       price=F.avg("l_extendedprice"), low=F.min("l_discount"), high=F.max("l_discount"))


@query("ag02_filtered_counts", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax < 0.02) AS cheap FROM lineitem GROUP BY l_suppkey""", ints="returned cheap")
def _(v):
    return A.count_where(v.lineitem, ["l_suppkey"], returned=F.col("l_returnflag") == "R", cheap=(F.col("l_discount") > 0.05) & (F.col("l_tax") < 0.02))


@query("ag03_distinct_counts", """SELECT o_custkey, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS done_priorities FROM orders GROUP BY o_custkey""", ints="statuses done_priorities")
def _(v):
    return A.distinct_counts(v.orders, ["o_custkey"], statuses=F.col("o_orderstatus"), done_priorities=F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))


@query("ag04_distinct_tuples", "SELECT l_suppkey, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS combinations FROM lineitem GROUP BY l_suppkey", ints="combinations")
def _(v):
    return A.distinct_tuples(v.lineitem, ["l_suppkey"], ["l_returnflag", "l_linestatus", "l_linenumber"], "combinations")


@query("ag05_any_true", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_tax = 0) AS any_untaxed FROM lineitem GROUP BY l_orderkey")
def _(v):
    return A.any_true(v.lineitem, ["l_orderkey"], any_returned=F.col("l_returnflag") == "R", any_untaxed=F.col("l_tax") == 0)


@query("ag06_arg_extreme", """SELECT a.o_custkey, a.latest, b.first_open FROM (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey) a
    JOIN (SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS first_open FROM orders GROUP BY o_custkey) b USING (o_custkey)""", doubles="latest:2 first_open:2")
def _(v):
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    latest = A.arg_extreme(v.orders, keys, "o_totalprice", order, "latest")
    return latest.join(A.arg_extreme(v.orders, keys, "o_totalprice", order, "first_open", smallest=True, where=F.col("o_orderstatus") == "O"), keys)


@query("ag07_unique_identity", "SELECT l_orderkey, any_value(l_returnflag) AS l_returnflag, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1", ints="n")
def _(v):
    return A.unique_identity(v.lineitem, ["l_orderkey"], "l_returnflag", n=F.count(F.lit(1)))


@query("ag08_median_where", "SELECT l_suppkey, median(l_extendedprice) AS typical FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey", doubles="typical:3")
def _(v):
    return exact_quantile(v.lineitem.where("l_quantity > 5"), ["l_suppkey"], "l_extendedprice", 0.5, "typical")


@query("ag09_quantile_cut", "SELECT quantile_cont(o_totalprice, 0.25) AS cut FROM orders", doubles="cut:3")
def _(v):
    return exact_quantile(v.orders, [], "o_totalprice", 0.25, "cut")


@query("ag10_mode", "SELECT session_minutes AS usual FROM sessions GROUP BY session_minutes ORDER BY count(*) DESC, session_minutes LIMIT 1")
def _(v):
    return A.mode_of(v.sessions, "session_minutes", "usual")


@query("ag11_sample_std", "SELECT security_id, stddev_samp(close) AS spread FROM bars GROUP BY security_id", doubles="spread")
def _(v):
    return A.summarize(v.bars, ["security_id"], spread=F.stddev_samp("close"))


@query("ag12_distinct_rows", "SELECT DISTINCT l_returnflag, l_linenumber, l_linestatus FROM lineitem")
def _(v):
    return v.lineitem.select("l_returnflag", "l_linenumber", "l_linestatus").distinct()


@query("ag13_having", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2500000", doubles="total:2")
def _(v):
    return A.having(v.orders, ["o_custkey"], F.col("total") > 2500000, total=F.sum("o_totalprice"))


@query("ag14_group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL", ints="n")
def _(v):
    return A.group_all(v.orders.select("o_orderstatus", "o_orderpriority"), n=F.count(F.lit(1)))


@query("ag15_distinct_list", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def _(v):
    return A.distinct_list(v.orders, ["o_custkey"], "o_orderpriority", "priorities")


@query("ag16_consensus", """SELECT l_orderkey, CASE WHEN f > 1 THEN 'conflicting_flag' WHEN s > 1 THEN 'conflicting_status' ELSE 'agreed' END AS verdict, f AS l_returnflag_variants, s AS l_linestatus_variants, n AS source_rows, l_returnflag, l_linestatus
    FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS s, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey) x""",
       ints="l_returnflag_variants l_linestatus_variants source_rows")
def _(v):
    seen = A.consensus(v.lineitem, ["l_orderkey"], ["l_returnflag", "l_linestatus"])
    return seen.withColumn("verdict", status_case([(F.col("l_returnflag_variants") > 1, "conflicting_flag"), (F.col("l_linestatus_variants") > 1, "conflicting_status")], "agreed"))


@query("ag17_rollup_status", """WITH x AS (SELECT o_custkey, count(*) AS observed, count(t) AS resolved, count(*) - count(t) AS unresolved, count(DISTINCT t) AS distinct_values, min(t) AS candidate_value
    FROM (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS t FROM orders) y GROUP BY o_custkey)
    SELECT *, CASE WHEN distinct_values = 1 THEN candidate_value END AS resolved_value, CASE WHEN distinct_values > 1 THEN 'ticker_history_type_conflict' WHEN resolved = 0 THEN 'unresolved'
    WHEN resolved = observed THEN 'resolved_all_tickers_consistent' ELSE 'partially_resolved_consistent' END AS status FROM x""", ints="observed resolved unresolved distinct_values")
def _(v):
    typed = v.orders.select("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("t"))
    return A.rollup_status(typed, ["o_custkey"], "t")


@query("ag18_compound", "SELECT l_suppkey, product(1 - l_discount / 1000) AS factor FROM lineitem GROUP BY l_suppkey", doubles="factor")
def _(v):
    return A.compound(v.lineitem, ["l_suppkey"], 1 - F.col("l_discount") / 1000, "factor")


@query("ag19_weighted_mean", "SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS mean_discount FROM lineitem GROUP BY l_suppkey", doubles="mean_discount")
def _(v):
    return A.weighted_mean(v.lineitem, ["l_suppkey"], F.col("l_discount"), F.col("l_quantity"), "mean_discount")


@query("ag20_pivot", """SELECT l_suppkey, max(q) FILTER (WHERE l_returnflag = 'A') AS "A", max(q) FILTER (WHERE l_returnflag = 'N') AS "N", max(q) FILTER (WHERE l_returnflag = 'R') AS "R"
    FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey, l_returnflag) x GROUP BY l_suppkey""")
def _(v):
    totals = v.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return A.pivot_values(totals, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"])


@query("ag21_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_orderstatus, o_orderpriority", ints="n", doubles="largest:2")
def _(v):
    return A.status_counts(v.orders, ["o_orderstatus", "o_orderpriority"], largest=F.max("o_totalprice"))


@query("ag22_weight_bps", "SELECT security_id, date, 10000.0 * value / sum(value) OVER (PARTITION BY date) AS weight_bps FROM (SELECT security_id, date, close * volume AS value FROM bars) b", doubles="weight_bps:4")
def _(v):
    valued = v.bars.select("security_id", "date", (F.col("close") * F.col("volume")).alias("value"))
    return A.weight_bps(valued, "date", "value").drop("value")


@query("ag23_coverage_pct", """SELECT b.date, count(*) AS expected_rows, count(v.date) AS covered_rows, 100.0 * count(v.date) / count(*) AS coverage_pct
    FROM bars b LEFT JOIN vendor_bars v ON v.security_id = b.security_id AND v.date = b.date GROUP BY b.date""", ints="expected_rows covered_rows", doubles="coverage_pct")
def _(v):
    seen = v.vendor_bars.select("security_id", "date", F.lit(True).alias("seen"))
    joined = v.bars.join(seen, ["security_id", "date"], "left")
    return A.coverage_pct(joined, ["date"], F.col("seen").isNotNull(), F.lit(True))
