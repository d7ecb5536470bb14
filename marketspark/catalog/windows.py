"""Queries for ordered and ranked operators (WN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.operators import joins as J
from marketspark.operators import ranking as R
from marketspark.operators import selection as P
from marketspark.operators import timeline as T
from marketspark.plans import research as X

K, O = ["security_id"], ["date"]


@query("wn01_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(v):
    return P.latest_per_key(v.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("wn02_best_match", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END, l_extendedprice DESC, l_partkey, l_linenumber) = 1""")
def _(v):
    priority = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    best = P.best_match(v.lineitem, ["l_orderkey"], [priority, F.col("l_extendedprice").desc(), "l_partkey", "l_linenumber"])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("wn03_qualify", "SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) x WHERE rank <= 3", ints="rank")
def _(v):
    ranked = P.best_match(v.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), "c_custkey"], 3, "rank")
    return ranked.drop("c_acctbal")


@query("wn04_shift", """SELECT security_id, date, lag(close, 1) OVER w AS back_1, lead(close, 1) OVER w AS ahead_1, lag(close, 5) OVER w AS back_5, lead(close, 20) OVER w AS ahead_20
    FROM bars WINDOW w AS (PARTITION BY security_id ORDER BY date)""", doubles="back_1 ahead_1 back_5 ahead_20")
def _(v):
    return T.shift(v.bars.select("security_id", "date", "close"), K, O, "close", {"back_1": -1, "ahead_1": 1, "back_5": -5, "ahead_20": 20}).drop("close")


@query("wn05_cumulative_factor", "SELECT security_id, date, exp(sum(ln(1 + volume / 10000.0)) OVER (PARTITION BY security_id ORDER BY date)) AS factor, sum(ln(1 + volume / 10000.0)) OVER (PARTITION BY security_id ORDER BY date) AS log_factor FROM bars", doubles="factor log_factor")
def _(v):
    ratio = 1 + F.col("volume") / F.lit(10000.0)
    return T.cumulative_factor(v.bars.select("security_id", "date", "volume"), K, O, ratio, "factor", "log_factor").drop("volume")


@query("wn06_segment_id", "SELECT security_id, date, sum(CASE WHEN volume > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY date) AS segment FROM bars", ints="segment")
def _(v):
    return T.segment_ids(v.bars.select("security_id", "date", "volume"), K, O, F.col("volume") > 70, "segment").drop("volume")


@query("wn07_segment_index", """WITH s AS (SELECT security_id, date, volume, sum(CASE WHEN volume > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY date) AS segment FROM bars)
    SELECT security_id, date, segment, CASE WHEN volume <= 70 THEN exp(sum(CASE WHEN volume <= 70 THEN ln(1 + volume / 1000.0) END) OVER (PARTITION BY security_id, segment ORDER BY date)) END AS level FROM s""", ints="segment", doubles="level")
def _(v):
    x = v.bars.select("security_id", "date", "volume", (F.col("volume") / 1000.0).alias("r"), (F.col("volume") <= 70).alias("ok"))
    return X.segment_index(x, "security_id", "date", "r", "ok", "segment", "log_level", "level").select("security_id", "date", "segment", "level")


_P = "FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY date)"


def _panel(v):
    return v.panel.select("security_id", "date", "close", "volume")


@query("wn08_trailing_inclusive", "SELECT security_id, date, CASE WHEN count(close) OVER (w ROWS 13 PRECEDING) = 14 THEN sum(ln(close)) OVER (w ROWS 13 PRECEDING) END AS log_sum " + _P, doubles="log_sum")
def _(v):
    x = T.framed(_panel(v), K, O, {"n": (F.count("close"), -13, 0), "s": (F.sum(F.ln("close")), -13, 0)})
    return x.select("security_id", "date", X.gate("n", 14, "s").alias("log_sum"))


@query("wn09_prior_volatility", "SELECT security_id, date, CASE WHEN count(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN stddev_samp(close) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS vol " + _P, doubles="vol:4")
def _(v):
    x = T.framed(_panel(v), K, O, {"n": (F.count("close"), -20, -1), "s": (F.stddev_samp("close"), -20, -1)})
    return x.select("security_id", "date", X.gate("n", 20, "s").alias("vol"))


@query("wn10_rolling_median", "SELECT security_id, date, CASE WHEN count(*) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) = 14 THEN volume / median(volume) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS relative " + _P, doubles="relative")
def _(v):
    x = T.framed(_panel(v), K, O, {"n": (F.count("volume"), -14, -1), "m": (F.percentile("volume", 0.5), -14, -1)})
    return x.select("security_id", "date", X.gate("n", 14, F.col("volume") / F.col("m")).alias("relative"))


@query("wn11_volume_zscore", """SELECT security_id, date, CASE WHEN count(*) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) = 14 AND stddev_samp(ln(1 + volume)) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) > 0
    THEN (ln(1 + volume) - avg(ln(1 + volume)) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) / stddev_samp(ln(1 + volume)) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS z """ + _P, doubles="z:4")
def _(v):
    log = F.ln(1 + F.col("volume"))
    x = T.framed(_panel(v), K, O, {"n": (F.count("volume"), -14, -1), "m": (F.avg(log), -14, -1), "s": (F.stddev_samp(log), -14, -1)})
    return x.select("security_id", "date", X.gate("n", 14, X.z_score(log, "m", "s")).alias("z"))


@query("wn12_rsi", """WITH d AS (SELECT security_id, date, close - lag(close) OVER (PARTITION BY security_id ORDER BY date) AS c FROM panel),
    g AS (SELECT security_id, date, count(c) OVER w AS n, sum(greatest(c, 0)) OVER w AS up, sum(greatest(-c, 0)) OVER w AS down FROM d WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS 13 PRECEDING))
    SELECT security_id, date, CASE WHEN n < 14 THEN NULL WHEN up = 0 AND down = 0 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + up / down) END AS rsi FROM g""", doubles="rsi:5")
def _(v):
    moved = T.neighbours(_panel(v), K, O, {"before": "close"}).withColumn("delta", F.col("close") - F.col("before"))
    x = T.framed(moved, K, O, X.rsi_frames("delta", [14]))
    return x.select("security_id", "date", X.rsi(14).alias("rsi"))


@query("wn13_forward_compound", "SELECT security_id, date, CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN exp(sum(ln(1 + volume / 10000.0)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) - 1 END AS ahead " + _P, doubles="ahead")
def _(v):
    x = _panel(v).withColumn("r", F.col("volume") / 10000.0)
    return X.forward_returns(x, K, O, "r", {"ahead": 10}).select("security_id", "date", "ahead")


@query("wn14_market_forward", "SELECT date, CASE WHEN count(*) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN exp(sum(ln(1 + m)) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - 1 END AS ahead FROM (SELECT date, avg(volume / 10000.0) AS m FROM panel GROUP BY date) x", doubles="ahead")
def _(v):
    daily = v.panel.groupBy("date").agg(F.avg(F.col("volume") / 10000.0).alias("m"))
    return X.forward_returns(daily, [], O, "m", {"ahead": 5}).select("date", "ahead")


@query("wn15_full_window_gate", "SELECT security_id, date, CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS mean_60 " + _P, doubles="mean_60:5")
def _(v):
    x = T.framed(_panel(v), K, O, {"n": (F.count("close"), -59, 0), "m": (F.avg("close"), -59, 0)})
    return x.select("security_id", "date", X.gate("n", 60, "m").alias("mean_60"))


@query("wn16_percent_rank", "SELECT c_custkey, c_nationkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -2)) AS share FROM customer", doubles="share")
def _(v):
    x = v.customer.select("c_custkey", "c_nationkey", F.round("c_acctbal", -2).alias("rounded"))
    return R.percent_rank(x, ["c_nationkey"], "rounded", "share").drop("rounded")


@query("wn17_ntile", "SELECT o_orderkey, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS tile FROM orders", ints="tile")
def _(v):
    return R.n_tiles(v.orders.select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"], 10, "tile").drop("o_totalprice")


@query("wn18_count_over", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", ints="n")
def _(v):
    return J.count_over(v.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], "n").drop("o_custkey")


@query("wn19_distinct_over", "SELECT o_orderkey, d AS statuses FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS d FROM orders GROUP BY o_custkey) x USING (o_custkey)", ints="statuses")
def _(v):
    return J.distinct_over(v.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "statuses").select("o_orderkey", "statuses")


@query("wn20_conditional_sum_over", "SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS done FROM orders", ints="done")
def _(v):
    return J.count_over(v.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "done", F.col("o_orderstatus") == "F").select("o_orderkey", "done")


@query("wn21_robust_z", """WITH m AS (SELECT security_id, date, ln(volume) AS x, median(ln(volume)) OVER (PARTITION BY security_id) AS m FROM bars),
    d AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY security_id) AS mad FROM m)
    SELECT security_id, date, 0.67448975 * abs(x - m) / greatest(mad, ln(1.05)) AS z FROM d""", doubles="z")
def _(v):
    from marketspark.plans.shares import robust_z

    x = v.bars.select("security_id", "date", F.ln(F.col("volume").cast("double")).alias("x"))
    return robust_z(x, ["security_id"], "x", 1.05, "z").select("security_id", "date", "z")


@query("wn22_adjacent_log_ratio", "SELECT security_id, date, abs(ln(close / lag(close) OVER (PARTITION BY security_id ORDER BY date))) AS jump FROM bars", doubles="jump")
def _(v):
    x = T.neighbours(v.bars.select("security_id", "date", "close"), K, O, {"before": "close"})
    return x.select("security_id", "date", F.abs(F.ln(F.col("close") / F.col("before"))).alias("jump"))


@query("wn23_sequence_number", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders", ints="number")
def _(v):
    x = R.ranked_rows(v.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "number")
    return x.select("o_custkey", "o_orderkey", "number")


@query("wn24_forward_fill", """SELECT u.user_id, u.day, last_value(p.value IGNORE NULLS) OVER (PARTITION BY u.user_id ORDER BY u.day) AS value FROM user_days u LEFT JOIN purchases p ON p.user_id = u.user_id AND p.day = u.day""", doubles="value")
def _(v):
    p = v.purchases.select("user_id", "day", F.col("value").alias("paid"))
    x = v.user_days.select("user_id", "day").join(p, ["user_id", "day"], "left")
    return T.forward_fill(x, ["user_id"], ["day"], {"value": "paid"}, slice_days=10).drop("paid")


@query("wn25_daily_buckets", """WITH n AS (SELECT security_id, date, count(*) OVER (PARTITION BY date) AS c, row_number() OVER (PARTITION BY date ORDER BY predicted_probability, security_id) AS r FROM signals)
    SELECT security_id, date, least(ceil(CAST(r AS DOUBLE) / CAST(c AS DOUBLE) * 10.0), 10) AS decile FROM n WHERE c >= 10""", ints="decile")
def _(v):
    x = v.signals.select("security_id", "date", "predicted_probability")
    return R.equal_buckets(x, ["date"], ["predicted_probability", "security_id"], 10, "decile", drop_small=True).drop("predicted_probability")


@query("wn26_split_label", """WITH t AS (SELECT security_id, date, lead(date, 5) OVER (PARTITION BY security_id ORDER BY date) AS target_end_date FROM panel)
    SELECT *, CASE WHEN target_end_date <= DATE '1999-12-31' THEN 'train' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND target_end_date <= DATE '2000-12-31' THEN 'validation' WHEN date >= DATE '2001-01-01' THEN 'test' END AS split FROM t""")
def _(v):
    x = T.shift(v.panel.select("security_id", "date", F.col("date").alias("d")), K, O, "d", {"target_end_date": 5}).drop("d")
    return x.withColumn("split", X.split_label("date", "target_end_date", "1999-12-31", "2000-12-31"))


@query("wn27_peak_per_key", "SELECT security_id, date, volume FROM bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY volume DESC, date) = 1")
def _(v):
    return P.peak_per_key(v.bars.select("security_id", "date", "volume"), K, "volume", O)
