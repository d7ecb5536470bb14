"""What keeps work in proportion to the input: stored bars, hashed as-of events, lookups of few keys."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from marketspark.catalog.views import Views
from marketspark.operators import joins
from marketspark.plans import shares


@pytest.fixture
def prices(spark):
    return spark.createDataFrame([(k, date(2020, 1, d), d) for k in (1, 2, None) for d in (2, 5, 9)], "k long, day date, n int")


def test_views_read_the_stored_bars(spark, tmp_path):
    spark.createDataFrame([(1, "A", 3, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 100.0)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(1, 1, 1, i, 10.0 * i, 900.0, 0.05, 0.05, "N", "F", datetime(1996, 5, 6 + i)) for i in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = Views(spark, str(tmp_path)).sql("SELECT * FROM research_rows")
    assert "l_shipdate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "A", date(1996, 5, 6), True)]


def test_asof_events_are_hashed(spark, prices, monkeypatch):
    staged = []
    monkeypatch.setattr(joins, "stage", lambda df: staged.append(df) or df)
    events = spark.createDataFrame([(1, date(2020, 1, 4), 7.0)], "k long, at date, x double")
    joins.asof_join(prices, events, ["k"], "day", "at", {"x": "x"})
    assert "SortAggregate" not in staged[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1, 3])
def test_sparse_asof_equals_the_plain_one(spark, prices, few):
    events = spark.createDataFrame([(1, date(2020, 1, 4), None, "a"), (1, date(2020, 1, 9), 8.0, "b"), (None, date(2020, 1, 1), 9.0, "c")][:few] or [],
                                   "k long, at date, x double, s string")
    found = [sorted(map(repr, joins.asof_join(prices, events, ["k"], "day", "at", {"x": "x", "seen": "at", "s": "s"}, sparse=sparse).collect())) for sparse in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 9


def test_guard_leaves_other_securities_as_they_are(spark):
    caps = spark.createDataFrame(
        [(1, date(2020, 1, 2), "A", "vendor", 5.0, 50.0, 5.0), (2, date(2020, 1, 2), "B", "vendor", 6.0, 60.0, 6.0), (None, date(2020, 1, 2), "C", "vendor", 7.0, 70.0, 7.0)],
        "security_id long, date date, ticker string, selected_source string, selected_shares_candidate double, market_cap_candidate double, vendor_current_shares_candidate double")
    impact = caps.where("security_id = 1").select(
        "security_id", "date", "ticker", F.lit(1.0).alias("dry_run_shares"), F.lit(10.0).alias("dry_run_cap"), F.lit(None).cast("date").alias("prior_accepted_filing_date"))
    found = {r.ticker: (r.selected_source, r.market_cap_candidate, r.vendor_guard_status) for r in shares.apply_guard(caps, impact).collect()}
    assert found == {"A": ("vendor_guard_carry", 10.0, "quarantined_100x_up"), "B": ("vendor", 60.0, None), "C": ("vendor", 70.0, None)}
