"""Registered queries against their SQL checks on the smallest data set."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "jn07_overlapping_pairs", "jn13_asof", "jn15_asof_max_age", "jn24_event_between", "jn29_connected_components", "ag08_median_where", "wn04_shift",
    "wn12_rsi", "wn16_percent_rank", "wn25_daily_buckets", "tb04_ticker_episode", "tb26_split_audit", "tb48_total_return_index", "tb57_daily_pit_shares",
    "rs6_feature_label", "pm1_roc_auc", "cs12_payoff_indices", "src12_document_facts",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in entry.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in result.fetchall())
    got = sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect())
    assert got == want


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
