"""Exact ranks with a hot group, many ties and null groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import ranking as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot"] * 4 + ["a", None]), rng.randint(0, 20)) for i in range(500)] + [(900, "one", 3)]
    return spark.createDataFrame(data, "id int, g string, x int").cache()


def W():
    return Window.partitionBy("g").orderBy("x", "id")


def pairs(df, column):
    return sorted((r["id"], r[column]) for r in df.collect())


def test_ranked_rows(rows):
    got = R.ranked_rows(rows, ["g"], ["x", "id"])
    want = rows.withColumn("row_number", F.row_number().over(W())).withColumn("group_rows", F.count("*").over(Window.partitionBy("g")))
    assert pairs(got, "row_number") == pairs(want, "row_number")
    assert pairs(got, "group_rows") == pairs(want, "group_rows")


def test_tiles_and_percent_rank(rows):
    assert pairs(R.n_tiles(rows, ["g"], ["x", "id"], 7, "t"), "t") == pairs(rows.withColumn("t", F.ntile(7).over(W())), "t")
    by_x = Window.partitionBy("g").orderBy("x")
    got, want = R.percent_rank(rows, ["g"], "x", "p"), rows.withColumn("p", F.percent_rank().over(by_x))
    assert [(i, round(p, 9)) for i, p in pairs(got, "p")] == [(i, round(p, 9)) for i, p in pairs(want, "p")]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantile(rows, q):
    got = {r.g: r.v for r in R.exact_quantile(rows, ["g"], "x", q, "v").collect()}
    want = {r.g: r.v for r in rows.groupBy("g").agg(F.percentile("x", q).alias("v")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_equal_buckets_are_balanced_for_a_constant_score(spark):
    df = spark.range(100).select("id", F.lit("d").alias("g"), F.lit(0.5).alias("p"))
    counts = R.equal_buckets(df, ["g"], ["p", "id"], 10, "b").groupBy("b").count().collect()
    assert sorted((r.b, r["count"]) for r in counts) == [(b, 10) for b in range(1, 11)]


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 1.0)], "g string, id int, x double")
    assert pairs(R.average_ranks(df, ["g"], "x", "r"), "r") == [(1, 2.5), (2, 2.5), (3, 1.0)]


def test_best_match_limits_rows_before_the_shuffle(rows):
    from marketspark.operators.selection import best_match

    plan = best_match(rows, ["g"], ["x", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ranks_keep_null_values_and_null_groups(spark):
    df = spark.createDataFrame([("g", 1, 5.0), ("g", 2, None), (None, 3, 1.0), (None, 4, 1.0)], "g string, id int, x double")
    assert pairs(R.average_ranks(df, ["g"], "x", "r"), "r") == [(1, 1.0), (2, 2.0), (3, 1.5), (4, 1.5)]


def test_a_value_that_all_rows_share_is_one_row(spark):
    df = spark.range(200_000).select("id", F.lit("g").alias("g"), F.lit(0.5).alias("x"))
    places = R.value_places(df, ["g"], "x")
    assert [tuple(r) for r in places.collect()] == [("g", 0.5, 1, 200_000, 200_000)]
    assert R.exact_quantile(df, ["g"], "x", 0.3, "v").first().v == 0.5
