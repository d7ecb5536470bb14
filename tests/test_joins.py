"""Time-based joins against brute force, with one key holding most rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketspark.operators import joins as J
from marketspark.operators.graph import connected_components

D0 = date(2020, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    left = sorted({(rng.choice(["hot"] * 3 + ["a", "b"]), day(rng.randint(0, 500))) for _ in range(250)})
    right = sorted({(rng.choice(["hot"] * 3 + ["a", "c"]), day(rng.randint(0, 500))) for _ in range(90)})
    left = [(i, k, d) for i, (k, d) in enumerate(left)]
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    l = spark.createDataFrame(left, "id int, k string, t date").cache()
    r = spark.createDataFrame(right, "k string, u date, v double").cache()
    return left, right, l, r


@pytest.mark.parametrize("slice_days", [3, 60, 10000])
@pytest.mark.parametrize("age", [None, 10])
def test_asof(data, slice_days, age):
    left, right, l, r = data
    got = {x.id: x.v for x in J.asof_join(l, r, ["k"], "t", "u", {"v": "v"}, max_age_days=age, slice_days=slice_days).collect()}
    for i, k, t in left:
        found = max(((u, v) for kk, u, v in right if kk == k and u <= t), default=None)
        if found and age is not None and (t - found[0]).days > age:
            found = None
        assert got[i] == (found[1] if found else None)


def test_asof_rejects_or_orders_ties(spark):
    l = spark.createDataFrame([("a", day(3))], "k string, t date")
    r = spark.createDataFrame([("a", day(1), 1.0), ("a", day(1), 2.0)], "k string, u date, v double")
    with pytest.raises(Exception, match="share a key and time"):
        J.asof_join(l, r, ["k"], "t", "u", {"v": "v"}).collect()
    assert J.asof_join(l, r, ["k"], "t", "u", {"v": "v"}, tie=["v"]).first().v == 2.0


def test_asof_keeps_left_rows_without_key_and_repeated_rows(spark):
    l = spark.createDataFrame([(None, day(3)), ("a", None), ("a", day(3)), ("a", day(3))], "k string, t date")
    r = spark.createDataFrame([("a", day(3), 1.0)], "k string, u date, v double")
    assert sorted(str(x.v) for x in J.asof_join(l, r, ["k"], "t", "u", {"v": "v"}).collect()) == ["1.0", "1.0", "None", "None"]


@pytest.mark.parametrize("before,after", [(45, 45), (7, 0), (0, 7)])
def test_band(data, before, after):
    left, right, l, r = data
    got = sorted((x.id, x.v) for x in J.band_join(l, r, ["k"], "t", "u", before, after).collect())
    want = sorted((i, v) for i, k, t in left for kk, u, v in right if k == kk and -before <= (u - t).days <= after)
    assert got == want


def test_nearest_keeps_unmatched(data):
    left, right, l, r = data
    got = {x.id: (x.day_distance, x.v) for x in J.nearest_join(l, r, ["k"], "t", "u", 20, ["id"], tie=["u"]).collect()}
    for i, k, t in left:
        near = min(((abs((u - t).days), u, v) for kk, u, v in right if kk == k and abs((u - t).days) <= 20), default=None)
        assert got[i] == ((near[0], near[2]) if near else (None, None))


def test_interval_and_overlap(spark):
    rng = random.Random(5)
    spans = [(i, rng.choice(["hot", "hot", "a"]), day(s := rng.randint(0, 2000)), day(s + rng.randint(0, 900))) for i in range(60)]
    points = [(i, rng.choice(["hot", "a"]), day(rng.randint(0, 2500))) for i in range(80)]
    s = spark.createDataFrame(spans, "id int, k string, a date, b date")
    p = spark.createDataFrame(points, "pid int, k string, t date")
    got = sorted((x.pid, x.id) for x in J.interval_join(p, s, ["k"], "t", "a", "b", slice_days=100).collect())
    assert got == sorted((i, j) for i, k, t in points for j, kk, a, b in spans if k == kk and a <= t <= b)
    pairs = sorted((x.id_a, x.id_b) for x in J.overlapping_pairs(s, ["k"], "id", "a", "b", slice_days=100).collect())
    assert pairs == sorted((i, j) for i, k, a, b in spans for j, kk, c, d in spans if k == kk and i < j and a <= d and c <= b)


def test_event_between(data):
    left, right, l, r = data
    dated = l.withColumn("from", F.date_sub("t", 30))
    got = {x.id: x.hit for x in J.has_event_between(dated, r, "k", "from", "t", "u", "hit").collect()}
    for i, k, t in left:
        assert got[i] == any(kk == k and t - timedelta(days=30) < u <= t for kk, u, _ in right)


def test_or_join_pairs_once(spark):
    l = spark.createDataFrame([("A",), ("B",)], "s string")
    r = spark.createDataFrame([("A", "A", 1), ("X", "A", 2), (None, "B", 3)], "e string, c string, n int")
    got = sorted((x.s, x.n, x.m) for x in J.or_join(l, r, F.col("s"), F.col("e"), F.col("c"), "m").collect())
    assert got == [("A", 1, "exact_code"), ("A", 2, "canonicalized_code"), ("B", 3, "canonicalized_code")]


def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(151))
    assert all(got[i] == 1000 for i in range(1000, 1100))
    assert {got[i] for i in (5000, 5001, 5002)} == {5000} and len(got) == 151 + 100 + 3


def test_next_within_keeps_equal_rows(spark):
    from datetime import date

    from marketspark.operators.joins import next_within

    left = spark.createDataFrame([("a", date(2020, 1, 3)), ("a", date(2020, 1, 3)), ("a", date(2021, 1, 3))], "k string, d date")
    right = spark.createDataFrame([("a", date(2020, 1, 6)), ("a", date(2020, 1, 7))], "k string, t date")
    assert [tuple(r) for r in next_within(left, right, ["k"], "d", "t", 7, "n").collect()] == [("a", date(2020, 1, 3), date(2020, 1, 6))] * 2


def test_upsert_leaves_one_row_per_key(spark):
    from marketspark.operators.mutate import append_new, upsert

    old, new = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 3), (2, "e", 4)], "k int, v string, n int")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"], ["n"]).collect()) == [(1, "c", 2), (2, "e", 4)]
    assert sorted(tuple(r) for r in append_new(old, new, ["k"], ["n"]).collect()) == [(1, "a", 0), (2, "d", 3)]


def test_asof_forward(data):
    left, right, l, r = data
    got = {x.id: x.v for x in J.asof_join(l, r, ["k"], "t", "u", {"v": "v"}, forward=True, max_age_days=15, slice_days=30).collect()}
    for i, k, t in left:
        found = min(((u, v) for kk, u, v in right if kk == k and 0 <= (u - t).days <= 15), default=(None, None))
        assert got[i] == found[1]


def test_nearest_prefers_earlier_classes(data):
    left, right, l, r = data
    got = {x.id: (x.day_distance, x.v) for x in J.nearest_join(l, r, ["k"], "t", "u", 30, ["id"], priority=[F.col("v") < 10, F.col("v") < 40], tie=["u"]).collect()}
    for i, k, t in left:
        near = min((((v >= 10) + (v >= 40), abs((u - t).days), u, v) for kk, u, v in right if kk == k and abs((u - t).days) <= 30), default=None)
        assert got[i] == ((near[1], near[3]) if near else (None, None))


def test_nearest_interval(spark):
    rng = random.Random(8)
    spans = [(f"s{i:02d}", rng.choice(["hot", "hot", "a"]), day(s := 20 * rng.randint(0, 100)), day(s + rng.randint(0, 60))) for i in range(50)]
    points = sorted({(rng.choice(["hot", "a", "none"]), day(rng.randint(-50, 2200))) for _ in range(150)})
    s, p = spark.createDataFrame(spans, "e string, k string, a date, b date"), spark.createDataFrame(points, "k string, t date")
    got = {(x.k, x.t): (x.away, x.e) for x in J.nearest_interval(p, s, ["k"], "t", "a", "b", "e", "away").collect()}
    for k, t in points:
        near = min(((0 if a <= t <= b else min(abs((t - a).days), abs((t - b).days)), a, e) for e, kk, a, b in spans if kk == k), default=None)
        assert got.get((k, t)) == ((near[0], near[2]) if near else None)


def test_newest_usable_source(spark):
    rng = random.Random(4)
    sources = [(i, rng.choice(["hot", "hot", "a"]), day(p := rng.randint(0, 600)), day(p + rng.choice([-3, 0, 7, 90]))) for i in range(120)]
    left = [(i, rng.choice(["hot", "a", "b"]), day(rng.randint(0, 900))) for i in range(200)]
    s, l = spark.createDataFrame(sources, "sid int, k string, p date, f date"), spark.createDataFrame(left, "id int, k string, t date")
    got = sorted((x.id, x.sid) for x in J.latest_available_source(l, s, ["k"], "t", "p", "f", 365).collect())
    want = []
    for i, k, t in left:
        usable = [(p, n) for n, kk, p, f in sources if kk == k and f <= t and p <= t]
        newest = max((p for p, _ in usable), default=None)
        want += [(i, n) for p, n in usable if p == newest and (t - p).days <= 365]
    assert got == sorted(want)


def rows_made(df):
    """Rows that joins and generators of the plan made."""
    df.collect()
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
            continue
        if ("Join" in name or name == "GenerateExec") and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("kind", ["newest", "nearest", "interval"])
def test_lookups_make_no_pairs(spark, kind):
    """10,000 rows of one key on both sides: the joins make a few rows per left row, not the 10^8 pairs or those of a band."""
    n = 10_000
    left = spark.range(n).select(F.lit("hot").alias("k"), F.col("id"), F.expr("date_add(date'2000-01-01', cast(id % 3000 as int))").alias("t"))
    right = spark.range(n).select(
        F.lit("hot").alias("k"), F.col("id").alias("rid"), F.expr("date_add(date'2000-01-01', cast(id % 2900 as int))").alias("u"),
        F.expr("date_add(date'2000-01-05', cast(id % 2900 as int))").alias("f"))
    if kind == "newest":
        found = J.newest_published(left, right, ["k"], "t", "u", "f", "newest")
    elif kind == "nearest":
        found = J.nearest_join(left, right, ["k"], "t", "u", 365, ["id"], tie=["rid"])
    else:
        spans = right.where("rid < 2900 AND rid % 10 = 0")
        found = J.nearest_interval(left, spans, ["k"], "t", "u", "f", "rid", "away")
    assert 0 < rows_made(found) < 12 * n
    assert found.count() == (3000 if kind == "interval" else n)


def test_free_numbers_of_many_codes(spark):
    from marketspark.plans.identity import free_suffix_codes

    used = spark.range(1, 10_001).where("id % 3 <> 0").select(F.concat(F.lit("HOT_"), F.col("id")).alias("lineage_code"))
    wanted = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("component_root"), F.lit("HOT").alias("latest_ticker"))
    got = {r.component_root: r.lineage_code for r in free_suffix_codes(wanted, used).collect()}
    free = [i for i in range(1, 20_000) if i % 3 == 0 or i > 10_000]
    assert got == {f"{k:05d}": f"HOT_{free[k]}" for k in range(5000)}
