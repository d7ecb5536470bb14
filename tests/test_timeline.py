"""Sliced and blocked windows equal plain windows, with one key holding most rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import timeline as T


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 400), ("a", 60), ("b", 1)):
        day = date(2000, 1, 1)
        for _ in range(n):
            day += timedelta(days=rng.choice([1, 1, 1, 2, 40]))
            rows.append((key, day, rng.choice([None, rng.random()]), rng.randint(1, 9)))
    return spark.createDataFrame(rows, "k string, d date, x double, v int").cache()


def same(a, b, digits=9):
    def key(row):
        return tuple(round(c, digits) if isinstance(c, float) else c for c in row)

    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert sorted(map(key, a.select(names).collect()), key=repr) == sorted(map(key, b.select(names).collect()), key=repr)


def W():
    return Window.partitionBy("k").orderBy("d")


def R():
    return Window.partitionBy("k").orderBy(F.col("d").desc())


@pytest.mark.parametrize("slice_days", [5, 90, 100000])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_plain_window(panel, slice_days, reverse, exclusive):
    frame = (R if reverse else W)().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    specs = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("v")), "la": ("last", F.col("x"))}
    got = T.running(panel, ["k"], ["d"], specs, reverse=reverse, exclusive=exclusive, slice_days=slice_days)
    want = panel.select("*", F.sum("x").over(frame).alias("s"), F.min("x").over(frame).alias("lo"), F.max("v").over(frame).alias("hi"),
                        F.last("x", True).over(frame).alias("la"))
    same(got, want)


@pytest.mark.parametrize("following", [False, True])
def test_neighbours_keep_null_values(panel, following):
    got = T.neighbours(panel, ["k"], ["d"], {"px": "x", "pd": "d"}, following=following, slice_days=20)
    shift = F.lead if following else F.lag
    same(got, panel.select("*", shift("x").over(W()).alias("px"), shift("d").over(W()).alias("pd")))


@pytest.mark.parametrize("block_rows", [20, 64, None])
def test_framed_equals_plain_frames(panel, block_rows):
    got = T.framed(panel, ["k"], ["d"], {
        "a": (F.sum("v"), -13, 0), "b": (F.avg("v"), -20, -1), "c": (F.count("x"), 1, 10), "m": (F.percentile("v", 0.5), -14, -1),
    }, slice_days=30, block_rows=block_rows)
    want = panel.select(
        "*", F.sum("v").over(W().rowsBetween(-13, 0)).alias("a"), F.avg("v").over(W().rowsBetween(-20, -1)).alias("b"),
        F.count("x").over(W().rowsBetween(1, 10)).alias("c"), F.percentile("v", 0.5).over(W().rowsBetween(-14, -1)).alias("m"))
    same(got, want)


def test_shift_fill_and_segments(panel):
    got = T.shift(panel, ["k"], ["d"], "v", {"back": -3, "ahead": 7}, block_rows=16)
    same(got, panel.select("*", F.lag("v", 3).over(W()).alias("back"), F.lead("v", 7).over(W()).alias("ahead")))
    cut = T.segment_ids(panel, ["k"], ["d"], F.col("v") == 1, "seg", slice_days=11)
    same(cut, panel.withColumn("seg", F.sum((F.col("v") == 1).cast("long")).over(W())))
    product = T.cumulative_factor(panel, ["k"], ["d"], F.col("v").cast("double"), "f", "lf", slice_days=30).select("k", "d", "lf")
    same(product, panel.select("k", "d", F.sum(F.ln(F.col("v").cast("double"))).over(W()).alias("lf")), 6)


def test_frame_longer_than_block_is_refused(panel):
    with pytest.raises(ValueError):
        T.framed(panel, ["k"], ["d"], {"a": (F.sum("v"), -50, 0)}, block_rows=10)


def test_hourly_slices_of_a_busy_day(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else "a", i, rng.randint(0, 86399), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, s int, x double").select(
        "k", "i", "x", F.expr("TIMESTAMP_NTZ'2024-03-10 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("t"))
    width = T.suggest_slice_days(df, ["k"], "t", 30)
    assert 1 / 24 <= width < 0.2
    got = T.running(df, ["k"], ["t", "i"], {"n": ("sum", F.lit(1))}, slice_days=width)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")).cast("long"))
    assert sorted((r.i, r.n) for r in got.collect()) == sorted((r.i, r.n) for r in want.collect())
    assert T.suggest_slice_days(df.limit(0), ["k"], "t") == T.SLICE_DAYS


def test_null_keys_are_keys_like_others(spark):
    rows = [(None, date(2000, 1, 1), 1), (None, date(2001, 1, 1), 1), ("a", date(2000, 1, 1), 5), ("a", date(2002, 1, 1), 6)]
    df = spark.createDataFrame(rows, "k string, d date, v int")
    got = sorted((str(r.k), r.d.year, r.s) for r in T.running(df, ["k"], ["d"], {"s": ("sum", F.col("v"))}, slice_days=30).collect())
    assert got == [("None", 2000, 1), ("None", 2001, 2), ("a", 2000, 5), ("a", 2002, 11)]


@pytest.mark.parametrize("slice_days", [5, 90, 100000])
def test_states_of_both_directions_and_breaks_in_one_scan(panel, slice_days):
    """Sums since the last break, with breaks in some slices and none in others, next to other states."""
    cut = F.col("v") >= 8
    got = T.scan(panel, ["k"], ["d"], {
        "n": T.Fold("sum", F.when(cut, 1).otherwise(0)), "s": T.Fold("sum", F.col("x"), since=cut), "r": T.Fold("sum", F.col("v"), since=F.col("v") == 2),
        "back": T.Fold("last", F.col("x"), exclusive=True), "ahead": T.Fold("last", F.col("x"), reverse=True, exclusive=True),
    }, slice_days=slice_days)
    here = panel.withColumns({"_a": F.sum(cut.cast("long")).over(W()), "_b": F.sum((F.col("v") == 2).cast("long")).over(W())})

    def since(column):
        return Window.partitionBy("k", column).orderBy("d")

    edge = Window.unboundedPreceding
    want = here.select(
        *panel.columns, F.col("_a").alias("n"), F.sum("x").over(since("_a")).alias("s"), F.sum("v").over(since("_b")).alias("r"),
        F.last("x", True).over(W().rowsBetween(edge, -1)).alias("back"), F.last("x", True).over(R().rowsBetween(edge, -1)).alias("ahead"))
    same(got, want)


def test_since_needs_a_forward_sum(panel):
    with pytest.raises(ValueError):
        T.scan(panel, ["k"], ["d"], {"s": T.Fold("max", F.col("x"), since=F.col("v") == 1)})


def test_a_chain_of_states_is_one_eager_job_and_two_reads(spark, tmp_path):
    """The total-return index needs one pass for the carries and one for the result, whatever the number of its states."""
    from marketspark.plans.returns import segment_index

    rows = [(s, date(2000, 1, 1) + timedelta(days=7 * i), 0.01 * (i % 5 - 2), i % 11 > 0) for s in range(3) for i in range(200)]
    spark.createDataFrame(rows, "security_id int, date date, r double, ok boolean").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    staged = []
    plain = T.stage
    T.stage = lambda df: staged.append(df) or plain(df)
    try:
        index = segment_index(source, "security_id", "date", "r", "ok", "seg", "log", "level")
    finally:
        T.stage = plain
    assert len(staged) == 1 and staged[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert index._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    w = Window.partitionBy("security_id").orderBy("date")
    cut = source.withColumn("seg", F.sum((~F.col("ok")).cast("long")).over(w))
    logs = F.sum(F.when(F.col("ok"), F.ln(1 + F.col("r")))).over(Window.partitionBy("security_id", "seg").orderBy("date"))
    want = cut.withColumn("log", F.when(F.col("ok"), logs)).withColumn("level", F.exp("log"))
    same(index, want)
