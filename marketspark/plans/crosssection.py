"""Does a score rank future returns? Deciles, rank correlation, robust inference, payoff indices.

Work on all rows (ranks per date) uses exact distributed ranks. What follows has one
row per date and decile, a size bounded by the calendar, so plain windows are fine there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.aggregates import pivot_values
from marketspark.operators.ranking import average_ranks, equal_buckets

DECILES = 10
DAYS_PER_YEAR = 252
SPREAD = "D10-D1"
SCORE, RETURN = "predicted_probability", "forward_relative_return"


def daily_deciles(df: DataFrame, k: int = DECILES, score: str = SCORE) -> DataFrame:
    """Bucket per date by score (1 lowest), ties by security; small dates are dropped (CS-1)."""
    needed = [c for c in ("security_id", "date", score, RETURN) if c in df.columns]
    rows = df.dropna(subset=needed)
    inside = F.when(F.col(score).between(0.0, 1.0), F.col(score)).otherwise(
        F.raise_error(F.lit("scores must lie in [0, 1]")))
    return equal_buckets(rows.withColumn(score, inside), ["date"], [score, "security_id"], k, "decile", drop_small=True)


def decile_returns(ranked: DataFrame) -> DataFrame:
    """Mean forward return and breadth per date and decile (CS-2)."""
    return ranked.groupBy("date", "decile").agg(
        F.avg(RETURN).alias("decile_return"), F.count(F.lit(1)).alias("n_stocks"))


def newey_west(df: DataFrame, group: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """Mean of each series with its Bartlett-weighted standard error and t value (CS-3).

    Squares and lagged products of the deviations come from joining a series with
    itself at each lag; fewer than two values give null.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, order, F.col(value).cast("double").alias("_x"))
    position = Window.partitionBy(*group).orderBy(order)
    means = rows.groupBy(*group).agg(F.avg("_x").alias("mean"), F.count("_x").alias("observations"))
    placed = rows.withColumn("_i", F.row_number().over(position))
    if group:
        centred = placed.join(means, list(group))
    else:
        centred = placed.withColumn("mean", means.select("mean").scalar())
    centred = centred.select(*group, "_i", (F.col("_x") - F.col("mean")).alias("_u"))
    later = centred.withColumn("_lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("_j", F.col("_i") - F.col("_lag"))
    earlier = centred.select(*group, F.col("_i").alias("_j"), F.col("_u").alias("_v"))
    weight = F.when(F.col("_lag") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("_lag") / F.lit(lags + 1.0)))
    spread = later.join(earlier, [*group, "_j"]).groupBy(*group).agg(F.sum(weight * F.col("_u") * F.col("_v")).alias("_s"))
    joined = means.join(spread, list(group)) if group else means.withColumn("_s", spread.scalar())
    error = F.when((F.col("observations") >= 2) & (F.col("_s") >= 0), F.sqrt("_s") / F.col("observations"))
    return joined.withColumn("newey_west_se", error).withColumn(
        "newey_west_t", F.try_divide("mean", "newey_west_se")).drop("_s")


def spread_series(daily: DataFrame, value: str = "decile_return", index: Sequence[str] = ("date",)) -> DataFrame:
    """Top minus bottom decile per date (CS-5)."""
    wide = pivot_values(daily, index, "decile", value, [1, DECILES])
    return wide.select(*index, (F.col(str(DECILES)) - F.col("1")).alias(value)).where(F.col(value).isNotNull())


def _labelled(daily: DataFrame) -> DataFrame:
    own = daily.select(F.concat(F.lit("D"), F.col("decile")).alias("decile"), "date", "decile_return", "n_stocks")
    ends = daily.where(F.col("decile").isin(1, DECILES)).agg(F.avg("n_stocks")).scalar()
    spread = spread_series(daily).select(F.lit(SPREAD).alias("decile"), "date", "decile_return", ends.alias("n_stocks"))
    return own.withColumn("n_stocks", F.col("n_stocks").cast("double")).unionByName(spread)


def decile_statistics(daily: DataFrame, horizon: int) -> DataFrame:
    """Mean, annualised return and volatility, information ratio and robust t per decile and spread (CS-4)."""
    series = _labelled(daily)
    per_year = DAYS_PER_YEAR / horizon
    basic = series.groupBy("decile").agg(
        F.stddev_samp("decile_return").alias("_vol"), F.avg("n_stocks").alias("average_n_stocks"))
    tests = newey_west(series, ["decile"], "date", "decile_return", max(horizon - 1, 0))
    rows = basic.join(tests, "decile").withColumnRenamed("mean", "mean_period_return")
    return rows.withColumns({
        "annualized_return": F.col("mean_period_return") * per_year,
        "annualized_volatility": F.col("_vol") * per_year ** 0.5,
    }).withColumn(
        "information_ratio", F.when(F.col("annualized_volatility") > 0, F.col("annualized_return") / F.col("annualized_volatility"))
    ).drop("_vol")


def rank_ic(ranked: DataFrame, score: str = SCORE) -> DataFrame:
    """Spearman correlation of score and return per date with at least three rows (CS-6)."""
    slim = ranked.select("date", score, RETURN).where(F.col(score).isNotNull() & F.col(RETURN).isNotNull())
    both = average_ranks(average_ranks(slim, ["date"], score, "_a"), ["date"], RETURN, "_b")
    daily = both.groupBy("date").agg(
        F.corr("_a", "_b").alias("rank_ic"), F.count(F.lit(1)).alias("n_stocks"),
        F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    constant = (F.col("_sa") == 0) | (F.col("_sb") == 0)
    return daily.where("n_stocks >= 3").select("date", F.when(~constant, F.col("rank_ic")).alias("rank_ic"), "n_stocks")


def ic_summary(ic: DataFrame, horizon: int) -> DataFrame:
    """Mean, spread, ratio, robust t and hit rate of the daily correlations (CS-7)."""
    basic = ic.where("rank_ic IS NOT NULL").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("rank_ic").alias("mean_ic"), F.stddev_samp("rank_ic").alias("std_ic"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("hit_rate"))
    t = newey_west(ic, [], "date", "rank_ic", max(horizon - 1, 0)).select("newey_west_t").scalar()
    return basic.withColumn("icir", F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic"))).withColumn("newey_west_t", t)


def monotonicity(statistics: DataFrame) -> DataFrame:
    """Rank correlation of decile number and mean return, and whether the means rise strictly (CS-8).

    The input holds ten deciles and the spread.
    """
    rows = statistics.where(F.col("decile") != SPREAD).select(
        F.substring("decile", 2, 2).cast("int").alias("_d"), F.col("mean_period_return").alias("_m"))
    by_number, by_mean = Window.orderBy("_d"), Window.orderBy("_m")
    ties = F.count(F.lit(1)).over(Window.partitionBy("_m"))
    ranked = rows.select(
        "_d", (F.rank().over(by_mean) + (ties - 1) / 2).alias("_r"), (F.col("_m") > F.lag("_m").over(by_number)).alias("_up"))
    return ranked.agg(
        F.when(F.count(F.lit(1)) >= 3, F.corr("_d", "_r")).alias("spearman_decile_return"),
        ((F.count(F.lit(1)) >= 3) & F.coalesce(F.bool_and("_up"), F.lit(False))).alias("strictly_monotone"))


def legs(statistics: DataFrame) -> DataFrame:
    """Mean return of the long and the short side (CS-9)."""
    top = F.max(F.when(F.col("decile") == f"D{DECILES}", F.col("mean_period_return")))
    bottom = F.max(F.when(F.col("decile") == "D1", F.col("mean_period_return")))
    return statistics.agg(
        top.alias("long_leg_mean_return"), (-bottom).alias("short_leg_mean_return"), (top - bottom).alias("long_short_mean_return"))


def evaluate_cross_section(df: DataFrame, horizon: int) -> dict[str, DataFrame]:
    """The whole evaluation as named tables (CS-10)."""
    from marketspark.session import stage

    ranked = stage(daily_deciles(df))
    daily = stage(decile_returns(ranked))
    statistics = decile_statistics(daily, horizon)
    ic = stage(rank_ic(ranked))
    return {
        "ranked": ranked, "daily_decile_returns": daily, "decile_statistics": statistics, "daily_rank_ic": ic,
        "rank_ic_summary": ic_summary(ic, horizon), "monotonicity": monotonicity(statistics), "legs": legs(statistics),
    }


def payoff_index(returns: DataFrame, horizon: int, series: str = "series") -> DataFrame:
    """Equal-capital index of ``horizon`` staggered sleeves per series, starting at 100 (CS-11).

    Signal dates go to the sleeves in turn, so a sleeve never holds two overlapping
    periods; a sleeve without a finished period stays at 100. Input columns are
    series, date, target_end_date and period_return.
    """
    value = F.when(F.col("period_return") >= -1.0, F.col("period_return")).otherwise(
        F.raise_error(F.lit("period return below -100 %")))
    rows = returns.dropna(subset=["date", "target_end_date", "period_return"]).withColumn("_r", value)
    turn = Window.partitionBy(series).orderBy("date")
    rows = rows.withColumn("_sleeve", (F.dense_rank().over(turn) - 1) % horizon)
    path = Window.partitionBy(series, "_sleeve").orderBy("target_end_date")
    wealth = rows.select(
        series, "_sleeve", F.col("target_end_date").alias("date"), (100.0 * F.product(1.0 + F.col("_r")).over(path)).alias("_wealth"))
    start = rows.groupBy(series).agg(F.min("date").alias("date"))
    timeline = start.unionByName(wealth.select(series, "date")).distinct()
    grid = timeline.withColumn("_sleeve", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    so_far = Window.partitionBy(series, "_sleeve").orderBy("date")
    levels = grid.join(wealth, [series, "_sleeve", "date"], "left").withColumn(
        "_level", F.coalesce(F.last("_wealth", ignorenulls=True).over(so_far), F.lit(100.0)))
    index = levels.groupBy(series, "date").agg(F.avg("_level").alias("index_level"))
    first = index.join(start.withColumnRenamed("date", "_start"), series)
    anchored = F.when(F.col("date") == F.col("_start"), 100.0).otherwise(F.col("index_level"))
    return first.select(series, "date", F.lit(horizon).alias("horizon"), anchored.alias("index_level"))


def payoff_indices(ranked: DataFrame, horizon: int) -> DataFrame:
    """Indices of all deciles and of the spread; a signal date has one end date (CS-12)."""
    daily = ranked.groupBy("date", "decile").agg(
        F.avg(RETURN).alias("period_return"), F.min("target_end_date").alias("target_end_date"),
        F.max("target_end_date").alias("_other"))
    ends = daily.groupBy("date").agg(F.min("target_end_date").alias("target_end_date"), F.max("_other").alias("_other"))
    single = F.when(F.col("target_end_date") == F.col("_other"), F.col("target_end_date")).otherwise(
        F.raise_error(F.lit("a signal date has several target end dates")))
    ends = ends.select("date", single.alias("target_end_date"))
    rows = daily.drop("target_end_date", "_other").join(ends, "date")
    own = rows.select(F.concat(F.lit("D"), F.col("decile")).alias("series"), "date", "target_end_date", "period_return")
    spread = spread_series(rows, "period_return", ("date", "target_end_date"))
    return payoff_index(own.unionByName(spread.withColumn("series", F.lit(SPREAD))), horizon)


def threshold_daily(df: DataFrame, score: str, low: float = 30, high: float = 70) -> DataFrame:
    """Mean forward return per date for rows below, between and above fixed thresholds (RSI-1)."""
    bucket = F.when(F.col(score) < low, f"below_{low:g}").when(F.col(score) > high, f"above_{high:g}").otherwise("neutral")
    return df.groupBy("date", bucket.alias("bucket")).agg(F.avg(RETURN).alias("mean_return"), F.count(F.lit(1)).alias("n"))


def threshold_contrast(df: DataFrame, score: str, horizon: int, low: float = 30, high: float = 70) -> DataFrame:
    """Low minus high bucket, paired by date, with a robust t (RSI-1)."""
    below, above = f"below_{low:g}", f"above_{high:g}"
    daily = threshold_daily(df, score, low, high)
    wide = pivot_values(daily, ["date"], "bucket", "mean_return", [below, above])
    paired = wide.select("date", (F.col(below) - F.col(above)).alias("_d")).where("_d IS NOT NULL")
    test = newey_west(paired, [], "date", "_d", max(horizon - 1, 0))
    counts = daily.agg(
        F.coalesce(F.sum(F.when(F.col("bucket") == below, F.col("n"))), F.lit(0)).alias(f"{below}_rows"),
        F.coalesce(F.sum(F.when(F.col("bucket") == above, F.col("n"))), F.lit(0)).alias(f"{above}_rows"))
    name = f"{below}_minus_{above}"
    return counts.withColumns({
        "paired_dates": test.select("observations").scalar(), f"{name}_mean": test.select("mean").scalar(),
        f"{name}_nw_t": test.select("newey_west_t").scalar(),
    })


def run_summary(tables: dict[str, DataFrame], model: str, horizon: int) -> DataFrame:
    """One comparable row per model from its evaluation tables."""
    spread = tables["decile_statistics"].where(F.col("decile") == SPREAD)
    ic = tables["rank_ic_summary"]
    return tables["ranked"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(model).alias("model"), F.lit(horizon).alias("horizon_days"), "n",
        ic.select("mean_ic").scalar().alias("mean_ic"), ic.select("newey_west_t").scalar().alias("ic_newey_west_t"),
        spread.select("mean_period_return").scalar().alias("d10_minus_d1_mean"),
        spread.select("newey_west_t").scalar().alias("d10_minus_d1_nw_t"))


def directional_hypotheses(df: DataFrame, score: str, horizon: int, prefix: str) -> DataFrame:
    """A 0-100 score read as continuation and as reversal through the same evaluation (RSI-2)."""
    parts = []
    for name, value in (("reversal", 1 - F.col(score) / 100), ("continuation", F.col(score) / 100)):
        tables = evaluate_cross_section(df.withColumn(SCORE, value), horizon)
        parts.append(run_summary(tables, f"{prefix}_{name}", horizon))
    return parts[0].unionByName(parts[1])


def compare_runs(*summaries: DataFrame) -> DataFrame:
    """Runs side by side; unequal row counts fail, as they were not made on one sample (CMP-1)."""
    rows = summaries[0]
    for other in summaries[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    sizes = rows.agg(F.count_distinct("n")).scalar()
    checked = F.when(sizes == 1, F.col("n")).otherwise(F.raise_error(F.lit("row counts differ between runs")))
    return rows.withColumn("n", checked.cast("long"))
