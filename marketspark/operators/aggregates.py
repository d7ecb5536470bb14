"""Group aggregates: counts, consensus checks, compounding, coverage and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import safe_div


def summarize(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group by ``keys`` with named aggregates."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def count_where(df: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """Row counts per group, one per named condition (null counts as false)."""
    return summarize(df, keys, **{n: F.count_if(c) for n, c in conditions.items()})


def distinct_counts(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    """Distinct non-null values per group; wrap an expression in ``when`` to filter it."""
    return summarize(df, keys, **{n: F.count_distinct(c) for n, c in columns.items()})


def distinct_tuples(df: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Distinct combinations of several columns per group (nulls are values)."""
    return summarize(df, keys, **{out: F.count_distinct(F.struct(*columns))})


def any_true(df: DataFrame, keys: Sequence[str], **flags: Column) -> DataFrame:
    """``bool_or`` per named flag."""
    return summarize(df, keys, **{n: F.bool_or(c) for n, c in flags.items()})


def arg_extreme(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str,
    *, smallest: bool = False, where: Column | None = None,
) -> DataFrame:
    """``value`` at the largest (or smallest) ``order``, over rows meeting ``where``."""
    position = F.struct(*order) if where is None else F.when(where, F.struct(*order))
    pick = F.min_by if smallest else F.max_by
    return summarize(df, keys, **{out: pick(F.col(value), position)})


def unique_identity(df: DataFrame, keys: Sequence[str], identity: str, **aggregates: Column) -> DataFrame:
    """Groups that agree on one identity, with that identity and further aggregates."""
    grouped = df.groupBy(*keys).agg(
        F.count_distinct(identity).alias("_ids"), F.any_value(identity, True).alias(identity),
        *[a.alias(n) for n, a in aggregates.items()],
    )
    return grouped.where(F.col("_ids") == 1).drop("_ids")


def mode_of(df: DataFrame, column: str, out: str) -> DataFrame:
    """Most common value, the smallest among equals; one row."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col(column).isNotNull())
    return counts.orderBy(F.col("_n").desc(), column).limit(1).select(F.col(column).alias(out))


def having(df: DataFrame, keys: Sequence[str], condition: Column, **aggregates: Column) -> DataFrame:
    """Groups whose aggregates meet ``condition``."""
    return summarize(df, keys, **aggregates).where(condition)


def group_all(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Group by every column, as GROUP BY ALL over the whole row."""
    return summarize(df, df.columns, **aggregates)


def distinct_list(df: DataFrame, keys: Sequence[str], column: str, out: str, separator: str = ",") -> DataFrame:
    """Sorted distinct values joined into one string (values are made distinct before they gather)."""
    distinct = df.select(*keys, column).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(column)), separator).alias(out))


def consensus(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Smallest value and number of variants of each attribute per key."""
    parts = []
    for a in attributes:
        parts += [F.min(a).alias(a), F.count_distinct(a).alias(f"{a}_variants")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"), *parts)


def rollup_status(df: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Status of a group from its members: all resolved alike, partly, in conflict or not at all."""
    x = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observed"),
        F.count(attribute).alias("resolved"),
        (F.count(F.lit(1)) - F.count(attribute)).alias("unresolved"),
        F.count_distinct(attribute).alias("distinct_values"),
        F.min(attribute).alias("candidate_value"),
    )
    one = F.col("distinct_values") == 1
    return x.withColumn("resolved_value", F.when(one, F.col("candidate_value"))).withColumn(
        "status",
        F.when((F.col("resolved") == F.col("observed")) & one, "resolved_all_tickers_consistent")
        .when((F.col("resolved") > 0) & one, "partially_resolved_consistent")
        .when(F.col("distinct_values") > 1, "ticker_history_type_conflict")
        .otherwise("unresolved"),
    )


def compound(df: DataFrame, keys: Sequence[str], ratio: Column, out: str) -> DataFrame:
    """Product of positive ratios as ``exp(sum(ln))``, which combines before the shuffle."""
    return summarize(df, keys, **{out: F.exp(F.sum(F.ln(ratio)))})


def weighted_mean(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, out: str) -> DataFrame:
    """``sum(w * x) / sum(w)``."""
    return summarize(df, keys, **{out: safe_div(F.sum(value * weight), F.sum(weight))})


def pivot_values(
    df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence
) -> DataFrame:
    """Spread a fixed list of values to columns, one row per index."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.max(value))


def status_counts(df: DataFrame, columns: Sequence[str], **aggregates: Column) -> DataFrame:
    """Number of rows per combination of status columns."""
    return summarize(df, columns, n=F.count(F.lit(1)), **aggregates)


def weight_bps(df: DataFrame, date: str, value: str, out: str = "weight_bps") -> DataFrame:
    """Each row's share of its date's total in basis points."""
    totals = df.groupBy(date).agg(F.sum(value).alias("_total"))
    return df.join(totals, date).withColumn(out, safe_div(F.col(value) * 10000.0, F.col("_total"))).drop("_total")


def coverage_pct(df: DataFrame, keys: Sequence[str], covered: Column, expected: Column) -> DataFrame:
    """Expected and covered rows per group and the percentage, null for nothing expected."""
    x = count_where(df, keys, expected_rows=expected, covered_rows=covered)
    return x.withColumn("coverage_pct", safe_div(F.col("covered_rows") * 100.0, F.col("expected_rows")))
