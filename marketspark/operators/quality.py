"""Checks on tables. Each gives rows or counters to look at; the assert forms fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A table breaks a rule."""


def validate_schema(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail at once when columns are missing (DQ-1); reads no data."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise QualityError("missing columns: " + ", ".join(missing))
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (DQ-2)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose non-null key is not in the reference (DQ-3)."""
    return df.dropna(subset=list(keys)).join(reference.select(*keys).distinct(), list(keys), "left_anti")


def assignment_problems(members: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Members assigned never or more than once (DQ-4)."""
    counts = assignments.groupBy(key).agg(F.count(F.lit(1)).alias("assignments"))
    joined = members.select(key).distinct().join(counts, key, "left")
    return joined.withColumn("assignments", F.coalesce("assignments", F.lit(0).cast("long"))).where("assignments <> 1")


def row_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two builds and their relative difference (DQ-5)."""
    old = before.agg(F.count(F.lit(1)).alias("rows_before"))
    new = after.agg(F.count(F.lit(1))).scalar()
    counted = old.withColumn("rows_after", new)
    return counted.withColumn(
        "drift", F.try_divide(F.abs(F.col("rows_after") - F.col("rows_before")).cast("double"), F.col("rows_before").cast("double")))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (a rule is a condition that should hold), in one pass (DQ-6, DQ-8)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])


def finite(column: str) -> Column:
    """The value is a number: not null, not NaN and not infinite."""
    c = F.col(column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def leakage_rules(start: str, end: str, date: str = "date", target_end: str = "target_end_date") -> dict[str, Column]:
    """A sample's dates and the ends of its labels stay inside its window (DQ-7)."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return {
        "date_outside": F.col(date).between(first, last), "label_not_after_date": F.col(target_end) > F.col(date),
        "label_outside": F.col(target_end) <= last,
    }


def table_counts(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    """Rows and distinct entities per table (DQ-9)."""
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unpublished(stage: DataFrame, result: DataFrame, keys: Sequence[str], column: str, expected: str) -> DataFrame:
    """Staged rows that the published table does not show as expected (DQ-10)."""
    shown = result.select(*keys, F.col(column).alias("_shown"))
    joined = stage.join(shown, list(keys), "left")
    return joined.where(~F.col(expected).eqNullSafe(F.col("_shown"))).drop("_shown")


def digest_matches(content: str, digest: str) -> Column:
    """The bytes, or a failed job when they do not have the recorded SHA-256 (DQ-11)."""
    return F.when(F.sha2(F.col(content), 256) == F.col(digest), F.col(content)).otherwise(
        F.raise_error(F.concat(F.lit("stored bytes do not match digest "), F.col(digest))))


def assert_empty(problems: DataFrame, message: str) -> None:
    """Fail when a problem table has rows; shows a few of them."""
    rows = problems.limit(5).collect()
    if rows:
        raise QualityError(f"{message}: {[tuple(r) for r in rows]}")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail on repeated keys (DQ-2)."""
    assert_empty(duplicate_keys(df, keys), f"duplicate keys {list(keys)}")


def assert_no_orphans(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> None:
    """Fail on keys without a reference row (DQ-3)."""
    assert_empty(orphans(df, reference, keys).select(*keys), f"orphan keys {list(keys)}")


def assert_assigned_once(members: DataFrame, assignments: DataFrame, key: str) -> None:
    """Fail unless every member has exactly one assignment (DQ-4)."""
    assert_empty(assignment_problems(members, assignments, key), f"{key} not assigned exactly once")


def assert_row_drift(before: DataFrame, after: DataFrame, limit: float = 0.01) -> None:
    """Fail when the row count moved by more than ``limit`` (DQ-5)."""
    row = row_drift(before, after).first()
    if row.drift is None or row.drift > limit:
        raise QualityError(f"rows moved from {row.rows_before} to {row.rows_after}")


def assert_rules(df: DataFrame, rules: dict[str, Column]) -> None:
    """Fail when any rule is broken (DQ-6, DQ-7, DQ-8)."""
    row = violation_counts(df, rules).first().asDict()
    broken = {n: row[n] for n in rules if row[n]}
    if broken:
        raise QualityError(f"broken rules: {broken}")
