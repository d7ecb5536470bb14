"""Unions with provenance and projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL of aligned tables, each row tagged with its source."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(*tables: DataFrame) -> DataFrame:
    """UNION with duplicates removed."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of the named columns."""
    return df.select(*columns).distinct()


def counted_rows(df: DataFrame, out: str) -> DataFrame:
    """Distinct rows with the number of times each occurs (nulls are equal)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(out))


def repeated_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as ``times`` says, without that column: the inverse of :func:`counted_rows`."""
    kept = [c for c in df.columns if c != times]
    return df.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias("_copy")).drop("_copy")


def project(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Select, rename and cast: output name to column or expression."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows meeting every condition; pushed into the scan where the source allows it."""
    return reduce(lambda d, c: d.where(c), conditions, df)


def ordered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Global order; strings sort ascending with nulls last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in keys])
