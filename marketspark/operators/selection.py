"""Pick one or a few rows per key, or the first rows overall.

Every rank filter below has the form ``row_number() <= k``. Spark turns that into a
group limit ahead of the shuffle, so each task sends at most k rows per key and a
hot key never gathers in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_match(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first k rows per key in ``order``; ``rank`` keeps the rank as a column."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the latest in ``order`` (column names sort descending, nulls last)."""
    return best_match(
        df, keys, [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in order]
    )


def peak_per_key(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row with the largest value per key, the first in ``tie`` among equals."""
    return best_match(df, keys, [F.col(value).desc_nulls_last(), *tie])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows overall; planned as a partial top-k per task."""
    return df.orderBy(*order).limit(k)


def top_k_per_entity(
    df: DataFrame, key: str, rank: Sequence[Column], tie: Sequence[Column], k: int
) -> DataFrame:
    """Reduce to the best row per entity, then take the first k entities."""
    return top_k(best_match(df, [key], [*rank, *tie]), [*rank, F.col(key)], k)


def with_group_values(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row: pre-aggregated, then joined back.

    Unlike an unordered window this lets the engine combine on the map side and
    split a skewed join, so a hot key is not sorted in one task.
    """
    totals = df.groupBy(*keys).agg(*aggregates)
    renamed = totals.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        *[c for c in totals.columns if c not in keys],
    )
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & df[k].eqNullSafe(F.col(f"_g{i}"))
    return df.join(renamed, match, "left").drop(*[f"_g{i}" for i in range(len(keys))])
