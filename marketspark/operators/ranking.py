"""Exact ranks, deciles and quantiles that never need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import stage


def _named(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def ranked_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
    number: str = "row_number", total: str = "group_rows",
) -> DataFrame:
    """Exact ``row_number`` and row count per group for groups of any size.

    A range partitioning on (group, order) splits a hot group over many partitions.
    It is checkpointed, so partition numbers are fixed, and only the counts per
    (group, partition) are combined to give each partition its offset.
    """
    spread = stage(
        df.repartitionByRange(*_named([*by, *order])).withColumn("_rank_part", F.spark_partition_id())
    )
    counts = spread.groupBy(*by, "_rank_part").agg(F.count(F.lit(1)).alias("_rank_n"))
    earlier = Window.partitionBy(*by).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(
        *[F.col(c).alias(f"_rank_k{i}") for i, c in enumerate(by)],
        F.col("_rank_part").alias("_rank_p"),
        F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0)).alias("_rank_offset"),
        F.sum("_rank_n").over(whole).alias("_rank_total"),
    )
    match = F.col("_rank_part") == F.col("_rank_p")
    for i, c in enumerate(by):
        match = match & spread[c].eqNullSafe(F.col(f"_rank_k{i}"))
    local = Window.partitionBy(*by, "_rank_part").orderBy(*order)
    placed = spread.withColumn("_rank_local", F.row_number().over(local)).join(offsets, match)
    return placed.select(
        *df.columns, (F.col("_rank_local") + F.col("_rank_offset")).alias(number), F.col("_rank_total").alias(total)
    )


def value_places(
    df: DataFrame, by: Sequence[str], column: str, extra: Sequence[Column] = (), first: str = "first_place", last: str = "last_place", total: str = "group_rows",
    times: str | None = None,
) -> DataFrame:
    """The distinct values of a column per group with the row numbers they take, nulls last.

    Equal values are counted before the shuffle, so a value that all rows share is one
    row here; only distinct values are sorted, and those split over any number of
    partitions. ``extra`` are more aggregates per value. ``times`` names a column that says
    how many rows a row stands for.
    """
    order = F.col(column).asc_nulls_last()
    counts = df.groupBy(*by, column).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_place_n"), *extra)
    spread = stage(counts.repartitionByRange(*_named(by), order).withColumn("_place_part", F.spark_partition_id()))
    sums = spread.groupBy(*by, "_place_part").agg(F.sum("_place_n").alias("_place_sum"))
    earlier = Window.partitionBy(*by).orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_place_k{i}") for i, c in enumerate(by)], F.col("_place_part").alias("_place_p"),
        F.coalesce(F.sum("_place_sum").over(earlier), F.lit(0)).alias("_place_offset"), F.sum("_place_sum").over(Window.partitionBy(*by)).alias(total),
    )
    match = F.col("_place_part") == F.col("_place_p")
    for i, c in enumerate(by):
        match = match & spread[c].eqNullSafe(F.col(f"_place_k{i}"))
    local = Window.partitionBy(*by, "_place_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_place_local") + F.col("_place_offset")
    placed = spread.withColumn("_place_local", F.sum("_place_n").over(local)).join(offsets, match)
    kept = [c for c in counts.columns if c != "_place_n"]
    return placed.select(*kept, (upto - F.col("_place_n") + 1).alias(first), upto.alias(last), F.col(total))


def _with_places(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Every row next to the places of its value; null values and null groups find theirs."""
    keys = [*by, column]
    places = value_places(df, by, column, first="_first", last="_last", total="_rows")
    places = places.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_first", "_last", "_rows")
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(places, match).drop(*[f"_k{i}" for i in range(len(keys))])


def average_ranks(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """Rank with ties sharing their mean rank; every row is kept, null values rank last."""
    rank = (F.col("_first") + F.col("_last")) / 2
    return _with_places(df, by, column).withColumn(out, rank).drop("_first", "_last", "_rows")


def percent_rank(df: DataFrame, by: Sequence[str], column: str, out: str) -> DataFrame:
    """SQL ``percent_rank`` ordered by one column, nulls last."""
    share = F.when(F.col("_rows") > 1, (F.col("_first") - 1) / (F.col("_rows") - 1)).otherwise(0.0)
    return _with_places(df, by, column).select(*df.columns, share.cast("double").alias(out))


def n_tiles(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, out: str) -> DataFrame:
    """SQL ``ntile(k)``: the first (rows mod k) tiles hold one row more."""
    numbered = ranked_rows(df, by, order, "_rn", "_rows")
    small, extra = F.floor(F.col("_rows") / k), F.col("_rows") % k
    cut = extra * (small + 1)
    tile = F.when(F.col("_rn") <= cut, F.ceil(F.col("_rn") / (small + 1))).otherwise(
        extra + F.ceil((F.col("_rn") - cut) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(out, tile.cast("long")).drop("_rn", "_rows")


def equal_buckets(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, out: str,
    drop_small: bool = False,
) -> DataFrame:
    """Bucket ``min(ceil(rank / n * k), k)`` with rank in ``order``; optionally drop groups under k rows."""
    numbered = ranked_rows(df, by, order, "_rn", "_rows")
    if drop_small:
        numbered = numbered.where(F.col("_rows") >= k)
    share = F.col("_rn").cast("double") / F.col("_rows").cast("double")
    bucket = F.least(F.ceil(share * F.lit(float(k))), F.lit(k)).cast("int")
    return numbered.withColumn(out, bucket).drop("_rn", "_rows")


def exact_quantile(df: DataFrame, by: Sequence[str], column: str, q: float, out: str, times: str | None = None) -> DataFrame:
    """Linearly interpolated exact quantile per group (``q=0.5`` is the median).

    Only distinct values are ranked, and the one or two that take the wanted places
    are aggregated per group. ``times`` names a column that says how many rows a row stands for.
    """
    values = df.select(*by, column, *([times] if times else [])).where(F.col(column).isNotNull())
    places = value_places(values, by, column, first="_first", last="_last", total="_rows", times=times)
    place = (F.col("_rows") - 1) * F.lit(float(q)) + 1
    below = F.floor(place)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col(column).cast("double")))

    ends = places.where((F.col("_first") <= below + 1) & (below <= F.col("_last"))).groupBy(*by).agg(
        at(below).alias("_low"), at(below + 1).alias("_high"), F.max(place - below).alias("_part")
    )
    # beyond the last row there is no upper neighbour, and its weight is zero
    value = F.when(F.col("_part") > 0, F.col("_low") * (1 - F.col("_part")) + F.col("_high") * F.col("_part")).otherwise(F.col("_low"))
    return ends.select(*by, value.alias(out))


def hash_first_k(
    df: DataFrame, stratum: Sequence[str], identity: Sequence[str], salt: str, k: int,
    out: str = "sample_rank",
) -> DataFrame:
    """First k rows per stratum in the order of a hash: a repeatable stratified sample.

    The rank filter lets Spark keep only k rows per stratum and input task before
    it shuffles, so a hot stratum stays cheap.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(salt)))
    window = Window.partitionBy(*stratum).orderBy(digest, *identity)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
