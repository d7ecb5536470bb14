"""Table changes as DataFrame compositions, and a publish step that is all or nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.operators.ranking import ranked_rows


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] | None = None, last: bool = True) -> DataFrame:
    """The last (or first) row of every key in ``order``, by default of all columns; combined before the shuffle."""
    pick = F.max_by if last else F.min_by
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(pick(whole, F.struct(*(order or df.columns))).alias("_row")).select("_row.*")


def append_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Insert or ignore: existing rows plus the first incoming row of every unseen key (MUT-1)."""
    fresh = one_per_key(incoming, key, order, last=False).join(existing.select(*key).distinct(), list(key), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Insert or replace by key (MUT-2); of repeated incoming keys the last row in ``order`` wins."""
    latest = one_per_key(incoming, key, order)
    kept = existing.join(latest.select(*key), list(key), "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def replace_keys(existing: DataFrame, incoming: DataFrame, key: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """Delete every row of the named keys, then insert (MUT-3); rebuilding twice changes nothing."""
    gone = (keys if keys is not None else incoming).select(*key).distinct()
    return existing.join(gone, list(key), "left_anti").unionByName(incoming, allowMissingColumns=True)


def update_from(
    df: DataFrame, changes: DataFrame, key: Sequence[str], values: dict[str, Column], when: Column, always: dict[str, Column] | None = None
) -> DataFrame:
    """UPDATE ... FROM: set ``values`` (over both sides' columns) where a change row exists and ``when`` holds (MUT-4).

    ``always`` is set on every row, next to its change row or to nulls.
    """
    marked = changes.select(*key, *[F.col(c).alias(f"change_{c}") for c in changes.columns if c not in key], F.lit(True).alias("_hit"))
    joined = df.join(marked, list(key), "left")
    hit = F.coalesce(F.col("_hit") & when, F.lit(False))
    always = always or {}
    columns = [
        F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else always.get(c, F.col(c)).alias(c) for c in df.columns
    ]
    return joined.select(*columns)


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as typed nulls (MUT-5)."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def assign_ids(
    existing: DataFrame | None, incoming: DataFrame, key: Sequence[str], id_column: str, only_new: bool = False
) -> DataFrame:
    """Number unseen entities after the highest existing id, in key order (MUT-6).

    Known keys keep their ids. Only the highest id is looked up, as a scalar.
    """
    names = [id_column, *incoming.columns]
    if existing is None:
        numbered = ranked_rows(incoming, [], list(key), id_column, "_all")
        return numbered.select(*names)
    known = existing.select(*key, id_column)
    fresh = incoming.join(known.select(*key), list(key), "left_anti")
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).scalar()
    numbered = ranked_rows(fresh, [], list(key), "_n", "_all")
    numbered = numbered.withColumn(id_column, top + F.col("_n")).select(*names)
    if only_new:
        return numbered
    return incoming.join(known, list(key)).select(*names).unionByName(numbered)


def resolve_seed(seed: DataFrame, spans: DataFrame, key: str, date: str, start: str, end: str, id_column: str) -> DataFrame:
    """Attach the current id of the span a natural-key row falls into, exactly once (MUT-10).

    A row without a span, or with more than one, fails the job that reads the result.
    """
    numbered = seed.withColumn("_seed", F.xxhash64(*seed.columns))
    inside = F.col(date).between(F.col(start), F.col(end))
    matches = numbered.join(spans.select(key, start, end, id_column), key, "left").withColumn("_in", inside)
    grouped = matches.groupBy("_seed", *seed.columns).agg(
        F.count_if("_in").alias("_n"), F.max(F.when(F.col("_in"), F.col(id_column))).alias(id_column)
    )
    checked = F.when(F.col("_n") == 1, F.col(id_column)).otherwise(
        F.raise_error(F.concat(F.lit("seed row matches "), F.col("_n").cast("string"), F.lit(" spans")))
    )
    return grouped.select(checked.cast("long").alias(id_column), *seed.columns)


def publish_atomic(df: DataFrame, folder: str, check: Callable[[DataFrame], None] | None = None) -> str:
    """Write a new version, check it, and only then name it current (MUT-8).

    Readers follow the small pointer table, so a failed check or job leaves the
    previous version in place. Returns the version's path.
    """
    spark = df.sparkSession
    version = datetime.now(timezone.utc).strftime("v%Y%m%dT%H%M%S%f")
    path = f"{folder}/{version}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    if check is not None:
        check(spark.read.parquet(path))
    pointer = T.StructType([T.StructField("version", T.StringType(), False)])
    spark.createDataFrame([(version,)], pointer).coalesce(1).write.mode("append").json(f"{folder}/_pointers")
    return path


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a published table."""
    row = spark.read.schema("version string").json(f"{folder}/_pointers").agg(F.max("version")).first()
    return spark.read.parquet(f"{folder}/{row[0]}")


def snapshot(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Keep a copy of a table before changing it (MUT-9)."""
    path = f"{folder}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
