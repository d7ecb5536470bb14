"""Ordered operators over keyed, dated tables that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the
order column is cut into slices of fixed width. Each (key, slice) is windowed on
its own and a small summary with one row per (key, slice) carries the state of the
earlier slices, so the answer equals the plain window while no task needs more
than one slice of one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import stage

SLICE_DAYS = 180
_START = Window.unboundedPreceding


def time_slice(column: str | Column, days: float = SLICE_DAYS) -> Column:
    """Number of the slice of ``days`` days that a date or timestamp falls into.

    Below one day the width is counted in hours, so 1/24 gives hourly slices.
    """
    col = F.col(column) if isinstance(column, str) else column
    day = F.unix_date(col.cast("date"))
    if days >= 1:
        return F.floor(day / F.lit(days))
    return F.floor((day * 24 + F.hour(col)) / F.lit(days * 24))


def suggest_slice_days(df: DataFrame, keys: Sequence[str], time: str, rows_per_slice: int = 2_000_000) -> float:
    """Slice width that keeps the busiest (key, day) of a table near ``rows_per_slice`` rows.

    One pass of partial counts; only the largest count comes back. Use it for event
    data, where a hot key may have any number of rows per day.
    """
    daily = df.groupBy(*keys, F.col(time).cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    busiest = daily.agg(F.max("_n")).first()[0] or 1
    return min(max(rows_per_slice / busiest, 1 / 24), float(SLICE_DAYS))


@dataclass(frozen=True)
class Fold:
    """State along an order: ``sum``, ``min``, ``max`` or ``last`` (latest non-null) of ``value``.

    ``reverse`` runs from the last row to the first, ``exclusive`` leaves the current row
    out. With ``since`` a sum starts anew at every row where that holds, which counts.
    """

    kind: str
    value: Column
    reverse: bool = False
    exclusive: bool = False
    since: Column | None = None


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: dict[str, Fold],
    *, slice_days: float = SLICE_DAYS, slice_by: Column | None = None,
) -> DataFrame:
    """Add several running states in one pass over the slices.

    Each state forms a monoid (a sum with ``since`` as "sum from the last break on, and is
    there one?"), so one row per (key, slice) holds what the slice adds, and a window over
    these few rows what all earlier ones carry into it. That row is put in front of its
    slice's rows, where the states start from it. ``order[0]`` is a date or timestamp and
    must be non-null; for an order of another type ``slice_by`` gives a slice number that
    never falls along it. Null keys are keys like any other.
    """
    group = [*keys, "_slice"]
    values = {name: f"_v_{i}" for i, name in enumerate(folds)}
    breaks = {name: f"_b_{i}" for i, name in enumerate(folds) if folds[name].since is not None}
    for name in breaks:
        if folds[name].kind != "sum" or folds[name].reverse or folds[name].exclusive:
            raise ValueError("since works for forward, inclusive sums")
    sliced = df.select(
        "*", (time_slice(order[0], slice_days) if slice_by is None else slice_by).alias("_slice"),
        *[fold.value.alias(values[name]) for name, fold in folds.items()],
        *[F.when(folds[name].since, 1).otherwise(0).alias(column) for name, column in breaks.items()],
    )

    def inside(reverse: bool = False, *parts: str) -> Window:
        return Window.partitionBy(*group, *parts).orderBy("_data", *[F.col(c).desc() if reverse else F.col(c) for c in order])

    # what each slice adds
    parts = sliced.select(*group, *order, *values.values(), *breaks.values(), F.lit(1).alias("_data"))
    for column in breaks.values():
        parts = parts.withColumn(f"_g{column}", F.sum(column).over(inside()))
        parts = parts.withColumn(f"_m{column}", F.max(f"_g{column}").over(Window.partitionBy(*group)))
    added = []
    for name, fold in folds.items():
        value = F.col(values[name])
        if name in breaks:
            after = F.col(f"_g{breaks[name]}") == F.col(f"_m{breaks[name]}")
            added += [F.sum(F.when(after, value)).alias(values[name]), (F.max(f"_m{breaks[name]}") > 0).cast("int").alias(breaks[name])]
        elif fold.kind == "last":
            added.append((F.min_by if fold.reverse else F.max_by)(value, F.when(value.isNotNull(), F.struct(*order))).alias(values[name]))
        else:
            added.append(_FOLD[fold.kind](value).alias(values[name]))
    summary = parts.groupBy(*group).agg(*added)

    # what earlier slices carry into each
    carries = []
    for name, fold in folds.items():
        along = Window.partitionBy(*keys).orderBy(F.col("_slice").desc() if fold.reverse else F.col("_slice"))
        if name in breaks:
            column = breaks[name]
            summary = summary.withColumn(f"_g{column}", F.sum(column).over(along))
            upto = Window.partitionBy(*keys, f"_g{column}").orderBy("_slice").rowsBetween(_START, 0)
            summary = summary.withColumn(f"_t{column}", F.sum(values[name]).over(upto))
            carries.append(F.lag(f"_t{column}").over(along).alias(values[name]))
        else:
            carries.append(_FOLD[fold.kind](F.col(values[name])).over(along.rowsBetween(_START, -1)).alias(values[name]))
    # one row per (key, slice), written once: chains stay linear
    carried = stage(summary.select(*group, *carries))

    rows = sliced.withColumn("_data", F.lit(1)).unionByName(carried.withColumn("_data", F.lit(0)), allowMissingColumns=True)
    for column in breaks.values():
        rows = rows.withColumn(f"_g{column}", F.sum(F.coalesce(column, F.lit(0))).over(inside()))
    results = []
    for name, fold in folds.items():
        window = inside(fold.reverse, *([f"_g{breaks[name]}"] if name in breaks else []))
        results.append(_FOLD[fold.kind](F.col(values[name])).over(window.rowsBetween(_START, -1 if fold.exclusive else 0)).alias(f"_r{values[name]}"))
    kept = [c for c in df.columns if c not in folds]
    return rows.select(*kept, "_data", *results).where("_data = 1").select(*kept, *[F.col(f"_r{values[name]}").alias(name) for name in folds])


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, tuple[str, Column]],
    *, reverse: bool = False, exclusive: bool = False, slice_days: float = SLICE_DAYS, slice_by: Column | None = None,
) -> DataFrame:
    """Add running aggregates in ``order`` per key, all in one direction; see :func:`scan`.

    ``specs`` maps an output name to (``sum`` | ``min`` | ``max`` | ``last``, expression).
    """
    folds = {name: Fold(kind, value, reverse, exclusive) for name, (kind, value) in specs.items()}
    return scan(df, keys, order, folds, slice_days=slice_days, slice_by=slice_by)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    *,
    following: bool = False,
    slice_days: float = SLICE_DAYS,
) -> DataFrame:
    """``lag(1)`` (or ``lead(1)``) of several columns; ``columns`` maps output to input."""
    packed = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    moved = running(
        df, keys, order, {"_row": ("last", packed)},
        reverse=following, exclusive=True, slice_days=slice_days,
    )
    kept = [c for c in df.columns if c not in columns]
    return moved.select(*kept, *[F.col(f"_row.c{i}").alias(o) for i, o in enumerate(columns)])


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[Column, int, int]],
    *,
    slice_days: float = SLICE_DAYS,
    block_rows: int | None = None,
) -> DataFrame:
    """Aggregates over row frames, e.g. ``{"r14": (F.sum("x"), -13, 0)}``.

    Rows get their exact ordinal within the key, are cut into blocks of
    ``block_rows`` ordinals, and the few rows a neighbouring block's frames reach
    into are copied there as a halo. A key of any length thus spreads over many
    tasks, and the copied share is at most (before + after) / block_rows.
    """
    before = max([0, *[-start for _, start, _ in outputs.values()]])
    after = max([0, *[end for _, _, end in outputs.values()]])
    size = block_rows or max(512, 8 * (before + after))
    if size < max(before, after):
        raise ValueError("block_rows must be at least as long as the longest frame")
    columns = df.columns
    numbered = running(df, keys, order, {"_n": ("sum", F.lit(1))}, slice_days=slice_days)
    position = (F.col("_n") - 1) % size
    home = F.floor((F.col("_n") - 1) / size)
    targets = F.array_compact(
        F.array(
            home,
            F.when(position >= size - before, home + 1),
            F.when(position < after, home - 1),
        )
    )
    spread = numbered.select("*", home.alias("_home"), F.explode(targets).alias("_block"))
    rows = Window.partitionBy(*keys, "_block").orderBy(*order)
    computed = spread.select(
        *[c for c in columns if c not in outputs], "_home", "_block",
        *[agg.over(rows.rowsBetween(lo, hi)).alias(name) for name, (agg, lo, hi) in outputs.items()],
    )
    return computed.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def shift(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, offsets: dict[str, int],
    **options,
) -> DataFrame:
    """``lead`` by k rows (``lag`` for negative k) for several offsets at once."""
    outputs = {name: (F.max(F.col(column)), k, k) for name, k in offsets.items()}
    return framed(df, keys, order, outputs, **options)


def cumulative_factor(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: Column,
    factor: str, log_factor: str, **options,
) -> DataFrame:
    """Running product of a positive ratio as ``exp`` of a running sum of logs."""
    logs = running(df, keys, order, {log_factor: ("sum", F.ln(ratio))}, **options)
    return logs.withColumn(factor, F.exp(log_factor))


def segment_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], broken: Column, out: str, **options
) -> DataFrame:
    """Running count of rows where ``broken`` holds: a new segment starts at each of them."""
    flag = F.when(broken, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return running(df, keys, order, {out: ("sum", flag)}, **options)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], **options
) -> DataFrame:
    """Latest non-null value up to and including each row; ``columns`` maps output to input."""
    specs = {out: ("last", F.col(src)) for out, src in columns.items()}
    return running(df, keys, order, specs, **options)
