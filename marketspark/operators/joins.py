"""Equi, as-of, band, interval, nearest and calendar joins as DataFrame compositions.

Time-based joins add a bucket of the time column to the equi key. A hot key is then
spread over its buckets, and only rows of nearby buckets ever meet, so nothing falls
back to a nested loop or a cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.selection import best_match, with_group_values
from marketspark.operators.timeline import SLICE_DAYS, Fold, neighbours, running, scan, time_slice
from marketspark.session import bounded_broadcast, stage


def inner_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi join on shared column names."""
    return left.join(right, list(on), "inner")


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi join on shared column names."""
    return left.join(right, list(on), "left")


def using_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """USING join: the key appears once in the output."""
    return left.join(right, list(on), how)


def filtered_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], right_filter: Column, how: str = "left"
) -> DataFrame:
    """Equi join with a constant predicate on the right side, applied before the join."""
    return left.join(right.where(right_filter), list(on), how)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose (possibly multi-column) key occurs on the right."""
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def ci_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner"
) -> DataFrame:
    """Equi join on upper-cased text keys."""
    return left.join(right, F.upper(left[left_key]) == F.upper(right[right_key]), how)


def or_join(
    left: DataFrame, right: DataFrame, left_key: Column, exact: Column, canonical: Column, tag: str
) -> DataFrame:
    """Join on ``left_key = exact OR left_key = canonical``.

    Two equi joins, the second without the pairs of the first, replace the
    nested loop an OR condition would need. ``tag`` says which key matched.
    """
    probe = left.withColumn("_probe", left_key)
    table = right.withColumn("_exact", exact).withColumn("_canonical", canonical)
    first = probe.join(table, F.col("_probe") == F.col("_exact")).withColumn(tag, F.lit("exact_code"))
    differs = F.coalesce(F.col("_probe") != F.col("_exact"), F.lit(True))
    second = probe.join(table, (F.col("_probe") == F.col("_canonical")) & differs)
    second = second.withColumn(tag, F.lit("canonicalized_code"))
    return first.unionByName(second).drop("_probe", "_exact", "_canonical")


def conflicts(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows present on both sides under the same key whose ``column`` differs."""
    renamed = right.select(*keys, F.col(column).alias(f"other_{column}"))
    return left.join(renamed, list(keys)).where(F.col(column) != F.col(f"other_{column}"))


def provider_pair(
    df: DataFrame, vendor: DataFrame, key: str, date: str, previous_date: str, values: Sequence[str]
) -> DataFrame:
    """Attach a second source's values at each row's date and at its previous date."""
    now = vendor.select(key, F.col("date").alias(date), *[F.col(v).alias(f"current_{v}") for v in values])
    then = vendor.select(
        key, F.col("date").alias(previous_date), *[F.col(v).alias(f"previous_{v}") for v in values]
    )
    return df.join(now, [key, date]).join(then, [key, previous_date])


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    columns: dict[str, str], *, max_age_days: int | None = None,
    tie: Sequence[str] | None = None, slice_days: float = SLICE_DAYS, forward: bool = False, sparse: bool = False,
) -> DataFrame:
    """For each left row the latest right row with the same key and ``right_time <= left_time``.

    With ``forward`` it is the earliest one with ``right_time >= left_time``.
    ``columns`` maps output names to right columns. Right rows that share key and
    time are an error unless ``tie`` orders them (the largest wins). The lookup runs
    once per distinct (key, time) of the left side on time slices, and its answer is
    joined back by equality, so neither a hot key nor a hot instant gathers in a task.
    With ``sparse``, for a right side that few keys occur in, other keys are not looked up.
    """
    values = {n: F.col(src).alias(n) for n, src in [("_at", right_time), *((f"_c{i}", src) for i, src in enumerate(columns.values()))]}
    usable = right.where(F.col(right_time).isNotNull())
    for key in on:
        usable = usable.where(F.col(key).isNotNull())
    events = usable.groupBy(*on, F.col(right_time).alias("_t"))
    if tie:
        events = events.agg(F.max_by(F.struct(*values.values()), F.struct(*tie)).alias("_row"))
    else:
        # column by column: numbers and dates are hashed then, where a struct would be sorted
        one = F.when(F.col("_n") == 1, F.struct(*values)).otherwise(
            F.raise_error(F.lit("as-of join: several right rows share a key and time; give a tie order"))
        )
        events = events.agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(n) for n, c in values.items()]).select(*on, "_t", one.alias("_row"))
    probes = left.select(*on, F.col(left_time).alias("_t")).distinct().where(F.col("_t").isNotNull())
    for key in on:
        probes = probes.where(F.col(key).isNotNull())
    if sparse:
        probes = probes.join(bounded_broadcast(events.select(*on).distinct()), list(on), "left_semi")
    tagged = events.select(*on, F.col("_t").cast("timestamp_ntz"), F.lit(2 if forward else 0).alias("_side"), "_row").unionByName(
        probes.select(*on, F.col("_t").cast("timestamp_ntz"), F.lit(1).alias("_side")), allowMissingColumns=True
    )
    # keys, times and events only: the left side itself is read once more, in the join at the end
    tagged = stage(tagged)
    filled = running(
        tagged, on, ["_t", "_side"], {"_found": ("last", F.col("_row"))}, slice_days=slice_days, reverse=forward
    ).where(F.col("_side") == 1)
    found = filled.select(*on, F.col("_t").alias("_when"), "_found")
    if sparse:
        found = bounded_broadcast(stage(found))
    probe = left.withColumn("_when", F.col(left_time).cast("timestamp_ntz"))
    joined = probe.join(found, [*on, "_when"], "left")
    row = F.col("_found")
    if max_age_days is not None:
        age = F.abs(F.datediff(F.col(left_time).cast("date"), F.col("_found._at").cast("date")))
        row = F.when(age <= max_age_days, row)
    kept = [c for c in left.columns if c not in columns]
    return joined.withColumn("_found", row).select(
        *kept, *[F.col(f"_found._c{i}").alias(out) for i, out in enumerate(columns)]
    )


def asof_chain(left: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Several as-of joins in turn; a step may use a time column found by an earlier one."""
    for step in steps:
        left = asof_join(left, **step)
    return left


def _spread(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(first, last)))


def band_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str,
    before: int, after: int,
) -> DataFrame:
    """Pairs with equal key and ``-before <= right_time - left_time <= after`` in days.

    The right side must not share column names with the left except the key.
    """
    width = max(before + after, 1)
    buckets = _spread(
        left,
        time_slice(F.date_sub(F.col(left_time).cast("date"), before), width),
        time_slice(F.date_add(F.col(left_time).cast("date"), after), width),
    )
    table = right.withColumn("_bucket", time_slice(right_time, width))
    distance = F.datediff(F.col(right_time).cast("date"), F.col(left_time).cast("date"))
    return buckets.join(table, [*key, "_bucket"]).where(distance.between(-before, after)).drop("_bucket")


def left_rest(left: DataFrame, matched: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Add the left rows without a match (right columns null); ``identity`` is a key of ``left``."""
    rest = left.join(matched.select(*identity).distinct(), list(identity), "left_anti")
    return matched.unionByName(rest, allowMissingColumns=True)


def latest_within(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, days: int,
    identity: Sequence[str], tie: Sequence[str | Column] = (),
) -> DataFrame:
    """Latest right row at most ``days`` days on or before the left time, per ``identity``; left rows without one are dropped.

    An as-of join with a maximum age: no pairs of the band are formed. ``tie`` orders
    right rows of one key and time, the first wins.
    """
    one = best_match(right, [*key, right_time], [*tie] or [c for c in right.columns if c not in key])
    names = {c: c for c in right.columns if c not in key}
    found = asof_join(left, one, key, left_time, right_time, names, max_age_days=days)
    return best_match(found.where(F.col(right_time).isNotNull()), identity, [F.col(right_time).desc(), *tie])


def next_within(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, days: int, out: str
) -> DataFrame:
    """Smallest right time within ``days`` days on or after the left time; left rows without one are dropped.

    Looked up once per distinct key and time and joined back, so equal left rows all stay.
    """
    slim = right.select(*key, right_time).distinct()
    pairs = band_join(left.select(*key, left_time).distinct(), slim, key, left_time, right_time, 0, days)
    return left.join(pairs.groupBy(*key, left_time).agg(F.min(right_time).alias(out)), [*key, left_time]).select(*left.columns, out)


def nearest_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, days: int,
    identity: Sequence[str], priority: Sequence[Column] = (), tie: Sequence[str | Column] = (),
    distance: str = "day_distance",
) -> DataFrame:
    """Best right row within ``days`` days in either direction; left rows without one are kept.

    ``priority`` names classes of right rows, each a condition on the right side: rows of
    an earlier class win at any distance, rows of none come last. ``tie`` sorts after the
    distance. Every class is looked up backward and forward, so a left row meets at most
    two rows of each class and no pairs of the band are formed.
    """
    rank = F.lit(len(priority))
    for number, condition in reversed(list(enumerate(priority))):
        rank = F.when(condition, number).otherwise(rank)
    values = [c for c in right.columns if c not in key]
    order = [*tie] or values
    classed = best_match(right.where(F.col(right_time).isNotNull()).withColumn("_class", rank), [*key, "_class", right_time], order)
    asked = left.select(*key, left_time).distinct().withColumn("_class", F.explode(F.array(*[F.lit(i) for i in range(len(priority) + 1)])))
    names = {f"_n_{c}": c for c in values}
    found = None
    for forward in (False, True):
        side = asof_join(asked, classed, [*key, "_class"], left_time, right_time, names, max_age_days=days, forward=forward)
        found = side if found is None else found.unionByName(side)
    found = found.where(F.col(f"_n_{right_time}").isNotNull()).withColumnsRenamed(dict(names))
    found = found.withColumn(distance, F.abs(F.datediff(left_time, right_time)))
    best = best_match(found, [*key, left_time], ["_class", distance, *order]).drop("_class")
    return left_rest(left, left.join(best, [*key, left_time]), identity).select(*left.columns, *values, distance)


def nearest_interval(
    points: DataFrame, spans: DataFrame, key: Sequence[str], time: str, start: str, end: str, label: str, distance: str
) -> DataFrame:
    """(key, time, label, distance): the span of the key that holds the time, else the one whose end is nearest.

    Of spans equally near the earliest start counts, then the least ``label``. A time
    meets the spans that hold it, the last one to end before it and the first one to
    start after it; no other pairs are formed.
    """
    asked = points.select(*key, time).where(F.col(time).isNotNull()).distinct()
    names = [start, end, label]
    slim = spans.select(*key, *names)
    inside = interval_join(asked, slim, key, time, start, end).select(*key, time, *names)
    found = inside
    for at, forward in ((end, False), (start, True)):
        one = best_match(slim, [*key, at], [start, label])
        near = asof_join(asked, one, key, time, at, {f"_n_{c}": c for c in names}, forward=forward)
        found = found.unionByName(near.where(F.col(f"_n_{label}").isNotNull()).withColumnsRenamed({f"_n_{c}": c for c in names}))
    away = F.least(F.abs(F.datediff(time, start)), F.abs(F.datediff(time, end)))
    measured = found.withColumn(distance, F.when(F.col(time).between(F.col(start), F.col(end)), 0).otherwise(away))
    return best_match(measured, [*key, time], [distance, start, label]).select(*key, time, label, distance)


def interval_join(
    points: DataFrame, spans: DataFrame, key: Sequence[str], time: str, start: str, end: str,
    slice_days: int = 366,
) -> DataFrame:
    """Points inside ``[start, end]`` of spans with the same key."""
    table = _spread(
        spans.where(F.col(start) <= F.col(end)), time_slice(start, slice_days), time_slice(end, slice_days)
    )
    probe = points.withColumn("_bucket", time_slice(time, slice_days))
    return (
        probe.join(table, [*key, "_bucket"])
        .where(F.col(time).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def expand_sessions(
    spans: DataFrame, calendar: DataFrame, start: str, end: str, session: str = "session_date",
    slice_days: int = 366,
) -> DataFrame:
    """One row per span and session inside it. Output-sized; the calendar is broadcast if small."""
    table = _spread(
        spans.where(F.col(start) <= F.col(end)), time_slice(start, slice_days), time_slice(end, slice_days)
    )
    days = bounded_broadcast(calendar.withColumn("_bucket", time_slice(session, slice_days)))
    return (
        table.join(days, "_bucket")
        .where(F.col(session).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def session_neighbours(calendar: DataFrame, session: str = "session_date") -> DataFrame:
    """Each distinct session with the previous and the next one.

    A global order is safe here: a calendar has one row per date.
    """
    order = Window.orderBy(session)
    return (
        calendar.select(session).distinct().select(
            session,
            F.lag(session).over(order).alias("previous_session"),
            F.lead(session).over(order).alias("next_session"),
        )
    )


def prev_session_join(
    df: DataFrame, calendar: DataFrame, key: str, date: str, columns: dict[str, str], how: str = "left"
) -> DataFrame:
    """Attach values of the same key on the previous *session* (never across a gap)."""
    sessions = bounded_broadcast(
        session_neighbours(calendar).select(
            F.col("session_date").alias(date), F.col("previous_session").alias("previous_date")
        )
    )
    earlier = df.select(
        key, F.col(date).alias("previous_date"), *[F.col(src).alias(out) for out, src in columns.items()]
    )
    return df.join(sessions, date).join(earlier, [key, "previous_date"], how)


def continuing(df: DataFrame, calendar: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    """(session, key) pairs where the key was present on both neighbouring sessions."""
    sessions = bounded_broadcast(session_neighbours(calendar).dropna())
    present = df.select(*key, F.col(date).alias("_seen")).distinct()
    before = sessions.join(present, F.col("previous_session") == F.col("_seen")).drop("_seen")
    after = present.withColumnRenamed("_seen", "next_session")
    return before.join(after, [*key, "next_session"])


def prev_next_value(
    df: DataFrame, keys: Sequence[str], order: str, column: str, previous: str, following: str, **options
) -> DataFrame:
    """Nearest non-null values strictly before and strictly after each row."""
    value = F.col(column)
    folds = {previous: Fold("last", value, exclusive=True), following: Fold("last", value, reverse=True, exclusive=True)}
    return scan(df, keys, [order], folds, **options)


def asof_latest_source(
    left: DataFrame, sources: DataFrame, key: Sequence[str], date: str, published: str, days: int,
    identity: Sequence[str], tie: Sequence[str | Column] = (),
) -> DataFrame:
    """Per left row the newest source published on or before it and at most ``days`` days old."""
    return latest_within(left, sources, key, date, published, days, identity, tie)


def newest_published(
    left: DataFrame, sources: DataFrame, keys: Sequence[str], date: str, published: str, first_usable: str, out: str
) -> DataFrame:
    """Add the newest publication time among the sources published and usable by each row's date.

    A source counts from the later of its two times on, so the answer is the running
    maximum of publications in that order: a left row meets one row, whatever the number
    of sources of its key.
    """
    at = F.greatest(F.col(published).cast("timestamp_ntz"), F.col(first_usable).cast("timestamp_ntz"))
    known = sources.where(F.col(published).isNotNull() & F.col(first_usable).isNotNull())
    steps = known.groupBy(*keys, at.alias("_from")).agg(F.max(published).alias("_published"))
    newest = running(steps, keys, ["_from"], {"_newest": ("max", F.col("_published"))})
    return asof_join(left, newest, keys, date, "_from", {out: "_newest"})


def latest_available_source(
    left: DataFrame, sources: DataFrame, keys: Sequence[str], date: str, published: str, first_usable: str, days: int | None = None
) -> DataFrame:
    """Each left row with the sources of its newest publication usable by its date, at most ``days`` days old.

    Several sources of one publication time all stay. Left rows without one are dropped.
    """
    dated = newest_published(left, sources, keys, date, published, first_usable, "_newest").where("_newest IS NOT NULL")
    if days is not None:
        dated = dated.where(F.datediff(F.col(date).cast("date"), F.col("_newest").cast("date")) <= days)
    named = sources.withColumn("_newest", F.col(published))
    return dated.join(named, [*keys, "_newest"]).where(F.col(first_usable) <= F.col(date)).drop("_newest")


def has_event_between(
    left: DataFrame, events: DataFrame, key: str, start: str, end: str, event_time: str, out: str
) -> DataFrame:
    """True when an event of the key lies in ``(start, end]``.

    Events are counted along the times asked for in one pass, and the counts at ``end``
    and ``start`` compared, so no left row ever meets an event row.
    """
    daily = events.select(key, F.col(event_time).cast("timestamp_ntz").alias("_e")).where("_e IS NOT NULL").groupBy(key, "_e").agg(F.count(F.lit(1)).alias("_k"))
    asked = left.select(key, F.explode(F.array(F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz"))).alias("_e")).where("_e IS NOT NULL").distinct()
    merged = stage(daily.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    counted = running(merged, [key], ["_e", "_side"], {"_n": ("sum", F.col("_k"))}).where("_side = 1").select(key, "_e", F.coalesce("_n", F.lit(0)).alias("_n"))
    both = left
    for time, n in ((end, "_n_end"), (start, "_n_start")):
        found = counted.select(F.col(key), F.col("_e").alias("_when"), F.col("_n").alias(n))
        both = both.withColumn("_when", F.col(time).cast("timestamp_ntz")).join(found, [key, "_when"], "left").drop("_when")
    more = F.coalesce("_n_end", F.lit(0)) > F.coalesce("_n_start", F.lit(0))
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    return both.withColumn(out, known & more).select(*left.columns, out)


def overlapping_pairs(
    df: DataFrame, key: Sequence[str], identity: str, start: str, end: str,
    columns: Sequence[str] = (), slice_days: int = 366,
) -> DataFrame:
    """Pairs ``a.identity < b.identity`` of one key whose intervals overlap.

    Intervals meet only inside shared time slices, and a pair is taken in the slice
    where its overlap starts, so pairs that do not overlap are never formed far apart
    in time and no pair appears twice.
    """
    parts = _spread(df, time_slice(start, slice_days), time_slice(end, slice_days))
    names = [identity, start, end, *columns]
    a = parts.select(*key, "_bucket", *[F.col(c).alias(f"{c}_a") for c in names])
    b = parts.select(*key, "_bucket", *[F.col(c).alias(f"{c}_b") for c in names])
    pairs = a.join(b, [*key, "_bucket"]).where(
        (F.col(f"{identity}_a") < F.col(f"{identity}_b"))
        & (F.col(f"{start}_a") <= F.col(f"{end}_b"))
        & (F.col(f"{start}_b") <= F.col(f"{end}_a"))
    )
    overlap_start = F.greatest(f"{start}_a", f"{start}_b")
    return (
        pairs.where(time_slice(overlap_start, slice_days) == F.col("_bucket"))
        .withColumn("overlap_start", overlap_start)
        .withColumn("overlap_end", F.least(f"{end}_a", f"{end}_b"))
        .drop("_bucket")
    )


def count_over(df: DataFrame, keys: Sequence[str], out: str, condition: Column | None = None) -> DataFrame:
    """Partition count (or conditional count) on every row, without a window."""
    counted = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return with_group_values(df, keys, counted.alias(out))


def distinct_over(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Partition count of distinct values on every row."""
    return with_group_values(df, keys, F.count_distinct(F.col(column)).alias(out))


def row_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Values of the previous row of the same key (plain ``lag``)."""
    return neighbours(df, keys, order, columns)
