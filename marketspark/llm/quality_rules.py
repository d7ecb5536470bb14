"""Quality rules with thresholds that adapt to each language and source.

Every text gets word, symbol, line and repetition counts. Their rates go into mergeable
quantile sketches: counts per (language, source, rate, bucket), where a bucket keeps the
six leading bits of the rate (within 1/32 of it). Sketches add up, so a source with
fewer than ``MIN_ROWS`` texts uses the merged sketch of its language, and a language with
fewer that of the whole corpus. A rate is an outlier beyond three interquartile ranges
of its sketch (at least ``SPREADS``, for groups that hardly vary). Thresholds are joined
back to the texts; a text is kept if no rate is an outlier.

DataFrame functions only. A hot source costs no more than others: sketches combine
before the shuffle, and the join moves counts, not texts.

Defined cases: a null or empty text has no words and fails the base rules. Null
languages and sources form groups of their own. Repeated rows give equal rows. Without
texts that pass the base rules there are no thresholds and nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketspark.session import stage

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_ROWS = 50
#: Smallest interquartile range, in thousandths, of each rate.
SPREADS = {"symbols": 40, "dup_lines": 150, "repeats": 100, "word_length": 500, "capitals": 100}
LOW_SIDE = ("word_length",)  # rates that may also be too small
REACH = 3


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) of every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [id_col, *keep]
    split = docs.select(
        *names,
        F.filter(F.split(text, GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
    )
    windows = split.select(
        *names, "words", "n_symbols", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(
            F.transform(
                F.slice("words", F.lit(3), F.greatest(F.size("words") - 2, F.lit(0))),
                lambda w, i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), w).alias("h"), i.alias("at")),
            )
        ).alias("windows"),
    )
    twice = windows.select(
        *names, "n_symbols", "n_capitals", "n_lines", "n_dup_lines",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.sort_array(
            F.transform(
                F.filter("windows", lambda x, k: _same(k - 1, x) | _same(k + 1, x)),
                lambda x: x["at"],
            )
        ).alias("starts"),
    )
    # a window starting at p adds the words after the end of the one before it
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"],
    )
    return twice.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_capitals")


def _same(k: Column, window: Column) -> Column:
    return F.coalesce(F.get("windows", k)["h"] == window["h"], F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> list[Column]:
    """The rates in thousandths, as whole numbers."""
    per_word = "div greatest(n_words, 1)"
    return [
        F.expr(f"1000 * n_symbols {per_word}").alias("symbols"),
        F.expr("1000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_lines"),
        F.expr(f"1000 * n_repeat_words {per_word}").alias("repeats"),
        F.expr(f"1000 * word_chars {per_word}").alias("word_length"),
        F.expr("1000 * n_capitals div greatest(word_chars, 1)").alias("capitals"),
    ]


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, bucket, n): one mergeable quantile sketch per key and rate; ``n`` adds up."""
    entries = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in SPREADS])
    long = rows.select(*keys, F.inline(entries))
    bucket = F.expr("shiftleft(shiftright(value, greatest(length(bin(value)) - 6, 0)), greatest(length(bin(value)) - 6, 0))")
    return long.groupBy(*keys, "rate", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, low_*, high_*): quartiles of every sketch, widened to the fences of each rate."""
    ordered = W.partitionBy(*keys, "rate").orderBy("bucket")
    ranked = sketches.select(
        *keys, "rate", "bucket", F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(W.partitionBy(*keys, "rate")).alias("rows"),
    )
    quartiles = ranked.groupBy(*keys, "rate").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("bucket"))).alias("q3"),
    )
    columns = [F.max("rows").alias("rows")]
    for r, least in SPREADS.items():
        spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        columns += [F.max(F.when(F.col("rate") == r, F.col("q1") - spread)).alias(f"low_{r}"), F.max(F.when(F.col("rate") == r, F.col("q3") + spread)).alias(f"high_{r}")]
    return quartiles.groupBy(*keys).agg(*columns)


def thresholds(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, low_*, high_*): fences of each source, or of its language or the corpus where it has too few rows."""
    fine = stage(sketch(rows, ["lang", "source"]))
    by_source, by_lang, overall = fences(fine, ["lang", "source"]), fences(merged(fine, ["lang"]), ["lang"]), fences(merged(fine, []), [])
    sides = [f"{side}_{r}" for r in SPREADS for side in ("low", "high")]
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.struct("rows", *sides).alias("_by_lang"))
    corpus = overall.first() or dict.fromkeys(sides)  # one row of limits
    joined = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    return joined.select(
        "lang", "source",
        *[
            F.when(F.col("rows") >= min_rows, F.col(s)).when(F.col("_by_lang.rows") >= min_rows, F.col(f"_by_lang.{s}")).otherwise(F.lit(corpus[s])).alias(s)
            for s in sides
        ],
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_rows: int = MIN_ROWS) -> DataFrame:
    """(id, lang, source, counts, rates, base_failed, kept) of every row."""
    counts = stage(statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()))
    rows = counts.select("*", *rates())
    limits = thresholds(rows.where(~F.col("base_failed")), min_rows)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    inside = [F.col(r) <= F.col(f"high_{r}") for r in SPREADS] + [F.col(r) >= F.col(f"low_{r}") for r in LOW_SIDE]
    fits = inside[0]
    for test in inside[1:]:
        fits = fits & test
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return judged.select(*rows.columns, F.coalesce(~F.col("base_failed") & fits, F.lit(False)).alias("kept"))
