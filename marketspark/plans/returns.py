"""Daily returns: split-normalised basis, gap-safe returns, quarantine, segmented index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import is_true, not_true, status_case
from marketspark.operators.joins import prev_session_join
from marketspark.operators.timeline import Fold, scan

CONFIRMED = "vendor_confirms_extreme_after_adjustment"


def return_basis(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices with their split factor and the close on the first share basis (TB-39)."""
    f = factors.select(
        "security_id", "date", "daily_split_ratio", "cumulative_split_multiplier", "cumulative_log_split_multiplier"
    )
    joined = prices.withColumnRenamed("research_eligible", "price_research_eligible").join(f, ["security_id", "date"])
    return joined.withColumn("split_normalized_close", F.col("close") * F.col("cumulative_split_multiplier"))


def dividends_by_date(events: DataFrame) -> DataFrame:
    """Distributions per security and effective day, with a flag for unresolved ones."""
    paid = F.when(F.col("research_eligible"), F.coalesce("dividend_previous_share_basis", F.lit(0.0))).otherwise(0.0)
    return (
        events.where(F.col("effective_dividend_ex_date").isNotNull())
        .groupBy("security_id", F.col("effective_dividend_ex_date").alias("date"))
        .agg(
            F.sum(paid).alias("dividend_previous_share_basis"),
            F.bool_or(~F.col("research_eligible") & (F.col("raw_dividend_amount") > 0)).alias(
                "has_unresolved_positive_distribution"
            ),
            F.count(F.lit(1)).alias("dividend_source_rows"),
            F.count_if("research_eligible").alias("eligible_dividend_rows"),
        )
    )


def daily_return(calendar: DataFrame, dividend_events: DataFrame, basis: DataFrame) -> DataFrame:
    """Price and gross total return against the previous session, with a status (TB-40).

    A missing previous session gives no return, and a positive distribution that
    could not be resolved blanks the whole day.
    """
    previous = {
        "previous_close": "close",
        "previous_cumulative_split_multiplier": "cumulative_split_multiplier",
        "previous_split_normalized_close": "split_normalized_close",
        "_previous_eligible": "price_research_eligible",
    }
    joined = prev_session_join(basis, calendar, "security_id", "date", previous).join(
        dividends_by_date(dividend_events), ["security_id", "date"], "left"
    )
    zero = F.lit(0.0)
    joined = joined.withColumns({
        "dividend_previous_share_basis": F.coalesce("dividend_previous_share_basis", zero),
        "dividend_source_rows": F.coalesce("dividend_source_rows", F.lit(0).cast("long")),
        "eligible_dividend_rows": F.coalesce("eligible_dividend_rows", F.lit(0).cast("long")),
    }).withColumn(
        "split_normalized_dividend",
        F.col("dividend_previous_share_basis") * F.col("previous_cumulative_split_multiplier"),
    )
    base = F.col("previous_split_normalized_close")
    status = status_case(
        [
            (~F.col("price_research_eligible"), "current_price_not_research_eligible"),
            (F.col("previous_date").isNull(), "no_previous_market_session"),
            (base.isNull(), "missing_previous_price"),
            (not_true("_previous_eligible"), "previous_price_not_research_eligible"),
            (is_true("has_unresolved_positive_distribution"), "unresolved_positive_distribution"),
            (base <= 0, "invalid_previous_price"),
        ],
        "eligible",
    )
    good = F.col("return_status") == "eligible"
    value = F.col("split_normalized_close")
    return joined.withColumn("return_status", status).withColumns({
        "price_return": F.when(good, value / base - 1.0),
        "gross_total_return": F.when(good, (value + F.col("split_normalized_dividend")) / base - 1.0),
        "research_eligible": good,
    }).drop("_previous_eligible", "has_unresolved_positive_distribution", "price_research_eligible")


def research_return(returns: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Quarantine of returns that cannot be compounded or are extreme and unconfirmed (TB-47)."""
    d = diagnostics.select("security_id", "date", "diagnostic_class", "price_level_diagnostic")
    joined = returns.join(d, ["security_id", "date"], "left")
    label = F.coalesce("diagnostic_class", F.lit("unclassified_extreme_return"))
    r = F.col("gross_total_return")
    reason = (
        F.when(~F.col("research_eligible"), F.concat(F.lit("base_return_not_eligible:"), "return_status"))
        .when(r.isNull(), "null_gross_total_return")
        .when(r <= -1.0, "nonpositive_wealth_factor")
        .when((F.abs(r) > 1.0) & (label != CONFIRMED), F.concat(F.lit("extreme_return:"), label))
    )
    return joined.withColumn("research_quarantine_reason", reason).withColumn(
        "final_research_eligible", F.col("research_quarantine_reason").isNull()
    )


def segment_index(
    df: DataFrame, key: str, date: str, ret: str, eligible: str, segment: str, log_level: str, level: str
) -> DataFrame:
    """Compounded level within segments; an ineligible row starts a segment and has no level."""
    broken, growth = ~F.col(eligible), F.when(F.col(eligible), F.ln(F.lit(1.0) + F.col(ret)))
    levels = scan(df, [key], [date], {
        segment: Fold("sum", F.when(broken, 1).otherwise(0).cast("long")), log_level: Fold("sum", growth, since=broken)})
    return levels.withColumn(log_level, F.when(F.col(eligible), F.col(log_level))).withColumn(level, F.exp(log_level))


def total_return_index(research: DataFrame) -> DataFrame:
    """Segmented gross total return index (TB-48)."""
    indexed = segment_index(
        research, "security_id", "date", "gross_total_return", "final_research_eligible",
        "return_segment_id", "cumulative_gtr_log", "gross_total_return_index",
    )
    return indexed.select(
        "security_id", "ticker", "date", "gross_total_return", "final_research_eligible",
        "research_quarantine_reason", "diagnostic_class", "return_segment_id", "cumulative_gtr_log",
        "gross_total_return_index",
    )
