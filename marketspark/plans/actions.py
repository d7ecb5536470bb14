"""Splits, dividends, extreme returns and the corrections derived from them.

Corrections are inputs of a pass over the prices and are produced by a separate
pass, as they would otherwise depend on their own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import is_true, ratio_matches, safe_div, status_case
from marketspark.operators.joins import (
    band_join, count_over, interval_join, left_rest, nearest_interval, next_within, prev_session_join,
)
from marketspark.operators.mutate import resolve_seed, upsert
from marketspark.operators.ranking import ranked_rows
from marketspark.operators.selection import best_match, latest_per_key
from marketspark.operators.timeline import cumulative_factor, neighbours, running
from marketspark.plans.returns import dividends_by_date


def _with_previous(prices: DataFrame, key: str) -> DataFrame:
    return neighbours(
        prices.select(key, "date", "close"), [key], ["date"],
        {"previous_trading_date": "date", "previous_close": "close"},
    )


def _implied_return(ratio: str):
    return safe_div(F.col("event_close") * F.col(ratio), "previous_close") - 1


def split_audit(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Stated splits against the price move on their date, with near copies counted (TB-26)."""
    base = splits.withColumn("stated_ratio", safe_div("to_factor", "for_factor"))
    daily = base.where("stated_ratio IS NOT NULL").groupBy("act_symbol", "stated_ratio", "ex_date").agg(F.count(F.lit(1)).alias("_k"))
    # counts per day meet, not rows: at most 61 days lie in a band
    other = daily.select("act_symbol", "stated_ratio", F.col("ex_date").alias("_other"), F.col("_k").alias("_more"))
    near = (
        band_join(daily, other, ["act_symbol", "stated_ratio"], "ex_date", "_other", 30, 30)
        .groupBy("act_symbol", "stated_ratio", "ex_date")
        .agg((F.max("_k") * F.sum("_more") - 1).alias("nearby_same_ratio_count"))
    )
    event = _with_previous(prices, "act_symbol").withColumnsRenamed({"date": "ex_date", "close": "event_close"})
    joined = base.join(event, ["act_symbol", "ex_date"], "left").join(near, ["act_symbol", "stated_ratio", "ex_date"], "left")
    implied = _implied_return("stated_ratio")
    copies = F.coalesce("nearby_same_ratio_count", F.lit(0).cast("long"))
    return joined.select(
        "act_symbol", F.col("ex_date").alias("source_ex_date"), "to_factor", "for_factor", "stated_ratio",
        "previous_trading_date", "previous_close", "event_close",
        safe_div("event_close", "previous_close").alias("raw_price_ratio"), implied.alias("implied_return"),
        F.col("event_close").isNotNull().alias("has_price_on_ex_date"), copies.alias("nearby_same_ratio_count"),
        (F.col("event_close").isNull() | is_true(F.abs(implied) > 0.5) | (copies > 0)).alias("suspicious_flag"),
    )


def split_price_check(prices: DataFrame, splits: DataFrame, key: str = "act_symbol") -> DataFrame:
    """Stated ratio next to the raw price ratio and the return it implies (DQ-12)."""
    event = _with_previous(prices, key).withColumnsRenamed({"date": "ex_date", "close": "event_close"})
    joined = splits.withColumn("stated_ratio", safe_div("to_factor", "for_factor")).join(event, [key, "ex_date"], "left")
    return joined.withColumn("raw_price_ratio", safe_div("event_close", "previous_close")).withColumn(
        "implied_return", _implied_return("stated_ratio"))


def shifted_split_check(audit: DataFrame, prices: DataFrame) -> DataFrame:
    """Splits without a bar on their date against the next bar within a week (DQ-12)."""
    missing = audit.where("NOT has_price_on_ex_date").select("act_symbol", "source_ex_date", "stated_ratio").distinct()
    dated = next_within(
        missing, prices.select("act_symbol", "date"), ["act_symbol"], "source_ex_date", "date", 7, "candidate_trading_date")
    event = _with_previous(prices, "act_symbol").withColumnsRenamed({"date": "candidate_trading_date", "close": "event_close"})
    joined = dated.join(event, ["act_symbol", "candidate_trading_date"])
    return joined.withColumn("implied_return", _implied_return("stated_ratio")).withColumn(
        "calendar_days_shift", F.datediff("candidate_trading_date", "source_ex_date"))


def split_candidates(audit: DataFrame, episodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Number the audited splits and map each to its episode, or the nearest one (TB-27)."""
    order = ["act_symbol", "source_ex_date", "to_factor", "for_factor", "previous_trading_date", "event_close"]
    rows = ranked_rows(audit, [], [F.col(c).asc_nulls_last() for c in order], "source_split_row_id", "_all").drop("_all")
    spans = episodes.select("act_symbol", "ticker_episode_id", "start_date", "end_date")
    day = F.col("source_ex_date")
    best = nearest_interval(rows, spans, ["act_symbol"], "source_ex_date", "start_date", "end_date", "ticker_episode_id", "episode_distance_days").withColumnRenamed(
        "ticker_episode_id", "candidate_ticker_episode_id")
    distance = F.col("episode_distance_days")
    mapped = rows.join(best, ["act_symbol", "source_ex_date"], "left").withColumn("episode_mapping_method", status_case(
        [
            (F.col("candidate_ticker_episode_id").isNull(), "unresolved_no_episode"),
            (distance == 0, "exact_episode_date"),
            (distance <= 7, "nearest_episode_within_7d"),
            (distance <= 30, "nearest_episode_8_30d"),
        ],
        "unresolved_distance_gt_30d"))
    owners = membership.select(F.col("ticker_episode_id").alias("candidate_ticker_episode_id"), F.col("security_id").alias("_owner"))
    joined = mapped.join(owners, "candidate_ticker_episode_id", "left")
    exact = F.col("episode_mapping_method") == "exact_episode_date"
    good = ~F.col("suspicious_flag") & exact
    secure = F.col("episode_mapping_method").isin("exact_episode_date", "nearest_episode_within_7d")
    return joined.withColumns({
        "security_id": F.when(secure, F.col("_owner")),
        "nearby_same_ratio_duplicate": F.col("nearby_same_ratio_count") > 0,
        "large_implied_return": is_true(F.abs("implied_return") > 0.5),
        "validation_status": F.when(good, "provisionally_accepted").otherwise("requires_reconciliation"),
        "validated_ex_date": F.when(good, day),
        "validated_ratio": F.when(good, F.col("stated_ratio")),
        "validation_source": F.when(good, "primary_split_audit"),
    }).withColumnRenamed("act_symbol", "ticker").drop("_owner")


_PROVIDER = {
    "observation_id": "provider_observation_id", "split_date": "provider_split_date", "split_ratio": "provider_split_ratio",
    "to_factor": "provider_to_factor", "for_factor": "provider_for_factor",
}


def _compare_with_provider(candidates: DataFrame, provider: DataFrame, counts: bool) -> DataFrame:
    events = provider.select("provider_symbol", *[F.col(c).alias(n) for c, n in _PROVIDER.items()])
    slim = candidates.select(
        "source_split_row_id", "source_ex_date", "stated_ratio", F.concat("ticker", F.lit(".US")).alias("provider_symbol"))
    pairs = band_join(slim, events, ["provider_symbol"], "source_ex_date", "provider_split_date", 45, 45).withColumns({
        "date_distance_days": F.abs(F.datediff("source_ex_date", "provider_split_date")),
        "ratio_difference": F.abs(F.col("stated_ratio") - F.col("provider_split_ratio")),
        "ratio_matches": is_true(ratio_matches("stated_ratio", "provider_split_ratio")),
        "date_matches": F.col("source_ex_date") == F.col("provider_split_date"),
    })
    date, ratio = F.col("date_matches"), F.col("ratio_matches")
    quality = F.when(date & ratio, 1).when(ratio, 2).when(date, 3).otherwise(4)
    if counts:
        pairs = count_over(pairs, ["source_split_row_id"], "provider_candidates_within_45d")
        pairs = count_over(pairs, ["source_split_row_id"], "same_ratio_candidates_within_45d", F.col("ratio_matches"))
    best = best_match(pairs, ["source_split_row_id"], [
        quality, "date_distance_days", F.col("ratio_difference").asc_nulls_last(), "provider_split_date", "provider_observation_id"
    ]).drop("source_ex_date", "stated_ratio", "provider_symbol")
    joined = candidates.join(best, "source_split_row_id", "left")
    joined = joined.withColumns({"date_matches": is_true("date_matches"), "ratio_matches": is_true("ratio_matches")})
    return joined.withColumn("comparison_status", status_case(
        [
            (F.col("provider_observation_id").isNull(), "no_provider_match_within_45d"),
            (date & ratio, "exact_date_exact_ratio"),
            (ratio, "nearby_date_exact_ratio"),
            (date, "exact_date_ratio_conflict"),
        ],
        "nearby_date_ratio_conflict"))


def split_external_comparison(candidates: DataFrame, provider: DataFrame) -> DataFrame:
    """Splits still in doubt against a provider's events within 45 days (TB-28)."""
    open_ = candidates.where("validation_status = 'requires_reconciliation'")
    compared = _compare_with_provider(open_, provider, counts=True)
    zero = F.lit(0).cast("long")
    names = ("provider_candidates_within_45d", "same_ratio_candidates_within_45d")
    return compared.withColumns({c: F.coalesce(c, zero) for c in names}).select(
        "source_split_row_id", "security_id", "candidate_ticker_episode_id", "episode_mapping_method", "episode_distance_days",
        "ticker", "source_ex_date", "stated_ratio", "has_price_on_ex_date", "nearby_same_ratio_duplicate", "large_implied_return",
        *_PROVIDER.values(), "date_distance_days", "ratio_difference", "date_matches", "ratio_matches", *names, "comparison_status",
    )


def split_full_history_comparison(candidates: DataFrame, provider: DataFrame) -> DataFrame:
    """Every split candidate against a provider's full history (TB-29)."""
    return _compare_with_provider(candidates, provider, counts=False)


def split_reconciliation_enriched(
    comparison: DataFrame, resolutions: DataFrame, episodes: DataFrame, membership: DataFrame
) -> DataFrame:
    """Complete the security of a compared split from a resolved provider identity (TB-30)."""
    known = resolutions.select(
        "ticker", F.col("relevant_date").alias("provider_split_date"), F.col("resolution_status").alias("provider_identity_status"),
        "resolved_provider_symbol", F.col("resolution_method").alias("provider_identity_method"))
    spans = episodes.select(F.col("act_symbol").alias("ticker"), "ticker_episode_id", "start_date", "end_date").join(
        membership.select("ticker_episode_id", F.col("security_id").alias("_owner")), "ticker_episode_id", "left")
    dated = comparison.where("provider_split_date IS NOT NULL").select("source_split_row_id", "ticker", "provider_split_date")
    owner = interval_join(dated, spans, ["ticker"], "provider_split_date", "start_date", "end_date").select("source_split_row_id", "_owner")
    joined = comparison.join(known, ["ticker", "provider_split_date"], "left").join(owner, "source_split_row_id", "left")
    resolved = F.col("provider_identity_status") == "resolved"
    return joined.withColumns({
        "resolved_security_id": F.when(F.col("security_id").isNotNull(), F.col("security_id")).when(resolved, F.col("_owner")),
        "security_resolution_method": status_case(
            [
                (F.col("security_id").isNotNull(), "existing_security_mapping"),
                (resolved & F.col("_owner").isNotNull(), "provider_identity_resolution"),
                (F.col("provider_identity_status") == "unresolved", "provider_identity_ambiguous"),
            ],
            "unresolved"),
    }).drop("_owner")


def split_events(comparison: DataFrame) -> DataFrame:
    """One event per security and day: provider-confirmed first, then unmatched primary ones (TB-31)."""
    date, ratio = F.col("date_matches"), F.col("ratio_matches")
    secure = comparison.where(F.col("provider_observation_id").isNotNull() & F.col("security_id").isNotNull() & (date | ratio))
    groups = secure.groupBy("provider_observation_id").agg(
        F.count_distinct("security_id").alias("_owners"),
        *[F.min(c).alias(n) for c, n in (
            ("security_id", "security_id"), ("ticker", "ticker"), ("provider_split_date", "split_date"),
            ("provider_split_ratio", "split_ratio"), ("provider_to_factor", "to_factor"), ("provider_for_factor", "for_factor"))],
        F.count(F.lit(1)).alias("source_row_count"), F.bool_or(date).alias("_date"), F.bool_or(ratio).alias("_ratio"),
        F.bool_or(date & ratio).alias("_exact"), F.bool_or(date & ~ratio).alias("_restated"),
    ).where("_owners = 1")
    many = F.col("source_row_count") > 1
    confirmed = groups.withColumns({
        "validation_source": F.lit("vendor"),
        "validation_method": status_case(
            [
                (many & F.col("_exact"), "vendor_duplicate_collapse"),
                (many & F.col("_ratio") & ~F.col("_date"), "vendor_date_correction_duplicate_collapse"),
                (F.col("_restated"), "vendor_ratio_correction"),
                (F.col("_exact"), "vendor_exact_confirmation"),
                (F.col("_ratio"), "vendor_date_correction"),
            ],
            "vendor_validated"),
    })
    own = comparison.where(
        "validation_status = 'provisionally_accepted' AND security_id IS NOT NULL AND stated_ratio > 0 "
        "AND comparison_status = 'no_provider_match_within_45d'"
    ).select(
        "security_id", "ticker", F.col("source_ex_date").alias("split_date"), F.col("stated_ratio").alias("split_ratio"),
        "to_factor", "for_factor", F.lit("primary").alias("validation_source"),
        F.lit("primary_provisional_no_vendor_match").alias("validation_method"),
        F.lit(None).cast("string").alias("provider_observation_id"), F.lit(1).cast("long").alias("source_row_count"))
    rows = confirmed.select(*own.columns).unionByName(own)
    first = F.when(F.col("validation_source") == "vendor", 1).otherwise(2)
    return best_match(rows, ["security_id", "split_date"], [first, F.col("provider_observation_id").asc_nulls_last()])


def split_factor(prices: DataFrame, events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Daily ratio and cumulative multiplier per priced day; overrides replace ratios (TB-32)."""
    manual = overrides.select("security_id", F.col("event_date").alias("date"), "override_split_ratio", F.lit(True).alias("_manual"))
    stated = events.select("security_id", F.col("split_date").alias("date"), "split_ratio").join(manual, ["security_id", "date"], "left")
    ratio = F.when(is_true("_manual"), F.col("override_split_ratio")).otherwise(F.col("split_ratio"))
    effective = stated.select("security_id", "date", ratio.alias("_ratio"), F.lit(False).alias("_priced")).where("_ratio > 0")
    days = prices.select("security_id", "date", F.lit(None).cast("double").alias("_ratio"), F.lit(True).alias("_priced"))
    daily = days.unionByName(effective).groupBy("security_id", "date").agg(
        F.coalesce(F.max("_ratio"), F.lit(1.0)).alias("daily_split_ratio"), F.bool_or("_priced").alias("_priced"))
    factors = cumulative_factor(
        daily, ["security_id"], ["date"], F.col("daily_split_ratio"), "cumulative_split_multiplier", "cumulative_log_split_multiplier")
    return factors.where("_priced").drop("_priced")


def split_factor_reconciled(factors: DataFrame, backfills: DataFrame) -> DataFrame:
    """Factors with validated missing splits multiplied in (TB-33)."""
    extra = backfills.select("security_id", F.col("split_date").alias("date"), F.col("split_ratio").alias("automatic_backfill_ratio"))
    joined = factors.join(extra, ["security_id", "date"], "left").withColumn(
        "automatic_backfill_ratio", F.coalesce("automatic_backfill_ratio", F.lit(1.0)))
    logs = running(joined, ["security_id"], ["date"], {"_log": ("sum", F.ln("automatic_backfill_ratio"))})
    return logs.select(
        "security_id", "date", (F.col("daily_split_ratio") * F.col("automatic_backfill_ratio")).alias("daily_split_ratio"),
        (F.col("cumulative_split_multiplier") * F.exp("_log")).alias("cumulative_split_multiplier"),
        (F.col("cumulative_log_split_multiplier") + F.col("_log")).alias("cumulative_log_split_multiplier"),
        F.col("daily_split_ratio").alias("original_daily_split_ratio"),
        F.col("cumulative_split_multiplier").alias("original_cumulative_split_multiplier"), "automatic_backfill_ratio",
        (F.col("automatic_backfill_ratio") != 1.0).alias("has_automatic_split_backfill"),
    )


def corporate_action_overrides(
    existing: DataFrame, seed: DataFrame, episodes: DataFrame, membership: DataFrame
) -> DataFrame:
    """Resolve curated events to current securities, each exactly once, and upsert them (TB-34)."""
    spans = episodes.select(F.col("act_symbol").alias("ticker"), "ticker_episode_id", "start_date", "end_date").join(
        membership.select("ticker_episode_id", "security_id"), "ticker_episode_id").drop("ticker_episode_id")
    resolved = resolve_seed(seed, spans, "ticker", "event_date", "start_date", "end_date", "security_id")
    one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*resolved.columns))).otherwise(
        F.raise_error(F.lit("duplicate security and date in the override seed")))
    unique = resolved.groupBy(F.col("security_id").alias("_s"), F.col("event_date").alias("_d")).agg(one.alias("row")).select("row.*")
    return upsert(existing, unique, ["security_id", "event_date"])


def dividend_candidates(
    calendar: DataFrame, dividends: DataFrame, episodes: DataFrame, membership: DataFrame, prices: DataFrame
) -> DataFrame:
    """Dividends on eligible bars with their yield on the previous close (TB-35)."""
    spans = episodes.select("act_symbol", "ticker_episode_id", "start_date", "end_date").join(
        membership.select("ticker_episode_id", "security_id"), "ticker_episode_id")
    mapped = interval_join(dividends, spans, ["act_symbol"], "ex_date", "start_date", "end_date")
    good = prices.where("research_eligible").select("security_id", "date", "close")
    dated = prev_session_join(good, calendar, "security_id", "date", {"previous_close": "close"}, "inner").select(
        "security_id", F.col("date").alias("ex_date"), F.col("previous_date").alias("previous_session"), "previous_close")
    amount = F.col("amount").cast("double")
    indicated = safe_div(amount, "previous_close")
    return mapped.join(dated, ["security_id", "ex_date"]).select(
        "security_id", "ticker_episode_id", F.col("act_symbol").alias("ticker"), "ex_date", amount.alias("amount"),
        "previous_session", "previous_close", indicated.alias("raw_indicated_dividend_yield"),
        status_case([(amount == 0, "zero_source_artifact"), (indicated > 0.25, "requires_reconciliation")],
                    "provisionally_accepted").alias("validation_status"),
    )


def same_day_split_dividends(
    calendar: DataFrame, candidates: DataFrame, events: DataFrame, prices: DataFrame, factors: DataFrame
) -> DataFrame:
    """Dividends on a split day, read on both share bases (TB-36)."""
    bars = prices.where("research_eligible").select("security_id", "date", F.col("close").alias("event_close")).join(
        factors.select("security_id", "date", F.col("cumulative_split_multiplier").alias("event_split_multiplier")), ["security_id", "date"])
    dated = prev_session_join(bars, calendar, "security_id", "date", {
        "previous_close": "event_close", "previous_split_multiplier": "event_split_multiplier"}, "inner")
    splits = events.select(
        "security_id", F.col("split_date").alias("ex_date"), "split_ratio", "to_factor", "for_factor",
        F.col("validation_source").alias("split_validation_source"), F.col("validation_method").alias("split_validation_method"))
    rows = candidates.select("security_id", "ticker", "ex_date", F.col("amount").alias("raw_dividend_amount")).join(
        splits, ["security_id", "ex_date"]).join(
        dated.withColumnRenamed("date", "ex_date").drop("previous_date"), ["security_id", "ex_date"])
    post = F.col("raw_dividend_amount") * F.col("split_ratio")
    return rows.withColumns({
        "dividend_prev_basis_if_post_split_quote": post,
        "yield_if_pre_split_quote": safe_div("raw_dividend_amount", "previous_close"),
        "yield_if_post_split_quote": safe_div(post, "previous_close"),
        "dividend_share_basis": F.lit("unresolved"), "event_order": F.lit("unresolved"),
    })


def dividend_events(
    candidates: DataFrame, factors: DataFrame, calendar: DataFrame, overrides: DataFrame, corrections: DataFrame
) -> DataFrame:
    """Dividends on the previous share basis, with the rule that resolved them (TB-37)."""
    days = prev_session_join(
        factors.select("security_id", "date", "daily_split_ratio", "cumulative_split_multiplier"), calendar, "security_id", "date",
        {"_previous_multiplier": "cumulative_split_multiplier"}, "inner",
    ).select("security_id", F.col("date").alias("ex_date"), "daily_split_ratio")
    manual = overrides.select(
        "security_id", F.col("event_date").alias("ex_date"), "corporate_action_type", "dividend_share_basis", "override_split_ratio",
        "override_dividend_amount", "override_dividend_ex_date", "resolution_source", "source_reference", "resolution_notes")
    fixed = corrections.select("security_id", F.col("event_date").alias("ex_date"), "corrected_dividend_amount")
    base = (
        candidates.select("security_id", "ticker", "ex_date", F.col("amount").alias("raw_dividend_amount"),
                          F.col("validation_status").alias("source_validation_status"))
        .join(days, ["security_id", "ex_date"]).join(manual, ["security_id", "ex_date"], "left").join(fixed, ["security_id", "ex_date"], "left")
    )
    kind, basis = F.col("corporate_action_type"), F.col("dividend_share_basis")
    amount = F.coalesce("override_dividend_amount", "raw_dividend_amount")
    whole = kind == "composite_cash_and_in_kind_distribution"
    stock, pre, post = kind == "stock_dividend", basis == "pre_split", basis == "post_split"
    plain = F.col("daily_split_ratio") == 1.0
    value = (
        F.when(whole, None).when(stock, 0.0).when(pre, amount)
        .when(post, amount * F.coalesce("override_split_ratio", "daily_split_ratio"))
        .when(plain, F.coalesce("corrected_dividend_amount", "raw_dividend_amount"))
    )
    method = status_case(
        [
            (whole, "unresolved_composite_distribution"), (stock, "manual_stock_dividend_only"), (pre, "manual_pre_split_basis"),
            (post, "manual_post_split_basis"), (plain, "standard_cash_dividend"),
        ],
        "unresolved_same_day_split_basis")
    paid = (F.col("raw_dividend_amount") > 0) | is_true(stock)
    return base.withColumn("dividend_previous_share_basis", value).select(
        "security_id", "ticker", "ex_date", F.coalesce("override_dividend_ex_date", "ex_date").alias("effective_dividend_ex_date"),
        "raw_dividend_amount", amount.alias("effective_dividend_amount"), "dividend_previous_share_basis", "daily_split_ratio",
        "corporate_action_type", "dividend_share_basis", method.alias("dividend_resolution_method"), "source_validation_status",
        "resolution_source", "source_reference", "resolution_notes",
        is_true(F.col("dividend_previous_share_basis").isNotNull() & paid).alias("research_eligible"),
    )


def dividend_corrections(validation: DataFrame, provider: str = "vendor") -> DataFrame:
    """Retrospectively adjusted amounts replaced by the provider's unadjusted ones (TB-38)."""
    rows = validation.where("validation_status = 'retrospective_adjustment_correction'")
    return rows.select(
        "security_id", "ticker", F.col("effective_dividend_ex_date").alias("event_date"),
        F.col("dividend_previous_share_basis").alias("original_dividend_amount"),
        F.col("vendor_unadjusted").alias("corrected_dividend_amount"), "vendor_adjusted",
        safe_div("dividend_previous_share_basis", "vendor_unadjusted").alias("retrospective_adjustment_factor"),
        F.lit(provider).alias("provider"), F.lit("retrospective_adjustment_correction").alias("resolution_method"),
    )


def _growth(now: str, before: str):
    return F.when(F.col(before) > 0, F.col(now) / F.col(before) - 1.0)


def extreme_return_comparison(returns: DataFrame, requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Returns beyond 100 % next to a provider's prices on both days (TB-41)."""
    extreme = returns.where("research_eligible AND abs(gross_total_return) > 1.0").select(
        "security_id", "ticker", "date", "previous_date", F.col("previous_close").alias("primary_previous_close"),
        F.col("close").alias("primary_close"), F.col("price_return").alias("primary_price_return"),
        F.col("gross_total_return").alias("primary_gross_total_return"), "daily_split_ratio", "dividend_previous_share_basis",
        F.col("source").alias("primary_source"))
    asked = latest_per_key(requests, ["ticker"], ["retrieved_at"]).select(
        "ticker", "provider_symbol", F.col("status_code").alias("provider_request_status_code"),
        F.col("response_row_count").alias("provider_response_row_count"), F.col("error_text").alias("provider_request_error"))
    fields = ("open", "high", "low", "close", "adjusted_close", "volume")

    def seen(day: str, prefix: str) -> DataFrame:
        return observations.select(
            "provider_symbol", F.col("date").alias(day), F.col("date").alias(f"provider_{prefix}_date"),
            *[F.col(c).alias(f"provider_{prefix}_{c}") for c in fields])

    joined = (
        extreme.join(asked, "ticker", "left")
        .join(seen("previous_date", "previous"), ["provider_symbol", "previous_date"], "left")
        .join(seen("date", "current"), ["provider_symbol", "date"], "left")
    )
    joined = joined.withColumns({
        "provider_raw_return": _growth("provider_current_close", "provider_previous_close"),
        "provider_adjusted_return": _growth("provider_current_adjusted_close", "provider_previous_adjusted_close"),
        "provider_to_primary_previous_close_ratio": F.when(
            F.col("primary_previous_close") > 0, F.col("provider_previous_close") / F.col("primary_previous_close")),
        "provider_to_primary_current_close_ratio": F.when(
            F.col("primary_close") > 0, F.col("provider_current_close") / F.col("primary_close")),
    })
    code = F.col("provider_request_status_code")
    return joined.withColumns({
        "comparison_status": status_case(
            [
                (code.isNull(), "no_provider_request"), (code == 404, "provider_symbol_not_found"), (code != 200, "provider_request_failed"),
                (F.col("provider_previous_close").isNull() | F.col("provider_current_close").isNull(), "provider_price_pair_missing"),
                (F.abs("provider_raw_return") > 1.0, "provider_raw_also_extreme"),
            ],
            "provider_raw_not_extreme"),
        "raw_return_difference": F.col("primary_price_return") - F.col("provider_raw_return"),
        "adjusted_return_difference": F.col("primary_gross_total_return") - F.col("provider_adjusted_return"),
    })


def extreme_return_diagnostic(comparison: DataFrame) -> DataFrame:
    """Why a return is extreme, and whose price level is off (TB-42)."""
    unavailable = ("provider_symbol_not_found", "provider_price_pair_missing", "provider_request_failed", "no_provider_request")
    price, total = F.abs("primary_price_return"), F.abs("primary_gross_total_return")
    raw, adjusted = F.abs("provider_raw_return"), F.abs("provider_adjusted_return")
    before = F.col("provider_to_primary_previous_close_ratio").between(0.8, 1.25)
    now = F.col("provider_to_primary_current_close_ratio").between(0.8, 1.25)
    return comparison.withColumns({
        "diagnostic_class": status_case(
            [
                (F.col("comparison_status").isin(*unavailable), "provider_unavailable"),
                ((total > 1.0) & (price <= 1.0) & (raw <= 1.0), "dividend_or_distribution_anomaly"),
                ((price > 1.0) & (raw <= 1.0), "primary_price_disagreement"),
                ((raw > 1.0) & (adjusted <= 1.0), "corporate_action_candidate"),
                ((raw > 1.0) & (adjusted > 1.0), "vendor_confirms_extreme_after_adjustment"),
                ((raw > 1.0) & adjusted.isNull(), "vendor_raw_extreme_adjusted_missing"),
            ],
            "other"),
        "price_level_diagnostic": status_case(
            [
                (before.isNull() | now.isNull(), "not_comparable"), (before & now, "price_levels_agree"),
                (~before & now, "previous_primary_price_scale_mismatch"), (before & ~now, "current_primary_price_scale_mismatch"),
            ],
            "both_price_levels_differ"),
    })


def candidate_split_comparison(diagnostics: DataFrame, requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Nearest provider split within 45 days of a suspected corporate action (TB-43)."""
    names = ("security_id", "ticker", "date", "primary_price_return", "primary_gross_total_return", "provider_raw_return",
             "provider_adjusted_return", "daily_split_ratio", "dividend_previous_share_basis")
    rows = diagnostics.where("diagnostic_class = 'corporate_action_candidate'").select(*names)
    asked = latest_per_key(requests, ["ticker"], ["retrieved_at"]).select(
        "ticker", "provider_symbol", F.col("status_code").alias("provider_request_status_code"),
        F.col("response_row_count").alias("provider_response_row_count"), F.col("error_text").alias("provider_request_error"))
    known = rows.join(asked, "ticker", "left")
    splits = observations.select(
        "provider_symbol", F.col("ex_date").alias("provider_split_date"), F.col("split_ratio").alias("provider_split_ratio"))
    identity = ["security_id", "ticker", "date"]
    pairs = band_join(known, splits, ["provider_symbol"], "date", "provider_split_date", 45, 45).withColumn(
        "day_distance", F.abs(F.datediff("date", "provider_split_date")))
    best = best_match(pairs, identity, ["day_distance", "provider_split_date", "provider_split_ratio"])
    found = left_rest(known, best, identity)
    code, same_day = F.col("provider_request_status_code"), F.col("provider_split_date") == F.col("date")
    same = F.abs(F.col("provider_split_ratio") - F.col("daily_split_ratio")) < 1e-8
    return found.withColumn("split_comparison_status", status_case(
        [
            (code.isNull(), "no_provider_request"), (code == 404, "provider_symbol_not_found"), (code != 200, "provider_request_failed"),
            (F.col("provider_split_date").isNull(), "no_provider_split_within_45d"),
            (same_day & same, "exact_date_exact_ratio_already_present"), (same_day & ~same, "exact_date_ratio_conflict"),
            (~same_day & same, "nearby_date_exact_ratio"), (~same_day, "nearby_date_ratio_conflict"),
        ],
        "other"))


def split_backfill_validation(comparison: DataFrame) -> DataFrame:
    """Would the provider's split explain the provider's adjusted return to 1e-6? (TB-44)"""
    counterfactual = (1.0 + F.col("provider_raw_return")) * F.col("provider_split_ratio") - 1.0
    error = F.abs(counterfactual - F.col("provider_adjusted_return"))
    proven = (
        (F.col("split_comparison_status") == "exact_date_ratio_conflict")
        & (F.abs(F.col("daily_split_ratio") - 1.0) < 1e-12) & (error < 1e-6)
    )
    return comparison.withColumns({
        "counterfactual_return_with_provider_split": counterfactual, "adjusted_return_abs_error": error,
        "exact_date_missing_split_validated": is_true(proven),
    })


def automatic_split_backfill(validation: DataFrame, provider: str = "vendor") -> DataFrame:
    """Splits proven to be missing (TB-45)."""
    return validation.where("exact_date_missing_split_validated").select(
        "security_id", "ticker", F.col("date").alias("split_date"), F.col("provider_split_ratio").alias("split_ratio"),
        "provider_raw_return", "provider_adjusted_return", "counterfactual_return_with_provider_split", "adjusted_return_abs_error",
        F.lit(provider).alias("provider"), F.lit("extreme_return_exact_date_mechanical_validation").alias("resolution_method"))


def automatic_price_corrections(
    calendar: DataFrame, dividends: DataFrame, prices: DataFrame, factors: DataFrame, observations: DataFrame
) -> DataFrame:
    """Replace a bar when only one of two days disagrees with the provider (TB-46).

    The other day has to agree within 1 % and the wrong one to be off by over 10 %,
    on an extreme move that the provider does not see.
    """
    bars = prices.select("security_id", "ticker", "date", "close", "research_eligible").join(
        factors.select("security_id", "date", F.col("cumulative_split_multiplier").alias("factor")), ["security_id", "date"])
    pairs = prev_session_join(bars, calendar, "security_id", "date", {
        "previous_close": "close", "previous_factor": "factor", "_previous_eligible": "research_eligible"}, "inner")
    pairs = pairs.join(dividends_by_date(dividends), ["security_id", "date"], "left")
    pairs = pairs.where(
        F.col("research_eligible") & F.col("_previous_eligible") & ~is_true("has_unresolved_positive_distribution")
        & (F.col("previous_close") > 0))
    base = F.col("previous_close") * F.col("previous_factor")
    value = F.col("close") * F.col("factor")
    paid = F.coalesce("dividend_previous_share_basis", F.lit(0.0)) * F.col("previous_factor")
    pairs = pairs.where((F.abs(value / base - 1.0) > 1.0) & (F.abs((value + paid) / base - 1.0) > 1.0))
    seen = observations.select("ticker", "date", F.col("close").alias("_now"))
    before = observations.select("ticker", F.col("date").alias("previous_date"), F.col("close").alias("_before"))
    pairs = pairs.join(seen, ["ticker", "date"]).join(before, ["ticker", "previous_date"])
    pairs = pairs.where(F.abs(safe_div("_now", "_before") - 1.0) <= 1.0)
    wrong_now = F.abs(safe_div("_now", "close") - 1.0)
    wrong_before = F.abs(safe_div("_before", "previous_close") - 1.0)
    bad_before, bad_now = (wrong_now <= 0.01) & (wrong_before > 0.10), (wrong_before <= 0.01) & (wrong_now > 0.10)
    dates = pairs.where(bad_before | bad_now).select(
        "security_id", "ticker", F.when(bad_before, F.col("previous_date")).otherwise(F.col("date")).alias("correction_date"),
        F.when(bad_before, "bad_previous_good_current").otherwise("good_previous_bad_current").alias("correction_reason")).distinct()
    return dates.join(observations.withColumnRenamed("date", "correction_date"), ["ticker", "correction_date"]).withColumn(
        "resolution_method", F.lit("high_confidence_one_sided_vendor_match"))
