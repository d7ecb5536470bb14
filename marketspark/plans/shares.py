"""Point-in-time share counts, market caps, their guards and audits.

``vendor`` is the balance-sheet provider, ``snapshot`` the dated index archive and
``manual`` the curated, sourced counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import (
    alphanumeric, freshness, is_true, log_ratio, not_true, safe_div, scale_band, status_case, unit_unverified,
)
from marketspark.operators.joins import asof_join, band_join, count_over, distinct_over, has_event_between, latest_available_source, semi_join
from marketspark.operators.mutate import ensure_columns, update_from
from marketspark.operators.ranking import exact_quantile, hash_first_k, n_tiles
from marketspark.operators.selection import best_match, latest_per_key, peak_per_key, top_k
from marketspark.operators.sets import counted_rows, repeated_rows, union_sources
from marketspark.operators.timeline import neighbours
from marketspark.session import bounded_broadcast, stage
from marketspark.streaming.guard import classify_filings

# Fixed value: scales a median absolute deviation to a standard deviation.
NORMAL_QUARTILE = 0.67448975


def robust_z(df: DataFrame, keys: Sequence[str], x: str, floor: float, out: str) -> DataFrame:
    """Distance from the group median in robust deviations with a floor of ``ln(floor)`` (WN-21).

    Adds ``median_<x>`` and ``mad_<x>``.
    """
    medians = exact_quantile(df, keys, x, 0.5, f"median_{x}")
    centred = df.join(medians, list(keys), "left").withColumn("_off", F.abs(F.col(x) - F.col(f"median_{x}")))
    spreads = exact_quantile(centred, keys, "_off", 0.5, f"mad_{x}")
    scaled = centred.join(spreads, list(keys), "left")
    scale = F.greatest(F.coalesce(f"mad_{x}", F.lit(0.0)), F.ln(F.lit(float(floor))))
    return scaled.withColumn(out, NORMAL_QUARTILE * F.col("_off") / scale).drop("_off")


# --- observations and point-in-time counts ---------------------------------------------

def share_observations(filings: DataFrame, source: str = "vendor_balance_sheet") -> DataFrame:
    """Latest retrieval of each usable filing row (TB-56)."""
    usable = filings.where(
        "filing_date IS NOT NULL AND period_date IS NOT NULL AND shares_outstanding > 0")
    rows = latest_per_key(usable, ["ticker", "period_date", "filing_date"], ["retrieved_at"])
    return rows.where("period_date <= filing_date").withColumn("shares_source", F.lit(source))


def effective_shares(observations: DataFrame) -> DataFrame:
    """One row per ticker and filing date: the latest period filed that day (TB-56)."""
    return latest_per_key(observations, ["ticker", "filing_date"], ["period_date", "retrieved_at"])


def ticker_identity_diagnostic(resolution: DataFrame) -> DataFrame:
    """Tickers that several ISINs share (TB-56)."""
    rows = resolution.where("resolved_instrument_type = 'Common Stock'")
    return rows.groupBy("ticker").agg(
        F.count_distinct("security_id").alias("distinct_security_ids"), F.count_distinct("resolved_isin").alias("distinct_isins"),
        F.min("resolved_isin").alias("single_candidate_isin"),
    ).withColumn("ticker_identity_ambiguous", F.col("distinct_isins") > 1)


_FILED = {
    "provider_symbol": "provider_symbol", "shares_period_date": "period_date", "shares_filing_date": "filing_date",
    "shares_outstanding": "shares_outstanding", "shares_source": "shares_source",
}


def daily_pit_shares(universe: DataFrame, effective: DataFrame, identity: DataFrame) -> DataFrame:
    """Latest filed count per eligible security-day, with its age and availability (TB-57)."""
    days = universe.where("primary_research_eligible_exchange").select("security_id", "date", "ticker")
    pit = asof_join(days, effective, ["ticker"], "date", "filing_date", _FILED)
    pit = pit.withColumn("shares_age_days", F.datediff("date", "shares_filing_date"))
    known = identity.select("ticker", "distinct_security_ids", "distinct_isins", "ticker_identity_ambiguous")
    joined = pit.join(known, "ticker", "left")
    zero, ambiguous = F.lit(0).cast("long"), is_true("ticker_identity_ambiguous")
    return joined.withColumns({
        "ticker_security_id_count": F.coalesce("distinct_security_ids", zero), "ticker_isin_count": F.coalesce("distinct_isins", zero),
        "ticker_identity_ambiguous": ambiguous, "shares_freshness": freshness("shares_outstanding", "shares_age_days"),
        "shares_pit_available": is_true(F.col("shares_outstanding").isNotNull() & (F.col("shares_age_days") <= 365)) & ~ambiguous,
    }).drop("distinct_security_ids", "distinct_isins")


# --- dated index archive ---------------------------------------------------------------

def identity_candidates(extension: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Do the two archive files agree on code, name and ISIN of a dated constituent? (TB-59)"""
    key = ["observation_date", "security_code"]
    pair = F.concat_ws(":", F.coalesce("shares_today", F.lit(-1.0)), F.coalesce("closing_shares", F.lit(-1.0)))
    known = "observation_date IS NOT NULL AND security_code <> ''"

    def variants(prefix: str) -> list[Column]:
        return [
            F.min("security_name").alias(f"{prefix}_name"), F.min("issuer_code").alias(f"{prefix}_issuer_code"),
            F.min("timeseries_code").alias(f"{prefix}_timeseries_code"), F.count(F.lit(1)).alias(f"{prefix}_rows"),
            F.count_distinct("security_name").alias(f"{prefix}_name_variants"),
            F.count_distinct("issuer_code").alias(f"{prefix}_issuer_codes"),
            F.count_distinct("timeseries_code").alias(f"{prefix}_timeseries_codes"),
        ]

    e = extension.where(known).groupBy(*key).agg(
        *variants("extension"), F.min("shares_today").alias("shares_today"), F.min("closing_shares").alias("closing_shares"),
        F.count_distinct(pair).alias("share_variants"))
    valid = F.col("parse_status") == "valid_isin"
    r = identifiers.where(known).groupBy(*key).agg(
        *variants("identifier"), F.min(F.when(valid, F.col("isin"))).alias("isin"),
        F.count_distinct(F.when(valid, F.col("isin"))).alias("distinct_valid_isins"),
        F.count_if(F.col("parse_status") != "valid_isin").alias("invalid_isin_rows"))
    joined = e.join(r, key, "left").withColumn(
        "normalized_name_agreement", alphanumeric("extension_name") == alphanumeric("identifier_name"))
    single = ["share_variants"] + [f"{p}_{s}" for p in ("extension", "identifier") for s in ("name_variants", "issuer_codes", "timeseries_codes")]
    several = F.lit(False)
    for name in single:
        several = several | (F.col(name) != 1)
    differs = (F.col("extension_issuer_code") != F.col("identifier_issuer_code")) | (
        F.col("extension_timeseries_code") != F.col("identifier_timeseries_code"))
    return joined.withColumn("identity_status", status_case(
        [
            (F.col("identifier_rows").isNull(), "no_identifier_code_date"),
            ((F.col("distinct_valid_isins") != 1) | (F.col("invalid_isin_rows") > 0), "invalid_or_conflicting_isin"),
            (several, "conflicting_source_rows"), (differs, "source_code_disagreement"),
            (not_true("normalized_name_agreement"), "name_review"),
        ],
        "candidate_exact_code_name"))


def _priced_within_week(rows: DataFrame, universe: DataFrame, prices: DataFrame, matches: str) -> DataFrame:
    """Per ISIN and date of the rows the latest priced day of each security in the week before, and how many securities there are."""
    members = universe.where("primary_research_eligible_exchange AND isin IS NOT NULL").select(
        F.upper(F.trim("isin")).alias("isin"), "security_id", "ticker", F.col("date").alias("price_date"))
    bars = prices.where("close > 0").select("security_id", "ticker", F.col("date").alias("price_date"), F.col("close").alias("raw_close"))
    priced = members.join(bars, ["security_id", "ticker", "price_date"])
    asked = rows.select("isin", "observation_date").distinct()
    pairs = band_join(asked, priced, ["isin"], "observation_date", "price_date", 7, 0)
    # a row per ISIN, date and security: small next to the rows that meet it, and read several times
    found = stage(best_match(pairs, ["isin", "observation_date", "security_id"], [F.col("price_date").desc(), "ticker"]))
    return distinct_over(found, ["isin", "observation_date"], "security_id", matches)


def priced_overlap(identities: DataFrame, universe: DataFrame, prices: DataFrame, around_single: bool = False) -> DataFrame:
    """Constituents with a priced security in the week before, and how many match (TB-60).

    ``identities`` has one row per date and code. A code meets all securities of its ISIN; with
    ``around_single`` only the securities and dates are formed that some code matches alone.
    """
    rows = identities.where(F.col("identity_status").isin("candidate_exact_code_name", "name_review"))
    found = _priced_within_week(rows, universe, prices, "project_security_matches")
    if around_single:
        found = semi_join(found, found.where("project_security_matches = 1"), ["security_id", "observation_date"])
    return rows.join(found, ["isin", "observation_date"]).select(*rows.columns, *[c for c in found.columns if c not in ("isin", "observation_date")])


def _with_pit(rows: DataFrame, pit: DataFrame, factors: DataFrame) -> DataFrame:
    """Vendor count on the price date, and whether a split lies between its period and that date."""
    known = pit.select(
        "security_id", "ticker", F.col("date").alias("price_date"), F.col("shares_outstanding").alias("vendor_pit_shares"),
        F.col("shares_period_date").alias("vendor_shares_period_date"), F.col("shares_filing_date").alias("vendor_shares_filing_date"),
        F.col("shares_age_days").alias("vendor_shares_age_days"), F.col("shares_pit_available").alias("vendor_pit_available"),
        F.col("ticker_identity_ambiguous").alias("vendor_ticker_ambiguous"))
    joined = rows.join(known, ["security_id", "ticker", "price_date"], "left")
    splits = factors.where("abs(daily_split_ratio - 1.0) > 0.000001").select("security_id", F.col("date").alias("_split"))
    dated = has_event_between(joined, splits, "security_id", "vendor_shares_period_date", "price_date", "_split", "intervening_split")
    usable = (
        (F.col("identity_status") == "candidate_exact_code_name") & (F.col("project_security_matches") == 1)
        & is_true("vendor_pit_available") & not_true("vendor_ticker_ambiguous") & ~F.col("intervening_split")
        & (F.col("vendor_pit_shares") > 0))
    return dated.withColumn("comparable", is_true(usable))


def _to_vendor(shares: str, extra: Column | None = None) -> Column:
    good = F.col("comparable") & (F.col(shares) > 0)
    return F.when(good if extra is None else good & extra, safe_div(shares, "vendor_pit_shares"))


def share_discrepancies(overlap: DataFrame, pit: DataFrame, factors: DataFrame) -> DataFrame:
    """Archive counts relative to vendor counts as scale bands (TB-61)."""
    rows = _with_pit(overlap, pit, factors).withColumns({
        "today_to_vendor_ratio": _to_vendor("shares_today"), "closing_to_vendor_ratio": _to_vendor("closing_shares")})
    return rows.withColumns({
        "today_scale_band": scale_band("today_to_vendor_ratio"), "closing_scale_band": scale_band("closing_to_vendor_ratio")})


def share_overlap_audit(observations: DataFrame, overlap: DataFrame, pit: DataFrame, factors: DataFrame) -> DataFrame:
    """Share evidence of the identifier archive at matched securities (TB-62)."""
    key = ["observation_date", "security_code", "isin"]

    def positive(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    source = observations.where("observation_date IS NOT NULL").groupBy(*key).agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_distinct(positive("closing_shares")).alias("closing_share_variants"),
        F.count_distinct(positive("shares_today")).alias("today_share_variants"),
        F.min(positive("closing_shares")).alias("snapshot_closing_shares"), F.min(positive("shares_today")).alias("snapshot_shares_today"))
    base = overlap.select(*key, "security_id", "ticker", "price_date", "identity_status", "project_security_matches")
    rows = _with_pit(base.join(source, key, "left"), pit, factors)
    return rows.withColumns({
        "closing_to_vendor_ratio": _to_vendor("snapshot_closing_shares", F.col("closing_share_variants") == 1),
        "today_to_vendor_ratio": _to_vendor("snapshot_shares_today", F.col("today_share_variants") == 1)})


def share_overlap_summary(audit: DataFrame) -> DataFrame:
    """Fourteen coverage figures of the overlap audit in one row (TB-62)."""
    r = F.col("closing_to_vendor_ratio")
    counts = {
        "closing_share_rows": F.col("snapshot_closing_shares") > 0, "today_share_rows": F.col("snapshot_shares_today") > 0,
        "vendor_share_rows": (F.col("vendor_pit_shares") > 0) & is_true("vendor_pit_available"),
        "comparable_basis_rows": F.col("comparable"), "closing_ratios": r.isNotNull(),
        "today_ratios": F.col("today_to_vendor_ratio").isNotNull(), "closing_near_1000x_high": r.between(800, 1250),
        "closing_near_1000x_low": r.between(0.0008, 0.00125), "closing_near_million_high": r.between(800_000, 1_250_000),
        "closing_near_million_low": r.between(0.0000008, 0.00000125), "closing_near_1x": r.between(0.8, 1.25),
        "conflicting_closing_rows": F.col("closing_share_variants") > 1,
    }
    return audit.agg(
        F.count(F.lit(1)).alias("matched_snapshots"), F.count_distinct("security_id").alias("matched_issues"),
        *[F.count_if(c).alias(n) for n, c in counts.items()])


def implied_shares(caps: DataFrame, universe: DataFrame, prices: DataFrame) -> DataFrame:
    """Shares implied by an archived cap in millions and the latest price of the week (TB-63)."""
    key = ["source_sha256", "observation_date", "isin"]
    daily = caps.where("parse_status = 'valid_isin' AND mktcap_as_supplied > 0").groupBy(*key).agg(
        F.min("source_row_number").alias("source_row_number"), F.min("mktcap_as_supplied").alias("mktcap_as_supplied"),
        F.count(F.lit(1)).alias("source_rows"), F.count_distinct("mktcap_as_supplied").alias("distinct_cap_values"))
    found = _priced_within_week(daily, universe, prices, "matched_security_count")
    rows = daily.join(found, ["isin", "observation_date"]).select(*daily.columns, *[c for c in found.columns if c not in key])
    conflict, several = F.col("distinct_cap_values") > 1, F.col("matched_security_count") > 1
    return rows.withColumns({
        "price_lag_days": F.datediff("observation_date", "price_date"),
        "candidate_status": status_case(
            [(conflict, "conflicting_source_caps"), (several, "ambiguous_security_id")], "candidate_usd_millions_assumed"),
        "implied_shares_usd_millions_assumed": F.when(
            ~conflict & ~several, F.col("mktcap_as_supplied") * 1_000_000.0 / F.col("raw_close"))})


def implied_scale_audit(implied: DataFrame, pit: DataFrame) -> DataFrame:
    """Implied counts relative to vendor counts (TB-63)."""
    known = pit.select(
        "security_id", "ticker", F.col("date").alias("price_date"), F.col("shares_outstanding").alias("vendor_pit_shares"),
        F.col("shares_pit_available").alias("_available"), F.col("ticker_identity_ambiguous").alias("_ambiguous"))
    joined = implied.join(known, ["security_id", "ticker", "price_date"], "left")
    good = (
        (F.col("candidate_status") == "candidate_usd_millions_assumed") & is_true("_available") & not_true("_ambiguous")
        & (F.col("vendor_pit_shares") > 0))
    ratio = F.when(good, safe_div("implied_shares_usd_millions_assumed", "vendor_pit_shares"))
    return joined.withColumn("implied_to_vendor_ratio", ratio).withColumn(
        "scale_diagnostic", scale_band("implied_to_vendor_ratio")).drop("_available", "_ambiguous")


# --- daily market cap ------------------------------------------------------------------

def preferred_snapshots(families: dict[str, DataFrame], factors: DataFrame) -> DataFrame:
    """Unambiguous month-end counts of all archive families (TB-65)."""
    rows = union_sources(families, "family")
    rows = count_over(rows, ["security_id", "observation_date"], "_same")
    good = rows.where(
        "identity_status = 'candidate_exact_code_name' AND project_security_matches = 1 AND closing_share_variants = 1 "
        "AND snapshot_closing_shares > 0 AND _same = 1").drop("_same")
    anchors = factors.select(
        "security_id", F.col("date").alias("price_date"), F.col("cumulative_split_multiplier").alias("anchor_split_multiplier"))
    return good.join(anchors, ["security_id", "price_date"], "left")


def basis_calibration(snapshots: DataFrame, effective: DataFrame, factors: DataFrame) -> DataFrame:
    """Does the vendor restate counts for later splits? Evidence per security (TB-66)."""
    filed = asof_join(snapshots, effective, ["ticker"], "observation_date", "filing_date", {
        "vendor_shares": "shares_outstanding", "filing_date": "filing_date", "_retrieved": "retrieved_at"})
    overlap = asof_join(
        filed.withColumn("_retrieved", F.col("_retrieved").cast("date")), factors, ["security_id"], "_retrieved", "date",
        {"final_factor": "cumulative_split_multiplier"})
    evidence = overlap.where(
        (F.col("vendor_shares") > 0) & (F.col("snapshot_closing_shares") > 0) & (F.col("final_factor") > 0)
        & (F.col("anchor_split_multiplier") > 0) & F.datediff("observation_date", "filing_date").between(0, 365)
    ).select(
        "security_id", (F.col("vendor_shares") / F.col("snapshot_closing_shares")).alias("source"),
        (F.col("final_factor") / F.col("anchor_split_multiplier")).alias("split"))
    moved = (F.col("split") >= 1.5) | (F.col("split") <= 1.0 / 1.5)
    plain, restated = log_ratio("source", F.lit(1.0)), log_ratio("source", "split")
    near, far = F.ln(F.lit(1.25)), F.ln(F.lit(1.5))
    scored = evidence.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("comparable_snapshots"), F.count_if(moved & (restated <= near)).alias("retrospective_hits"),
        F.count_if(moved & (plain <= near)).alias("contemporaneous_hits"),
        F.count_if((plain > far) & (restated > far)).alias("conflicting_hits"))
    back, at_time, clash = F.col("retrospective_hits"), F.col("contemporaneous_hits"), F.col("conflicting_hits")
    return scored.withColumn("calibration_status", status_case(
        [
            ((back >= 2) & (at_time == 0) & (clash == 0), "retrospective_confirmed"),
            ((at_time >= 2) & (back == 0) & (clash == 0), "contemporaneous_confirmed"), (clash > 0, "cross_source_conflict"),
        ],
        "unverified"))


# Vendor counts on these bases may enter a market cap.
USABLE_BASES = ("retrospective_confirmed", "contemporaneous_confirmed", "no_later_recorded_split")


# Column of tables with a row for several equal ones: the number of rows it stands for.
TIMES = "row_times"


def _times(df: DataFrame) -> Column:
    return F.col(TIMES) if TIMES in df.columns else F.lit(1).cast("long")


def _rows(df: DataFrame, condition: Column | None = None) -> Column:
    """Number of rows (meeting a condition) of a group, equal rows counted as often as they occur."""
    if TIMES not in df.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return F.sum(_times(df) if condition is None else F.when(condition, _times(df)).otherwise(0))


def _total(df: DataFrame, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value * _times(df)) if TIMES in df.columns else F.sum(value)


def repeated(df: DataFrame) -> DataFrame:
    """A table with every row as often as it occurs."""
    return repeated_rows(df, TIMES) if TIMES in df.columns else df


def daily_market_cap(
    prices: DataFrame, effective: DataFrame, manual: DataFrame, identity: DataFrame, factors: DataFrame,
    calibration: DataFrame, resolution: DataFrame, pairs: DataFrame, snapshots: DataFrame,
) -> DataFrame:
    """Market cap per security-day from the best count in force that day (TB-67).

    An index snapshot comes first, then a sourced manual count, then a filing, each
    carried at most 365 days. A filed count is used only when its split basis is
    known, and its status says why not otherwise.
    """
    return repeated(counted_market_cap(prices, effective, manual, identity, factors, calibration, resolution, pairs, snapshots))


def counted_market_cap(
    prices: DataFrame, effective: DataFrame, manual: DataFrame, identity: DataFrame, factors: DataFrame,
    calibration: DataFrame, resolution: DataFrame, pairs: DataFrame, snapshots: DataFrame,
) -> DataFrame:
    """The rows of :func:`daily_market_cap`, equal sourced counts and names of a day as one row with their number (``row_times``).

    ``pairs`` holds pairs of securities of one issuer, or a row per security of such a pair.
    All functions below take this table as well as the plain one.
    """
    own, multiplier, filed_at = ["security_id"], "cumulative_split_multiplier", "shares_filing_date"
    rows = prices.select(
        "security_id", "date", "ticker", "close", F.col("source").alias("price_source"),
        F.col("research_eligible").alias("price_research_eligible"))
    # narrow lookups come first; what a filing says is attached to the days of each security at the end
    rows = rows.join(factors.select("security_id", "date", F.col(multiplier).alias("current_split_multiplier")), ["security_id", "date"], "left")
    rows = asof_join(rows, effective, ["ticker"], "date", "filing_date", {filed_at: "filing_date"})
    rows = stage(asof_join(rows, snapshots, own, "date", "observation_date", {
        "family": "family", "snapshot_date": "observation_date", "snapshot_anchor_price_date": "price_date",
        "snapshot_security_code": "security_code", "isin": "isin", "snapshot_shares": "snapshot_closing_shares",
        "anchor_split_multiplier": "anchor_split_multiplier"}, sparse=True))
    filings = effective.select("ticker", *[F.col(c).alias(n) for n, c in {
        "vendor_filed_shares": "shares_outstanding", "vendor_provider_symbol": "provider_symbol", "vendor_share_source": "shares_source",
        "vendor_reporting_currency": "currency_symbol", "vendor_retrieved_at": "retrieved_at",
        filed_at: "filing_date", "shares_period_date": "period_date"}.items()])
    # one row per filing that is in force on some day of a security
    filed = rows.select("security_id", "ticker", filed_at).distinct().join(filings, ["ticker", filed_at])
    filed = filed.withColumn("_retrieved", F.col("vendor_retrieved_at").cast("date"))
    days = {"period_split_multiplier": "shares_period_date", "final_split_factor": "_retrieved"}
    asked = filed.select(*own, F.explode(F.array(*days.values())).alias("_day")).distinct()
    known = stage(asof_join(asked, factors, own, "_day", "date", {multiplier: multiplier}))
    for out, day in days.items():
        filed = filed.join(known.select(*own, F.col("_day").alias(day), F.col(multiplier).alias(out)), [*own, day], "left")
    sourced = manual.select(
        "security_id", "ticker", F.col("price_date").alias("date"), F.col("sourced_shares").alias("manual_shares"),
        F.col("shares_as_of_date").alias("manual_as_of_date"), F.col("source_publication_date").alias("manual_publication_date"),
        F.col("source_name").alias("manual_source_name"), F.col("source_document_id").alias("manual_document_id"))
    sourced = counted_rows(sourced, "_sourced")
    facts = ["security_id", "ticker", "vendor_provider_symbol", "shares_period_date", "shares_filing_date", "vendor_filed_shares"]
    rejected = manual.where("target_provider_symbol IS NOT NULL").select(
        "security_id", "ticker", F.col("target_provider_symbol").alias("vendor_provider_symbol"),
        F.col("target_period_date").alias("shares_period_date"), F.col("target_filing_date").alias("shares_filing_date"),
        F.col("target_shares").alias("vendor_filed_shares"))
    # only counts that were filed can be met; most rejections of a shared ticker end here
    filed_counts = bounded_broadcast(effective.select(
        "ticker", F.col("provider_symbol").alias("vendor_provider_symbol"), F.col("period_date").alias("shares_period_date"),
        F.col("filing_date").alias("shares_filing_date"), F.col("shares_outstanding").alias("vendor_filed_shares")))
    rejected = rejected.join(filed_counts, facts[1:], "left_semi").distinct().withColumn("_bad", F.lit(True))
    if "security_id" not in pairs.columns:
        pairs = pairs.select(F.col("security_id_a").alias("security_id")).unionByName(pairs.select(F.col("security_id_b").alias("security_id")))
    issuers = pairs.select("security_id").distinct().withColumn("_multi", F.lit(True))
    names = counted_rows(resolution.select("security_id", "ticker", "bronze_security_name", "resolved_exchange"), "_named")
    filed = filed.join(rejected, facts, "left")
    rows = (
        rows.join(filed, ["security_id", "ticker", filed_at], "left").join(sourced, ["security_id", "ticker", "date"], "left")
        .join(identity.select("ticker", "ticker_identity_ambiguous"), "ticker", "left")
        .join(calibration.select("security_id", F.col("calibration_status").alias("vendor_calibration_status"),
                                 F.col("comparable_snapshots").alias("vendor_comparable_snapshots")), own, "left")
        .join(names, ["security_id", "ticker"], "left")
        .join(issuers, own, "left")
    )
    one = F.lit(1).cast("long")
    rows = rows.withColumn(TIMES, F.coalesce("_sourced", one) * F.coalesce("_named", one)).drop("_sourced", "_named")
    current, anchor = F.col("current_split_multiplier"), F.col("anchor_split_multiplier")
    final, period = F.col("final_split_factor"), F.coalesce("period_split_multiplier", F.lit(1.0))
    filed, calibrated = F.col("vendor_filed_shares"), F.col("vendor_calibration_status")
    rows = rows.withColumns({
        "shares_age_days": F.datediff("date", "shares_filing_date"), "multi_issue_issuer_total": is_true("_multi"),
        "vendor_observation_invalidated": is_true("_bad"), "ticker_identity_ambiguous": is_true("ticker_identity_ambiguous"),
    })
    basis = status_case(
        [
            (filed.isNull(), "no_source_count"), (F.col("shares_filing_date") <= F.col("shares_period_date"), "publication_date_unverified"),
            (F.col("multi_issue_issuer_total"), "multi_issue_issuer_total"),
            (unit_unverified("bronze_security_name", "resolved_exchange", "vendor_reporting_currency"), "quote_share_unit_unverified"),
            (calibrated == "cross_source_conflict", "cross_source_conflict"),
            (final.isNull() | current.isNull(), "missing_split_factor"),
            (F.abs(F.ln(final / period)) <= F.ln(F.lit(1.01)), "no_later_recorded_split"),
            (calibrated == "retrospective_confirmed", "retrospective_confirmed"),
            (calibrated == "contemporaneous_confirmed", "contemporaneous_confirmed"),
        ],
        "split_basis_unverified")
    rows = rows.withColumns({
        "vendor_basis_status": basis,
        "snapshot_within_365_days": is_true(
            F.datediff("date", "snapshot_date").between(0, 365) & (F.col("snapshot_anchor_price_date") <= F.col("date"))
            & (current > 0) & (anchor > 0)),
        "vendor_within_365_days": is_true((filed > 0) & F.col("shares_age_days").between(0, 365) & ~F.col("ticker_identity_ambiguous")),
        "manual_within_365_days": is_true((F.col("manual_shares") > 0) & F.datediff("date", "manual_publication_date").between(0, 365)),
    })
    status = F.col("vendor_basis_status")
    rows = rows.withColumn(
        "vendor_normalized_shares",
        F.when(status == "retrospective_confirmed", filed * current / final)
        .when(status == "contemporaneous_confirmed", filed * current / period).when(status == "no_later_recorded_split", filed))
    vendor_ok = F.col("vendor_within_365_days") & status.isin(*USABLE_BASES) & ~F.col("vendor_observation_invalidated")
    rows = rows.withColumns({
        "snapshot_current_shares_candidate": F.when(F.col("snapshot_within_365_days"), F.col("snapshot_shares") * current / anchor),
        "manual_current_shares_candidate": F.when(F.col("manual_within_365_days"), F.col("manual_shares")),
        "vendor_current_shares_candidate": F.when(vendor_ok, F.col("vendor_normalized_shares")),
        "selected_source": status_case(
            [(F.col("snapshot_within_365_days"), "snapshot"), (F.col("manual_within_365_days"), "manual_sourced"), (vendor_ok, "vendor")],
            "no_eligible_share_source"),
    })
    order = ("snapshot_current_shares_candidate", "manual_current_shares_candidate", "vendor_current_shares_candidate")
    rows = rows.withColumn("selected_shares_candidate", F.coalesce(*order))
    cap = F.when(F.col("close") > 0, F.col("close") * F.col("selected_shares_candidate"))
    return rows.withColumn("market_cap_candidate", cap).drop(
        "_retrieved", "_bad", "_multi", "bronze_security_name", "resolved_exchange", "anchor_split_multiplier", "ticker_identity_ambiguous")


def source_counts(caps: DataFrame) -> DataFrame:
    """Days, issues and largest cap per selected source (TB-67)."""
    return caps.groupBy("selected_source").agg(
        _rows(caps).alias("issue_days"), F.count_distinct("security_id").alias("issues"),
        _rows(caps, F.col("market_cap_candidate") > 0).alias("priced_issue_days"),
        F.max("market_cap_candidate").alias("largest_cap_candidate"))


# --- jump guard ------------------------------------------------------------------------

FACT = ("security_id", "ticker", "vendor_provider_symbol", "shares_period_date", "shares_filing_date", "vendor_filed_shares")


def _priced(caps: DataFrame) -> DataFrame:
    return caps.where("vendor_filed_shares > 0 AND shares_filing_date IS NOT NULL AND close > 0")


def guard_observations(caps: DataFrame, threshold: float = 100.0) -> DataFrame:
    """One row per filed count with its first usable value, classified against the last accepted one (TB-68)."""
    usable = F.when(F.col("vendor_current_shares_candidate") > 0, F.col("date"))
    facts = _priced(caps).groupBy(*FACT).agg(
        F.min("date").alias("first_price_date"), F.min(usable).alias("first_eligible_date"),
        F.min_by("vendor_current_shares_candidate", usable).alias("first_eligible_shares"),
        F.min_by("current_split_multiplier", usable).alias("first_eligible_factor"),
        F.bool_or("vendor_observation_invalidated").alias("invalidated"), _rows(caps).alias("priced_days"),
        _rows(caps, F.col("selected_source") == "vendor").alias("selected_days"))
    return classify_filings(facts, threshold)


QUARANTINED = "quarantined_100x_up"


def guard_impact(caps: DataFrame, guard: DataFrame) -> DataFrame:
    """Selected days resting on a quarantined count, and what carrying the last good one gives (TB-69)."""
    bad = guard.where(F.col("guard_status") == QUARANTINED).select(
        *FACT, "ratio_to_last_accepted", "prior_accepted_filing_date", "prior_accepted_shares", "prior_accepted_factor")
    rows = caps.where("selected_source = 'vendor'").join(bad, list(FACT))
    now, then = F.col("current_split_multiplier"), F.col("prior_accepted_factor")
    carry = (
        F.datediff("date", "prior_accepted_filing_date").between(0, 365) & (now > 0) & (then > 0) & (F.abs(now / then - 1) <= 0.01))
    shares = F.when(carry, F.col("prior_accepted_shares"))
    return rows.select(
        "security_id", "date", "ticker", "close", F.col("market_cap_candidate").alias("original_cap"),
        F.col("selected_shares_candidate").alias("original_shares"), "shares_filing_date", "vendor_filed_shares",
        "ratio_to_last_accepted", "prior_accepted_filing_date", shares.alias("dry_run_shares"),
        F.when((shares > 0) & (F.col("close") > 0), shares * F.col("close")).alias("dry_run_cap"), *[c for c in (TIMES,) if c in rows.columns])


def apply_guard(caps: DataFrame, impact: DataFrame) -> DataFrame:
    """Replace quarantined selections by the carried count, or by nothing (TB-69, MUT-4)."""
    rows = ensure_columns(caps, {"vendor_guard_status": "string", "vendor_guard_prior_filing_date": "date"})
    changes = impact.select("security_id", "date", "ticker", "dry_run_shares", "dry_run_cap", "prior_accepted_filing_date", _times(impact).alias(TIMES))
    met = F.coalesce(f"change_{TIMES}", F.lit(1).cast("long"))
    if TIMES not in rows.columns and TIMES in impact.columns:
        rows = rows.withColumn(TIMES, F.lit(1).cast("long"))
    # securities without a change keep their rows as they are and need not be shuffled
    touched = bounded_broadcast(changes.select("security_id").distinct())
    updated = update_from(rows.join(touched, "security_id", "left_semi"), changes, ["security_id", "date", "ticker"], {
        "selected_source": F.when(F.col("change_dry_run_shares") > 0, "vendor_guard_carry").otherwise("no_eligible_share_source"),
        "selected_shares_candidate": F.col("change_dry_run_shares"), "market_cap_candidate": F.col("change_dry_run_cap"),
        "vendor_current_shares_candidate": F.lit(None).cast("double"), "vendor_guard_status": F.lit(QUARANTINED),
        "vendor_guard_prior_filing_date": F.col("change_prior_accepted_filing_date"),
    }, F.col("selected_source") == "vendor", {TIMES: F.col(TIMES) * met} if TIMES in rows.columns else None)
    return updated.unionByName(rows.join(touched, "security_id", "left_anti"))


# --- audits ----------------------------------------------------------------------------

def anomaly_audit(caps: DataFrame) -> DataFrame:
    """Every filed count ranked by how far it is from its neighbours and from other sources (TB-70)."""
    key = ["security_id", "vendor_provider_symbol", "shares_period_date", "shares_filing_date", "vendor_filed_shares"]
    priced = _priced(caps).withColumn("_proxy", F.when(
        (F.col("vendor_normalized_shares") > 0) & (F.col("current_split_multiplier") > 0),
        F.col("vendor_normalized_shares") / F.col("current_split_multiplier")))
    chosen = F.col("selected_source") == "vendor"
    seen = priced.groupBy(*key).agg(
        F.min("ticker").alias("ticker"), F.min("date").alias("first_price_date"), F.max("date").alias("last_price_date"),
        _rows(priced).alias("priced_days"), _rows(priced, chosen).alias("selected_days"),
        F.max(F.when(chosen, F.col("market_cap_candidate"))).alias("max_selected_cap"),
        F.max(F.col("close") * F.col("vendor_filed_shares")).alias("max_raw_cap"),
        F.bool_or("vendor_observation_invalidated").alias("invalidated"),
        F.bool_or(F.col("vendor_basis_status").isin(*USABLE_BASES)).alias("any_comparable_basis"),
        F.max(log_ratio("vendor_normalized_shares", "snapshot_current_shares_candidate")).alias("max_snapshot_log_ratio"),
        F.max(log_ratio("vendor_normalized_shares", "manual_current_shares_candidate")).alias("max_manual_log_ratio"))
    typical = exact_quantile(priced, key, "_proxy", 0.5, "share_basis_proxy", TIMES if TIMES in priced.columns else None)
    rows = seen.join(typical, key, "left").withColumn("log_shares", F.ln("share_basis_proxy"))
    rows = count_over(rows, ["security_id"], "observations_for_issue")
    order = ["shares_filing_date", "shares_period_date", "vendor_provider_symbol", "vendor_filed_shares"]
    rows = neighbours(rows, ["security_id"], order, {"_before": "share_basis_proxy"})
    rows = robust_z(rows, ["security_id"], "log_shares", 1.05, "_z")
    rows = rows.withColumns({
        "robust_z": F.when((F.col("observations_for_issue") >= 4) & (F.col("share_basis_proxy") > 0), F.col("_z")),
        "adjacent_log_ratio": log_ratio("share_basis_proxy", "_before"),
        "cross_source_log_ratio": F.greatest("max_snapshot_log_ratio", "max_manual_log_ratio"),
        "median_deviation_log_ratio": F.abs(F.col("log_shares") - F.col("median_log_shares")),
    })
    cross, near, z, away = (F.col(c) for c in ("cross_source_log_ratio", "adjacent_log_ratio", "robust_z", "median_deviation_log_ratio"))
    basis, off = F.col("any_comparable_basis"), away >= F.ln(F.lit(1.5))
    ten, two = F.ln(F.lit(10.0)), F.ln(F.lit(2.0))
    alone = F.col("max_snapshot_log_ratio").isNull() & F.col("max_manual_log_ratio").isNull()
    reason = status_case(
        [
            (cross >= ten, "cross_source_10x"), (basis & (near >= ten), "adjacent_10x"), (basis & (z >= 8) & off, "robust_z_8"),
            (cross >= two, "cross_source_2x"), (basis & (near >= two), "adjacent_2x"), (basis & (z >= 5) & off, "robust_z_5"),
            ((F.col("max_selected_cap") >= 500_000_000_000) & alone, "large_cap_unverified"),
        ],
        "no_flag")
    return rows.withColumn("review_reason", reason).drop("_before", "_z", "log_shares", "median_log_shares", "mad_log_shares")


def anomaly_summary(audit: DataFrame) -> DataFrame:
    """Observations, issues and days per review reason (TB-70)."""
    return audit.groupBy("review_reason").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("security_id").alias("issues"), F.sum("priced_days").alias("priced_days"),
        F.sum("selected_days").alias("selected_days"), F.max("max_selected_cap").alias("largest_selected_cap"))


def anomaly_queue(audit: DataFrame, section: str, k: int, by_z: bool = False) -> DataFrame:
    """The worst observation of each security in one section, first k securities (TB-70)."""
    chosen, large = F.col("selected_days") > 0, F.col("review_reason") == "large_cap_unverified"
    sections = {"selected_signal": chosen & ~large, "selected_large_cap": chosen & large, "unselected": F.col("selected_days") == 0}
    cap = F.col("max_raw_cap" if section == "unselected" else "max_selected_cap").desc_nulls_last()
    order = [F.col("robust_z").desc_nulls_last(), cap] if by_z and section == "selected_signal" else [cap]
    rows = audit.where((F.col("review_reason") != "no_flag") & sections[section])
    worst = best_match(rows, ["security_id"], [*order, F.col("shares_filing_date").desc()])
    return top_k(worst, [*order, F.col("security_id")], k)


def _between(a: str, b: str) -> Column:
    return safe_div(a, b).between(0.5, 2)


def jump_review(caps: DataFrame, guard: DataFrame, impact: DataFrame) -> DataFrame:
    """Evidence on every security with quarantined counts, with a disposition (TB-71).

    ``caps`` is the table after the guard was applied.
    """
    key = ["security_id"]
    bad = guard.where((F.col("guard_status") == QUARANTINED) & (F.col("selected_days") > 0))

    def first(c: str, out: str) -> Column:
        return F.min_by(c, "shares_filing_date").alias(out)

    flagged = bad.groupBy(*key).agg(
        F.min("ticker").alias("ticker"), F.count(F.lit(1)).alias("flagged_filings"), F.min("shares_filing_date").alias("first_flagged_filing"),
        F.max("shares_filing_date").alias("last_flagged_filing"), F.max("ratio_to_last_accepted").alias("largest_jump"),
        first("prior_accepted_filing_date", "first_prior_filing"), first("prior_accepted_shares", "first_prior_shares"),
        first("prior_accepted_factor", "first_prior_factor"), first("first_eligible_shares", "first_flagged_shares"))
    effect = impact.groupBy(*key).agg(
        _rows(impact).alias("selected_days"), _rows(impact, F.col("dry_run_shares") > 0).alias("carried_days"),
        _rows(impact, F.col("dry_run_shares").isNull()).alias("uncovered_days"), F.min("date").alias("first_selected_day"),
        F.max("date").alias("last_selected_day"), F.max("original_cap").alias("peak_original_cap"),
        F.max("dry_run_cap").alias("peak_carried_cap"), F.min("dry_run_cap").alias("minimum_carried_cap"))
    typical = exact_quantile(impact, key, "dry_run_cap", 0.5, "median_carried_cap", TIMES if TIMES in impact.columns else None)
    days = caps.join(bad.select(*FACT, "prior_accepted_shares", "prior_accepted_factor"), list(FACT))
    same_basis = (F.col("current_split_multiplier") > 0) & (
        F.abs(F.col("current_split_multiplier") / F.col("prior_accepted_factor") - 1) <= 0.01)
    counts = []
    for source in ("snapshot", "manual"):
        other = f"{source}_current_shares_candidate"
        known, both = F.col(other) > 0, (F.col(other) > 0) & (F.col("vendor_normalized_shares") > 0)
        counts += [
            _rows(days, both).alias(f"{source}_overlap_days"),
            _rows(days, both & _between("vendor_normalized_shares", other)).alias(f"{source}_matches_new_days"),
            _rows(days, known & same_basis & _between("prior_accepted_shares", other)).alias(f"{source}_matches_prior_days"),
        ]
    support = days.groupBy(*key).agg(*counts)
    after = guard.where(F.col("guard_status").isin("accepted", "split_boundary_unchecked")).select(
        *key, F.col("shares_filing_date").alias("_filed"), "first_eligible_factor", "first_eligible_shares")
    near = (
        (F.col("_filed") > F.col("first_flagged_filing")) & (F.col("first_eligible_factor") > 0)
        & (F.abs(F.col("first_eligible_factor") / F.col("first_prior_factor") - 1) <= 0.01)
        & _between("first_eligible_shares", "first_prior_shares"))
    later = flagged.select(*key, "first_flagged_filing", "first_prior_factor", "first_prior_shares").join(after, key).where(near).groupBy(*key).agg(
        F.min("_filed").alias("first_near_prior_after_flag"))
    eligible = caps.where("price_research_eligible AND market_cap_candidate > 0")
    totals = semi_join(eligible, impact, ["date"]).groupBy("date").agg(_total(eligible, "market_cap_candidate").alias("_selected"))
    state = caps.select("security_id", "date", "ticker", "price_research_eligible", "selected_source", _times(caps).alias("_state_times"))
    hit = impact.withColumn(TIMES, _times(impact)).join(state, ["security_id", "date", "ticker"])
    hit = hit.withColumn(TIMES, F.col(TIMES) * F.col("_state_times"))
    removed = hit.where("price_research_eligible AND selected_source <> 'vendor'").groupBy("date").agg(
        _total(hit, F.col("original_cap") - F.coalesce("dry_run_cap", F.lit(0.0))).alias("_removed"))
    daily = totals.join(removed, "date", "left").select("date", (F.col("_selected") + F.coalesce("_removed", F.lit(0.0))).alias("_total"))
    weight = hit.join(daily, "date", "left").where("price_research_eligible")
    material = weight.groupBy(*key).agg(
        _rows(weight).alias("research_eligible_days"),
        F.max(F.when(F.col("_total") > 0, 10000.0 * F.col("original_cap") / F.col("_total"))).alias("peak_reported_weight_bps"),
        F.max(F.when((F.col("_total") > 0) & F.col("dry_run_cap").isNotNull(), 10000.0 * F.greatest(
            F.col("original_cap") - F.col("dry_run_cap"), F.lit(0.0)) / F.col("_total"))).alias("peak_carry_delta_bps"))
    rows = flagged.join(effect, key)
    for part in (typical, support, later, material):
        rows = rows.join(part, key, "left")
    prior = F.coalesce(F.col("snapshot_matches_prior_days") + F.col("manual_matches_prior_days"), F.lit(0))
    new = F.coalesce(F.col("snapshot_matches_new_days") + F.col("manual_matches_new_days"), F.lit(0))
    return rows.withColumn("evidence_category", status_case(
        [
            ((prior > 0) & (new == 0), "independent_supports_prior"), ((new > 0) & (prior == 0), "independent_supports_new"),
            ((prior > 0) & (new > 0), "conflicting_independent_evidence"),
            (F.col("first_near_prior_after_flag").isNotNull(), "later_vendor_near_prior"),
            (F.col("median_carried_cap") < 1_000_000, "tiny_prior_cap_review"),
        ],
        "unresolved"))


def market_cap_closure(caps: DataFrame, resolution: DataFrame, k: int = 30, rounded: bool = True) -> DataFrame:
    """Largest cap of the k largest securities with its weight and distance from the usual count (TB-72)."""

    def shown(value: Column, digits: int) -> Column:
        return F.round(value, digits) if rounded else value

    rows = caps.where("price_research_eligible AND market_cap_candidate > 0")
    top = top_k(peak_per_key(rows, ["security_id"], "market_cap_candidate", ["date"]),
                [F.col("market_cap_candidate").desc(), F.col("security_id")], k)
    totals = semi_join(rows, top, ["date"]).groupBy("date").agg(_total(rows, "market_cap_candidate").alias("_total"))
    counted = semi_join(caps.where("selected_shares_candidate > 0"), top, ["security_id"])
    usual = exact_quantile(counted, ["security_id"], "selected_shares_candidate", 0.5, "_usual", TIMES if TIMES in counted.columns else None)
    span = counted.groupBy("security_id").agg(F.min("date").alias("first_selected_date"), F.max("date").alias("last_selected_date"))
    names = resolution.select("security_id", "ticker", "bronze_security_name")
    joined = top.join(totals, "date").join(usual, "security_id").join(span, "security_id").join(names, ["security_id", "ticker"], "left")
    return joined.select(
        "ticker", "date", "security_id", "bronze_security_name", shown(F.col("market_cap_candidate") / 1e9, 3).alias("cap_usd_bn"),
        shown(1e4 * F.col("market_cap_candidate") / F.col("_total"), 2).alias("weight_bps"), "selected_source",
        "selected_shares_candidate", shown(safe_div("selected_shares_candidate", "_usual"), 3).alias("ratio_to_issue_median"), "close",
        "vendor_basis_status", "first_selected_date", "last_selected_date")


def basis_impact(caps: DataFrame) -> DataFrame:
    """Days and raw caps per basis status of recent filed counts (TB-73)."""
    rows = caps.where("vendor_within_365_days AND vendor_filed_shares > 0")
    return rows.groupBy("vendor_basis_status").agg(
        _rows(rows).alias("issue_days"), F.count_distinct("security_id").alias("issues"),
        _rows(rows, F.col("selected_source") == "vendor").alias("selected_vendor_days"),
        F.max(F.col("close") * F.col("vendor_filed_shares")).alias("largest_raw_cap"))


def top_vendor_outliers(caps: DataFrame, resolution: DataFrame, k: int = 12) -> DataFrame:
    """Peak day of the securities with the largest vendor-based caps (TB-73)."""
    rows = caps.where("selected_source = 'vendor' AND market_cap_candidate > 0")
    peaks = top_k(peak_per_key(rows, ["security_id"], "market_cap_candidate", ["date"]),
                  [F.col("market_cap_candidate").desc(), F.col("security_id")], k)
    names = resolution.select("security_id", "ticker", "bronze_security_name", "resolved_instrument_type", "resolved_exchange")
    return peaks.join(names, ["security_id", "ticker"], "left").select(
        "date", "security_id", "ticker", "bronze_security_name", "resolved_instrument_type", "resolved_exchange", "market_cap_candidate",
        "close", "selected_shares_candidate", "shares_filing_date", "shares_period_date", "shares_age_days")


def known_cases(caps: DataFrame, cases: DataFrame) -> DataFrame:
    """State of named (security, date) cases (TB-73, JN-26)."""
    return repeated(semi_join(caps, cases, ["security_id", "date"])).select(
        "ticker", "date", "vendor_basis_status", "vendor_calibration_status", "selected_source", "vendor_filed_shares",
        "vendor_normalized_shares", "market_cap_candidate")


# --- sourced corrections ---------------------------------------------------------------

def stage_corrections(
    prices: DataFrame, sources: DataFrame, effective: DataFrame, factor: float = 100.0, days: int = 365
) -> DataFrame:
    """Sourced counts for each priced day, the newest publication first; a vendor count far above is targeted (TB-74).

    ``sources`` has (security_id, ticker, publication_date, first_price_date, shares_as_of_date,
    sourced_shares, source_name, source_document_id). The target columns stay null when
    the vendor count is plausible.
    """
    dated = prices.select("security_id", "ticker", F.col("date").alias("price_date"), "close")
    usable = latest_available_source(dated, sources, ["security_id", "ticker"], "price_date", "publication_date", "first_price_date", days)
    newest = best_match(usable, ["security_id", "price_date"], [F.col("publication_date").desc(), "source_document_id"])
    rows = asof_join(newest, effective, ["ticker"], "price_date", "filing_date", {
        "_symbol": "provider_symbol", "_period": "period_date", "_filing": "filing_date", "_shares": "shares_outstanding"})
    bad = (F.col("_symbol") == F.concat("ticker", F.lit(".US"))) & (F.col("_shares") >= F.col("sourced_shares") * factor)
    targets = {"target_provider_symbol": "_symbol", "target_period_date": "_period", "target_filing_date": "_filing", "target_shares": "_shares"}
    return rows.withColumns({n: F.when(bad, F.col(c)) for n, c in targets.items()}).withColumn(
        "source_publication_date", F.col("publication_date")
    ).drop(*targets.values(), "publication_date", "first_price_date")


def staged_cohorts(stage: DataFrame) -> DataFrame:
    """Days, dates and targeted facts per source document of a staged correction (TB-74)."""
    fact = F.struct("target_provider_symbol", "target_period_date", "target_filing_date", "target_shares")
    flagged = F.col("target_shares").isNotNull()
    return stage.groupBy("ticker", "source_document_id", "sourced_shares").agg(
        F.count(F.lit(1)).alias("price_days"), F.min("price_date").alias("first_day"), F.max("price_date").alias("last_day"),
        F.count_distinct(F.when(flagged, fact)).alias("targets"), F.count_if(flagged).alias("flagged_issue_days"))


# --- quality and coverage audits -------------------------------------------------------

def quality_audit(
    universe: DataFrame, requests: DataFrame, observations: DataFrame, pit: DataFrame, basis: DataFrame,
    per_decile: int = 20, salt: str = "shares-quality-v2",
) -> DataFrame:
    """Repeatable sample of securities by length of history, with source and point-in-time coverage (TB-78)."""
    members = universe.where("primary_research_eligible_exchange").select("security_id", "date", "ticker")
    history = members.groupBy("security_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("research_rows"))
    ranked = n_tiles(history, [], ["research_rows", "security_id"], 10, "history_decile")
    sample = hash_first_k(ranked, ["history_decile"], ["security_id"], salt, per_decile).drop("sample_rank")
    rows = semi_join(members, sample, ["security_id"])
    asked = requests.groupBy("ticker").agg(F.count(F.lit(1)).alias("_requests"), F.bool_or(F.col("http_status") == 200).alias("_ok"))
    filed = F.col("filing_date").isNotNull()
    usable = filed & (F.col("shares_outstanding") > 0) & (F.col("period_date") <= F.col("filing_date"))
    found = observations.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_records"), F.count_if(filed).alias("_filed"), F.count_if(usable).alias("_usable"))
    by_source = (
        rows.select("security_id", "ticker").distinct().join(asked, "ticker", "left").join(found, "ticker", "left").groupBy("security_id")
        .agg(
            F.count(F.lit(1)).alias("historical_tickers"), F.sum(F.coalesce("_requests", F.lit(0))).alias("recorded_requests"),
            F.bool_or(is_true("_ok")).alias("http_success"), F.sum(F.coalesce("_records", F.lit(0))).alias("source_records"),
            F.sum(F.coalesce("_filed", F.lit(0))).alias("filed_records"), F.sum(F.coalesce("_usable", F.lit(0))).alias("usable_records"))
    )
    known = pit.select("security_id", "date", "shares_pit_available", "shares_filing_date")
    covered = is_true("shares_pit_available")
    by_day = (
        rows.join(sample.select("security_id", "first_date"), "security_id").join(known, ["security_id", "date"], "left").groupBy("security_id")
        .agg(
            F.count_distinct(F.when(covered, F.col("date"))).alias("pit_covered_rows"),
            F.bool_or((F.col("date") == F.col("first_date")) & covered).alias("covers_research_start"),
            F.min(F.when(covered, F.col("shares_filing_date"))).alias("earliest_usable_filing_date"))
    )
    traded = rows.join(basis.select("security_id", "date", "close", "volume"), ["security_id", "date"]).where("close > 0 AND volume > 0")
    liquid = exact_quantile(
        traded.withColumn("_value", F.col("close") * F.col("volume")), ["security_id"], "_value", 0.5, "median_dollar_volume_proxy")
    joined = sample.join(by_source, "security_id", "left").join(by_day, "security_id", "left").join(liquid, "security_id", "left")
    return joined.withColumns({
        "pit_row_coverage": safe_div("pit_covered_rows", "research_rows"),
        "filing_date_record_share": safe_div("filed_records", "source_records"),
        "all_records_have_filing_date": (F.col("source_records") > 0) & (F.col("source_records") == F.col("filed_records")),
    })


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def quality_summary(audit: DataFrame) -> DataFrame:
    """Rates over the whole sample in one row (TB-78)."""
    return audit.agg(
        F.count(F.lit(1)).alias("sample_securities"), _share(F.col("http_success")).alias("http_success_rate"),
        _share(F.col("usable_records") > 0).alias("any_usable_source_rate"),
        _share(F.col("covers_research_start")).alias("pit_at_research_start_rate"),
        safe_div(F.sum("pit_covered_rows"), F.sum("research_rows")).alias("pit_row_coverage_weighted"),
        _share(F.col("all_records_have_filing_date")).alias("all_records_filed_security_rate"),
        safe_div(F.sum("filed_records"), F.sum("source_records")).alias("filing_date_record_share"))


def quality_gaps(audit: DataFrame, short_rows: int = 252, ended_before: str = "2025-01-01", started_before: str = "2011-01-01") -> DataFrame:
    """The same gaps for short, ended, early and illiquid securities (TB-78)."""
    cut = exact_quantile(audit, [], "median_dollar_volume_proxy", 0.25, "cut").scalar()
    flags = {
        f"short_history_at_most_{short_rows}_rows": F.col("research_rows") <= short_rows,
        f"ended_before_{ended_before[:4]}": F.col("last_date") < F.lit(ended_before).cast("date"),
        f"research_start_before_{started_before[:4]}": F.col("first_date") < F.lit(started_before).cast("date"),
        "lowest_quartile_dollar_volume_proxy": F.col("median_dollar_volume_proxy") <= cut,
    }
    tagged = audit.withColumn("group", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()]))))
    typical = exact_quantile(tagged, ["group"], "pit_row_coverage", 0.5, "median_pit_row_coverage")
    counts = tagged.groupBy("group").agg(
        F.count(F.lit(1)).alias("securities"), F.count_if(F.col("usable_records") == 0).alias("no_usable_source"),
        F.count_if(~F.col("covers_research_start")).alias("missing_pit_at_start"))
    return counts.join(typical, "group", "left")


def coverage_audit(sample: DataFrame, records: DataFrame) -> DataFrame:
    """Landed quarterly records of sampled tickers against their research span (TB-79).

    ``records`` has (ticker, period_date, filing_date, shares).
    """
    shares, filed = F.col("shares") > 0, F.col("filing_date").isNotNull()
    found = records.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("quarterly_records"), F.min("period_date").alias("earliest_fundamental_date"),
        F.max("period_date").alias("latest_fundamental_date"), F.count_if(shares).alias("records_with_shares"),
        F.count_if(filed).alias("records_with_filing_date"), F.count_if(shares & filed).alias("usable_records"))
    joined = sample.join(found, "ticker", "left")
    counts = ("quarterly_records", "records_with_shares", "records_with_filing_date", "usable_records")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}).withColumns({
        "covers_research_start": is_true(F.col("earliest_fundamental_date") <= F.col("first_date")),
        "covers_research_end": is_true(F.col("latest_fundamental_date") >= F.col("last_date"))})
