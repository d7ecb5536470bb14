"""What kind of instrument a ticker is, and which security-days belong to the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import (
    COMMON, alphanumeric, canonical_code, classify_instrument, is_true, status_case, strip_market_suffix, syntax_type,
)
from marketspark.operators.aggregates import rollup_status
from marketspark.operators.joins import or_join, overlapping_pairs
from marketspark.operators.selection import best_match, latest_per_key, with_group_values
from marketspark.operators.timeline import running, segment_ids

# Types a listing file states explicitly, and the primary exchanges.
EXPLICIT_TYPES = ("Warrant", "Right", "Unit", "ETF", "ETN", "Test Issue", "When-Issued", "Preferred Stock", "Notes", "FUND")
PRIMARY_EXCHANGES = ("NASDAQ", "NYSE", "AMEX", "NYSE MKT")


def ticker_spans(returns: DataFrame) -> DataFrame:
    """First and last day of every ticker of a security."""
    return returns.groupBy("security_id", "ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def reference_candidates(returns: DataFrame, references: DataFrame) -> DataFrame:
    """Reference rows whose code is the ticker, exactly or in canonical spelling (TB-49)."""
    codes = references.withColumnRenamed("code", "provider_code")
    return or_join(
        ticker_spans(returns), codes, F.upper("ticker"), F.upper("provider_code"), canonical_code("provider_code"), "candidate_method")


def ticker_candidates(returns: DataFrame, references: DataFrame) -> DataFrame:
    """The candidates of each distinct ticker, whatever the number of securities that share it."""
    codes = references.withColumnRenamed("code", "provider_code")
    return or_join(
        returns.select("ticker").distinct(), codes, F.upper("ticker"), F.upper("provider_code"), canonical_code("provider_code"), "candidate_method")


def symbol_fallback(symbols: DataFrame) -> DataFrame:
    """Latest listing row per symbol with the type its wording implies (TB-50)."""
    latest = latest_per_key(symbols.withColumn("_key", F.upper("act_symbol")), ["_key"], ["last_seen", "security_name"])
    kind = classify_instrument("act_symbol", "security_name", "is_etf", "is_test_issue")
    return latest.withColumn("inferred_instrument_type", kind).withColumnRenamed("act_symbol", "ticker").drop("_key")


def _agreement(candidates: DataFrame, method: str, prefix: str) -> DataFrame:
    rows = candidates.where(F.col("candidate_method") == method)
    return rows.groupBy(*[c for c in ("security_id", "ticker") if c in rows.columns]).agg(
        F.count(F.lit(1)).alias(f"{prefix}_candidate_rows"),
        F.count_distinct("instrument_type").alias(f"{prefix}_n_types"), F.count_distinct("exchange").alias(f"{prefix}_n_exchanges"),
        F.min("instrument_type").alias(f"{prefix}_instrument_type"), F.min("exchange").alias(f"{prefix}_exchange"),
        F.min("isin").alias(f"{prefix}_isin"), F.bool_or(~F.col("is_delisted")).alias(f"{prefix}_has_active"),
        F.bool_or("is_delisted").alias(f"{prefix}_has_delisted"))


def ticker_reference_resolution(
    returns: DataFrame, manual: DataFrame, candidates: DataFrame, fallback: DataFrame
) -> DataFrame:
    """Instrument type, exchange and ISIN per ticker by a five-step order of trust (TB-51).

    ``candidates`` are rows per security and ticker or, from :func:`ticker_candidates`, per ticker.
    """
    by_ticker = "security_id" not in candidates.columns
    key = ["_asked"] if by_ticker else ["security_id", "ticker"]

    def agreed(method: str, prefix: str) -> DataFrame:
        found = _agreement(candidates, method, prefix)
        return found.withColumnRenamed("ticker", "_asked") if by_ticker else found

    by_hand = manual.select(F.upper("ticker").alias("_key"), F.col("instrument_type").alias("manual_instrument_type"))
    listed = fallback.select(
        F.upper("ticker").alias("_key"), F.col("inferred_instrument_type").alias("bronze_instrument_type"),
        F.col("listing_exchange").alias("bronze_exchange"), F.col("security_name").alias("bronze_security_name"),
        F.col("last_seen").alias("bronze_last_seen"))
    rows = (
        ticker_spans(returns).withColumns({
            "_key": F.upper("ticker"), "_asked": F.when(F.col("security_id").isNotNull(), F.col("ticker")), "syntax_instrument_type": syntax_type("ticker")})
        .join(by_hand, "_key", "left").join(listed, "_key", "left")
        .join(agreed("exact_code", "exact"), key, "left")
        .join(agreed("canonicalized_code", "canonical"), key, "left").drop("_key", "_asked")
    )
    bronze, explicit = F.col("bronze_instrument_type"), is_true(F.col("bronze_instrument_type").isin(*EXPLICIT_TYPES))
    one_exact, one_canonical = F.col("exact_n_types") == 1, F.col("canonical_n_types") == 1
    steps = [
        (F.col("manual_instrument_type").isNotNull(), "resolved_manual_override", F.col("manual_instrument_type")),
        (F.col("syntax_instrument_type").isNotNull(), "resolved_symbol_syntax", F.col("syntax_instrument_type")),
        (explicit, "resolved_bronze_explicit_noncommon", bronze),
        (one_exact, "resolved_vendor_exact", F.col("exact_instrument_type")),
        (F.col("exact_n_types") > 1, "ambiguous_vendor_exact", None),
        (bronze.isNotNull(), "resolved_bronze_symbol", bronze),
        (one_canonical, "resolved_vendor_canonical", F.col("canonical_instrument_type")),
        (F.col("canonical_n_types") > 1, "ambiguous_vendor_canonical", None),
    ]
    # an ambiguous vendor match is reported, but a later source may still give the type
    kind = F.coalesce(*[F.when(condition, value) for condition, _, value in steps if value is not None])
    return rows.withColumns({
        "resolved_instrument_type": kind,
        "resolved_exchange": F.when(F.col("exact_n_exchanges") == 1, F.col("exact_exchange"))
        .when(F.col("bronze_exchange").isNotNull(), F.col("bronze_exchange"))
        .when(F.col("canonical_n_exchanges") == 1, F.col("canonical_exchange")),
        "resolved_isin": F.coalesce("exact_isin", "canonical_isin"),
        "has_active_reference": F.coalesce("exact_has_active", "canonical_has_active", F.lit(False)),
        "has_delisted_reference": F.coalesce("exact_has_delisted", "canonical_has_delisted", F.lit(False)),
        "reference_resolution_status": status_case([(c, s) for c, s, _ in steps], "unresolved"),
    })


def security_reference_resolution(resolution: DataFrame) -> DataFrame:
    """Do all tickers of a security agree on its type? (TB-52)"""
    return rollup_status(resolution, ["security_id"], "resolved_instrument_type").withColumnsRenamed({
        "observed": "observed_tickers", "resolved": "resolved_tickers", "unresolved": "unresolved_tickers",
        "distinct_values": "distinct_resolved_types", "candidate_value": "candidate_security_type",
        "resolved_value": "resolved_security_type", "status": "security_reference_status",
    })


def research_universe(returns: DataFrame, resolution: DataFrame) -> DataFrame:
    """Dated eligibility: usable return, common equity, primary exchange (TB-53)."""
    known = resolution.select(
        "security_id", "ticker", F.col("resolved_instrument_type").alias("instrument_type"), F.col("resolved_exchange").alias("exchange"),
        F.col("resolved_isin").alias("isin"), "reference_resolution_status", "has_active_reference", "has_delisted_reference")
    rows = returns.select("security_id", "date", "ticker", F.col("final_research_eligible").alias("return_research_eligible"))
    common = is_true(F.col("instrument_type") == COMMON)
    primary = common & is_true(F.col("exchange").isin(*PRIMARY_EXCHANGES))
    good = F.col("return_research_eligible")
    return rows.join(known, ["security_id", "ticker"], "left").withColumns({
        "common_equity_broad": common, "common_equity_primary_exchange": primary,
        "primary_research_eligible_broad": good & common, "primary_research_eligible_exchange": good & primary,
    })


def eligible_universe(returns: DataFrame, resolution: DataFrame) -> DataFrame:
    """The rows of the universe that are eligible on a primary exchange, without forming the others."""
    return research_universe(returns.where("final_research_eligible"), resolution).where("primary_research_eligible_exchange")


def symbol_search_resolution(results: DataFrame) -> DataFrame:
    """Best search hit per ticker: same code first, same letters and digits second (TB-54)."""
    body, wanted = strip_market_suffix("result_code"), F.upper("query_ticker")
    rank = F.when(body == wanted, 1).when(alphanumeric(body) == alphanumeric(wanted), 2).otherwise(99)
    rows = results.withColumns({"parsed_ticker_body": body, "match_rank": rank})
    best = best_match(rows, ["query_ticker"], ["match_rank", "result_rank"])
    status = F.when(F.col("match_rank") == 1, "parsed_body_exact_match").when(
        F.col("match_rank") == 2, "punctuation_normalized_match").otherwise("no_usable_search_match")
    return best.withColumn("resolution_status", status)


def _issuer_spans(universe: DataFrame, issuer_tickers: DataFrame) -> DataFrame:
    spans = universe.where("primary_research_eligible_exchange").groupBy("security_id", F.upper("ticker").alias("ticker")).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("research_rows"))
    issuers = issuer_tickers.where("cik IS NOT NULL AND ticker IS NOT NULL").select("cik", F.upper("ticker").alias("ticker")).distinct()
    return spans.join(issuers, "ticker")


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Number the groups of spans of a key that hang together by overlaps (``_island``)."""
    before = running(spans, keys, ["first_date", "last_date"], {"_reach": ("max", F.col("last_date"))}, exclusive=True)
    apart = F.coalesce(F.col("first_date") > F.col("_reach"), F.lit(True))
    return segment_ids(before, keys, ["first_date", "last_date"], apart, "_island").drop("_reach")


def multi_listed_securities(universe: DataFrame, issuer_tickers: DataFrame) -> DataFrame:
    """The securities that occur in :func:`multi_listed_pairs`, found without forming the pairs.

    Overlapping spans of one security are merged first. What then hangs together with
    another span of the issuer overlaps a span of another security.
    """
    known = "security_id IS NOT NULL AND first_date IS NOT NULL"
    spans = _issuer_spans(universe, issuer_tickers).where(known).groupBy("cik", "security_id", "first_date").agg(F.max("last_date").alias("last_date"))
    own = _islands(spans, ["cik", "security_id"]).groupBy("cik", "security_id", "_island").agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    # equal spans of several securities are one row: the order needs no tie-break
    merged = own.groupBy("cik", "first_date", "last_date").agg(F.count(F.lit(1)).alias("_n"))
    numbered = with_group_values(_islands(merged, ["cik"]), ["cik", "_island"], F.sum("_n").alias("_all")).where("_all > 1")
    return own.join(numbered.select("cik", "first_date", "last_date"), ["cik", "first_date", "last_date"], "left_semi").select("security_id").distinct()


def multi_listed_pairs(universe: DataFrame, issuer_tickers: DataFrame) -> DataFrame:
    """Pairs of eligible securities of one issuer that were listed at the same time (TB-55)."""
    pairs = overlapping_pairs(
        _issuer_spans(universe, issuer_tickers), ["cik"], "security_id", "first_date", "last_date", ["ticker", "research_rows"])
    return pairs.withColumn("overlap_calendar_days", F.datediff("overlap_end", "overlap_start") + 1)
