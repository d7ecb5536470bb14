"""Queries for splits, dividends, returns and corrections (TB-26 to TB-48, DQ-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.catalog.views import CHECKS
from marketspark.plans import actions as A
from marketspark.plans import returns as R


CHECKS |= {
    "y_lag": "SELECT act_symbol, date, close, lag(date) OVER w AS previous_trading_date, lag(close) OVER w AS previous_close FROM symbol_bars WINDOW w AS (PARTITION BY act_symbol ORDER BY date)",
    "y_audit": """SELECT s.act_symbol, s.ex_date AS source_ex_date, s.to_factor, s.for_factor, s.stated_ratio, p.previous_trading_date, p.previous_close, p.close AS event_close, p.close / p.previous_close AS raw_price_ratio, p.close * s.stated_ratio / p.previous_close - 1 AS implied_return,
        p.close IS NOT NULL AS has_price_on_ex_date, n.k AS nearby_same_ratio_count, p.close IS NULL OR COALESCE(abs(p.close * s.stated_ratio / p.previous_close - 1) > 0.5, FALSE) OR n.k > 0 AS suspicious_flag
        FROM (SELECT *, to_factor / for_factor AS stated_ratio FROM splits) s LEFT JOIN y_lag p ON p.act_symbol = s.act_symbol AND p.date = s.ex_date
        JOIN (SELECT a.act_symbol, a.ex_date, count(*) - 1 AS k FROM splits a JOIN splits b ON a.act_symbol = b.act_symbol AND a.to_factor / a.for_factor = b.to_factor / b.for_factor AND abs(a.ex_date - b.ex_date) <= 30 GROUP BY a.act_symbol, a.ex_date) n ON n.act_symbol = s.act_symbol AND n.ex_date = s.ex_date""",
    "y_numbered": "SELECT row_number() OVER (ORDER BY act_symbol, source_ex_date, to_factor, for_factor) AS source_split_row_id, * FROM y_audit",
    "y_away": """SELECT n.source_split_row_id, e.*, CASE WHEN n.source_ex_date BETWEEN e.start_date AND e.end_date THEN 0 ELSE list_min([abs(n.source_ex_date - e.start_date), abs(n.source_ex_date - e.end_date)]) END AS days
        FROM y_numbered n JOIN episode_spans e USING (act_symbol)""",
    "y_nearest": "SELECT source_split_row_id, arg_min({'e': ticker_episode_id, 's': security_id}, (days, start_date, ticker_episode_id)) AS near, min(days) AS days FROM y_away GROUP BY source_split_row_id",
    "y_methods": """SELECT * FROM (VALUES (0, 0, 'exact_episode_date'), (1, 7, 'nearest_episode_within_7d'), (8, 30, 'nearest_episode_8_30d'), (31, 99999, 'unresolved_distance_gt_30d')) m(least, most, method)""",
    "y_mapped": """SELECT n.*, near.e AS candidate_ticker_episode_id, days AS episode_distance_days, COALESCE(method, 'unresolved_no_episode') AS episode_mapping_method, CASE WHEN days <= 7 THEN near.s END AS security_id, days = 0 AND NOT suspicious_flag AS good
        FROM y_numbered n LEFT JOIN y_nearest USING (source_split_row_id) LEFT JOIN y_methods ON days BETWEEN least AND most""",
    "y_candidate": """SELECT * EXCLUDE (good) RENAME (act_symbol AS ticker), nearby_same_ratio_count > 0 AS nearby_same_ratio_duplicate, implied_return IS NOT NULL AND abs(implied_return) > 0.5 AS large_implied_return,
        if(COALESCE(good, FALSE), 'provisionally_accepted', 'requires_reconciliation') AS validation_status, if(good, source_ex_date, NULL) AS validated_ex_date, if(good, stated_ratio, NULL) AS validated_ratio, if(good, 'primary_split_audit', NULL) AS validation_source
        FROM y_mapped""",
    "y_pair": """SELECT c.source_split_row_id, p.observation_id AS provider_observation_id, p.split_date AS provider_split_date, p.to_factor / p.for_factor AS provider_split_ratio, p.to_factor AS provider_to_factor, p.for_factor AS provider_for_factor, abs(c.source_ex_date - p.split_date) AS date_distance_days,
        abs(c.stated_ratio - p.to_factor / p.for_factor) AS ratio_difference, abs(c.stated_ratio - p.to_factor / p.for_factor) <= 1e-6 * greatest(1.0, p.to_factor / p.for_factor) AS ratio_matches, c.source_ex_date = p.split_date AS date_matches, c.validation_status
        FROM y_candidate c JOIN vendor_splits p ON p.provider_symbol = c.ticker || '.US' AND abs(c.source_ex_date - p.split_date) <= 45""",
    "y_best": """SELECT *, count(*) OVER (PARTITION BY source_split_row_id) AS provider_candidates_within_45d, count(*) FILTER (WHERE ratio_matches) OVER (PARTITION BY source_split_row_id) AS same_ratio_candidates_within_45d FROM y_pair
        QUALIFY row_number() OVER (PARTITION BY source_split_row_id ORDER BY CASE WHEN date_matches AND ratio_matches THEN 1 WHEN ratio_matches THEN 2 WHEN date_matches THEN 3 ELSE 4 END, date_distance_days, ratio_difference, provider_split_date, provider_observation_id) = 1""",
    "y_history": """SELECT c.*, b.* EXCLUDE (source_split_row_id, validation_status, date_matches, ratio_matches, provider_candidates_within_45d, same_ratio_candidates_within_45d), COALESCE(date_matches, FALSE) AS date_matches, COALESCE(ratio_matches, FALSE) AS ratio_matches,
        COALESCE(provider_candidates_within_45d, 0) AS provider_candidates_within_45d, COALESCE(same_ratio_candidates_within_45d, 0) AS same_ratio_candidates_within_45d,
        CASE WHEN provider_observation_id IS NULL THEN 'no_provider_match_within_45d' WHEN date_matches AND ratio_matches THEN 'exact_date_exact_ratio' WHEN ratio_matches THEN 'nearby_date_exact_ratio' WHEN date_matches THEN 'exact_date_ratio_conflict' ELSE 'nearby_date_ratio_conflict' END AS comparison_status
        FROM y_candidate c LEFT JOIN y_best b USING (source_split_row_id)""",
    "y_split_event": """SELECT security_id, ticker, split_date, split_ratio, to_factor, for_factor, validation_source, validation_method, provider_observation_id, source_row_count FROM (
        SELECT min(security_id) AS security_id, min(ticker) AS ticker, min(provider_split_date) AS split_date, min(provider_split_ratio) AS split_ratio, min(provider_to_factor) AS to_factor, min(provider_for_factor) AS for_factor, 'vendor' AS validation_source,
            CASE WHEN count(*) > 1 AND bool_or(date_matches AND ratio_matches) THEN 'vendor_duplicate_collapse' WHEN count(*) > 1 AND bool_or(ratio_matches) AND NOT bool_or(date_matches) THEN 'vendor_date_correction_duplicate_collapse' WHEN bool_or(date_matches AND NOT ratio_matches) THEN 'vendor_ratio_correction'
                WHEN bool_or(date_matches AND ratio_matches) THEN 'vendor_exact_confirmation' WHEN bool_or(ratio_matches) THEN 'vendor_date_correction' ELSE 'vendor_validated' END AS validation_method, provider_observation_id, count(*) AS source_row_count
        FROM y_history WHERE provider_observation_id IS NOT NULL AND security_id IS NOT NULL AND (date_matches OR ratio_matches) GROUP BY provider_observation_id HAVING count(DISTINCT security_id) = 1
        UNION ALL SELECT security_id, ticker, source_ex_date, stated_ratio, to_factor, for_factor, 'primary', 'primary_provisional_no_vendor_match', NULL, 1 FROM y_history WHERE validation_status = 'provisionally_accepted' AND security_id IS NOT NULL AND comparison_status = 'no_provider_match_within_45d' AND stated_ratio > 0) u
        QUALIFY row_number() OVER (PARTITION BY security_id, split_date ORDER BY validation_source DESC, provider_observation_id NULLS LAST) = 1""",
    "y_override": "SELECT e.security_id, s.* FROM override_seed s JOIN episode_spans e ON e.act_symbol = s.ticker AND s.event_date BETWEEN e.start_date AND e.end_date",
    "y_effective": "SELECT s.security_id, s.split_date AS date, CASE WHEN o.security_id IS NULL THEN s.split_ratio ELSE o.override_split_ratio END AS ratio FROM y_split_event s LEFT JOIN y_override o ON o.security_id = s.security_id AND o.event_date = s.split_date",
    "y_factor": """SELECT f.* FROM (SELECT t.security_id, t.date, COALESCE(e.ratio, 1.0e0) AS daily_split_ratio, exp(sum(ln(COALESCE(e.ratio, 1.0e0))) OVER w) AS cumulative_split_multiplier, sum(ln(COALESCE(e.ratio, 1.0e0))) OVER w AS cumulative_log_split_multiplier
        FROM (SELECT security_id, date FROM priced UNION SELECT security_id, date FROM y_effective WHERE ratio > 0) t LEFT JOIN (SELECT * FROM y_effective WHERE ratio > 0) e USING (security_id, date) WINDOW w AS (PARTITION BY t.security_id ORDER BY t.date)) f SEMI JOIN priced p ON p.security_id = f.security_id AND p.date = f.date""",
    "y_session": "SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS previous_session FROM sessions",
    "y_dividend": """SELECT e.security_id, e.ticker_episode_id, d.act_symbol AS ticker, d.ex_date, d.amount, s.previous_session, p.close AS previous_close, d.amount / p.close AS raw_indicated_dividend_yield, CASE WHEN d.amount = 0 THEN 'zero_source_artifact' WHEN d.amount / p.close > 0.25 THEN 'requires_reconciliation' ELSE 'provisionally_accepted' END AS validation_status
        FROM dividends d JOIN episode_spans e ON e.act_symbol = d.act_symbol AND d.ex_date BETWEEN e.start_date AND e.end_date JOIN y_session s ON s.session_date = d.ex_date JOIN priced c ON c.security_id = e.security_id AND c.date = d.ex_date AND c.research_eligible JOIN priced p ON p.security_id = e.security_id AND p.date = s.previous_session AND p.research_eligible""",
    "y_correction": "SELECT security_id, ticker, effective_dividend_ex_date AS event_date, dividend_previous_share_basis AS original_dividend_amount, vendor_unadjusted AS corrected_dividend_amount, vendor_adjusted, dividend_previous_share_basis / vendor_unadjusted AS retrospective_adjustment_factor, 'vendor' AS provider, 'retrospective_adjustment_correction' AS resolution_method FROM dividend_validation WHERE validation_status = 'retrospective_adjustment_correction'",
    "y_dividend_event": """SELECT security_id, ticker, ex_date, COALESCE(override_dividend_ex_date, ex_date) AS effective_dividend_ex_date, raw AS raw_dividend_amount, COALESCE(override_dividend_amount, raw) AS effective_dividend_amount, v AS dividend_previous_share_basis, daily_split_ratio, corporate_action_type, dividend_share_basis, m AS dividend_resolution_method, source_validation_status,
        resolution_source, source_reference, resolution_notes, v IS NOT NULL AND (raw > 0 OR COALESCE(corporate_action_type = 'stock_dividend', FALSE)) AS research_eligible FROM (
        SELECT d.security_id, d.ticker, d.ex_date, d.amount AS raw, d.validation_status AS source_validation_status, f.daily_split_ratio, o.* EXCLUDE (security_id, ticker, event_date),
            CASE WHEN o.corporate_action_type = 'composite_cash_and_in_kind_distribution' THEN NULL WHEN o.corporate_action_type = 'stock_dividend' THEN 0 WHEN o.dividend_share_basis = 'pre_split' THEN COALESCE(o.override_dividend_amount, d.amount) WHEN o.dividend_share_basis = 'post_split' THEN COALESCE(o.override_dividend_amount, d.amount) * COALESCE(o.override_split_ratio, f.daily_split_ratio)
                WHEN f.daily_split_ratio = 1 THEN COALESCE(c.corrected_dividend_amount, d.amount) END AS v,
            CASE WHEN o.corporate_action_type = 'composite_cash_and_in_kind_distribution' THEN 'unresolved_composite_distribution' WHEN o.corporate_action_type = 'stock_dividend' THEN 'manual_stock_dividend_only' WHEN o.dividend_share_basis = 'pre_split' THEN 'manual_pre_split_basis' WHEN o.dividend_share_basis = 'post_split' THEN 'manual_post_split_basis'
                WHEN f.daily_split_ratio = 1 THEN 'standard_cash_dividend' ELSE 'unresolved_same_day_split_basis' END AS m
        FROM y_dividend d JOIN y_factor f ON f.security_id = d.security_id AND f.date = d.ex_date JOIN y_session s ON s.session_date = d.ex_date JOIN y_factor g ON g.security_id = d.security_id AND g.date = s.previous_session
        LEFT JOIN y_override o ON o.security_id = d.security_id AND o.event_date = d.ex_date LEFT JOIN y_correction c ON c.security_id = d.security_id AND c.event_date = d.ex_date) r""",
    "y_paid": """SELECT security_id, effective_dividend_ex_date AS date, sum(CASE WHEN research_eligible THEN COALESCE(dividend_previous_share_basis, 0) ELSE 0 END) AS paid, bool_or(NOT research_eligible AND raw_dividend_amount > 0) AS unresolved, count(*) AS n, count(*) FILTER (WHERE research_eligible) AS ne FROM y_dividend_event GROUP BY security_id, effective_dividend_ex_date""",
    "y_basis": "SELECT p.* RENAME (research_eligible AS price_research_eligible), f.daily_split_ratio, f.cumulative_split_multiplier, f.cumulative_log_split_multiplier, p.close * f.cumulative_split_multiplier AS split_normalized_close FROM priced p JOIN y_factor f USING (security_id, date)",
    "y_return": """SELECT *, CASE WHEN return_status = 'eligible' THEN split_normalized_close / previous_split_normalized_close - 1 END AS price_return, CASE WHEN return_status = 'eligible' THEN (split_normalized_close + split_normalized_dividend) / previous_split_normalized_close - 1 END AS gross_total_return, return_status = 'eligible' AS research_eligible FROM (
        SELECT c.security_id, c.date, c.ticker, c.source, c.close, c.daily_split_ratio, c.cumulative_split_multiplier, c.split_normalized_close, s.previous_session AS previous_date, p.close AS previous_close, p.split_normalized_close AS previous_split_normalized_close, COALESCE(d.paid, 0) AS dividend_previous_share_basis,
            COALESCE(d.paid, 0) * p.cumulative_split_multiplier AS split_normalized_dividend, COALESCE(d.n, 0) AS dividend_source_rows, COALESCE(d.ne, 0) AS eligible_dividend_rows,
            CASE WHEN NOT c.price_research_eligible THEN 'current_price_not_research_eligible' WHEN s.previous_session IS NULL THEN 'no_previous_market_session' WHEN p.close IS NULL THEN 'missing_previous_price' WHEN NOT p.price_research_eligible THEN 'previous_price_not_research_eligible' WHEN d.unresolved THEN 'unresolved_positive_distribution'
                WHEN p.split_normalized_close <= 0 THEN 'invalid_previous_price' ELSE 'eligible' END AS return_status
        FROM y_basis c JOIN y_session s ON s.session_date = c.date LEFT JOIN y_basis p ON p.security_id = c.security_id AND p.date = s.previous_session LEFT JOIN y_paid d ON d.security_id = c.security_id AND d.date = c.date) j""",
    "y_extreme": """SELECT *, CASE WHEN provider_request_status_code IS NULL THEN 'no_provider_request' WHEN provider_request_status_code = 404 THEN 'provider_symbol_not_found' WHEN provider_request_status_code <> 200 THEN 'provider_request_failed' WHEN provider_previous_close IS NULL OR provider_current_close IS NULL THEN 'provider_price_pair_missing'
            WHEN abs(provider_raw_return) > 1 THEN 'provider_raw_also_extreme' ELSE 'provider_raw_not_extreme' END AS comparison_status FROM (
        SELECT r.security_id, r.ticker, r.date, r.previous_date, r.previous_close AS primary_previous_close, r.close AS primary_close, r.price_return AS primary_price_return, r.gross_total_return AS primary_gross_total_return, r.daily_split_ratio, r.dividend_previous_share_basis, q.provider_symbol, q.status_code AS provider_request_status_code,
            p.close AS provider_previous_close, c.close AS provider_current_close, c.close / p.close - 1 AS provider_raw_return, c.adjusted_close / p.adjusted_close - 1 AS provider_adjusted_return, p.close / r.previous_close AS provider_to_primary_previous_close_ratio, c.close / r.close AS provider_to_primary_current_close_ratio
        FROM y_return r LEFT JOIN validation_requests q ON q.ticker = r.ticker LEFT JOIN validation_bars p ON p.provider_symbol = q.provider_symbol AND p.date = r.previous_date LEFT JOIN validation_bars c ON c.provider_symbol = q.provider_symbol AND c.date = r.date WHERE r.research_eligible AND abs(r.gross_total_return) > 1) j""",
    "y_diagnostic": """SELECT *, CASE WHEN comparison_status IN ('provider_symbol_not_found', 'provider_price_pair_missing', 'provider_request_failed', 'no_provider_request') THEN 'provider_unavailable' WHEN abs(primary_price_return) <= 1 AND abs(provider_raw_return) <= 1 THEN 'dividend_or_distribution_anomaly' WHEN abs(primary_price_return) > 1 AND abs(provider_raw_return) <= 1 THEN 'primary_price_disagreement'
            WHEN abs(provider_raw_return) > 1 AND provider_adjusted_return IS NULL THEN 'vendor_raw_extreme_adjusted_missing' WHEN abs(provider_raw_return) > 1 AND abs(provider_adjusted_return) <= 1 THEN 'corporate_action_candidate' WHEN abs(provider_raw_return) > 1 THEN 'vendor_confirms_extreme_after_adjustment' ELSE 'other' END AS diagnostic_class,
        CASE WHEN b IS NULL OR n IS NULL THEN 'not_comparable' WHEN b AND n THEN 'price_levels_agree' WHEN n THEN 'previous_primary_price_scale_mismatch' WHEN b THEN 'current_primary_price_scale_mismatch' ELSE 'both_price_levels_differ' END AS price_level_diagnostic
        FROM (SELECT *, provider_to_primary_previous_close_ratio BETWEEN 0.8 AND 1.25 AS b, provider_to_primary_current_close_ratio BETWEEN 0.8 AND 1.25 AS n FROM y_extreme) e""",
    "y_split_check": """SELECT *, CASE WHEN provider_request_status_code IS NULL THEN 'no_provider_request' WHEN provider_request_status_code = 404 THEN 'provider_symbol_not_found' WHEN provider_request_status_code <> 200 THEN 'provider_request_failed' WHEN provider_split_date IS NULL THEN 'no_provider_split_within_45d'
            WHEN provider_split_date = date AND abs(provider_split_ratio - daily_split_ratio) < 1e-8 THEN 'exact_date_exact_ratio_already_present' WHEN provider_split_date = date THEN 'exact_date_ratio_conflict' WHEN abs(provider_split_ratio - daily_split_ratio) < 1e-8 THEN 'nearby_date_exact_ratio' ELSE 'nearby_date_ratio_conflict' END AS split_comparison_status FROM (
        SELECT d.security_id, d.ticker, d.date, d.provider_raw_return, d.provider_adjusted_return, d.daily_split_ratio, d.provider_request_status_code, s.ex_date AS provider_split_date, s.split_ratio AS provider_split_ratio, abs(d.date - s.ex_date) AS day_distance FROM y_diagnostic d
        LEFT JOIN validation_splits s ON s.provider_symbol = d.provider_symbol AND abs(d.date - s.ex_date) <= 45 WHERE d.diagnostic_class = 'corporate_action_candidate' QUALIFY row_number() OVER (PARTITION BY d.security_id, d.ticker, d.date ORDER BY day_distance, s.ex_date, s.split_ratio) = 1) b""",
    "y_research": """SELECT r.*, d.diagnostic_class, d.price_level_diagnostic, CASE WHEN NOT r.research_eligible THEN 'base_return_not_eligible:' || return_status WHEN gross_total_return IS NULL THEN 'null_gross_total_return' WHEN gross_total_return <= -1 THEN 'nonpositive_wealth_factor'
        WHEN abs(gross_total_return) > 1 AND COALESCE(diagnostic_class, '') <> 'vendor_confirms_extreme_after_adjustment' THEN 'extreme_return:' || COALESCE(diagnostic_class, 'unclassified_extreme_return') END AS research_quarantine_reason, research_quarantine_reason IS NULL AS final_research_eligible FROM y_return r LEFT JOIN y_diagnostic d USING (security_id, date)""",
    "y_segment": "SELECT *, sum(CASE WHEN final_research_eligible THEN 0 ELSE 1 END) OVER (PARTITION BY security_id ORDER BY date) AS return_segment_id FROM y_research",
}


def spans(v):
    return v.episode_spans.select("ticker_episode_id", "act_symbol", "start_date", "end_date")


def owners(v):
    return v.episode_spans.select("ticker_episode_id", "security_id")


def provider_splits(v):
    return v.vendor_splits.withColumn("split_ratio", F.col("to_factor") / F.col("for_factor"))


def audit(v):
    return A.split_audit(v.symbol_bars, v.splits)


def candidates(v):
    return v.keep("split_candidates", lambda: A.split_candidates(audit(v), spans(v), owners(v)))


def history(v):
    return A.split_full_history_comparison(candidates(v), provider_splits(v))


def events(v):
    return v.keep("split_events", lambda: A.split_events(history(v)))


def overrides(v):
    empty = v.override_seed.limit(0).select(F.lit(0).cast("long").alias("security_id"), "*")
    return v.keep("overrides", lambda: A.corporate_action_overrides(empty, v.override_seed, spans(v), owners(v)))


def factors(v):
    return v.keep("split_factors", lambda: A.split_factor(v.priced, events(v), overrides(v)))


def dividend_rows(v):
    return A.dividend_candidates(v.sessions, v.dividends, spans(v), owners(v), v.priced)


def dividend_events(v):
    return v.keep("dividend_events", lambda: A.dividend_events(dividend_rows(v), factors(v), v.sessions, overrides(v), A.dividend_corrections(v.dividend_validation)))


def returns(v):
    return v.keep("returns", lambda: R.daily_return(v.sessions, dividend_events(v), R.return_basis(v.priced, factors(v))))


def comparison(v):
    return A.extreme_return_comparison(returns(v), v.validation_requests, v.validation_bars)


def diagnostics(v):
    return v.keep("diagnostics", lambda: A.extreme_return_diagnostic(comparison(v)))


def research(v):
    return v.keep("research", lambda: R.research_return(returns(v), diagnostics(v)))


_AUDIT = dict(doubles="stated_ratio previous_close event_close raw_price_ratio implied_return", ints="nearby_same_ratio_count")
_CAND = dict(doubles=_AUDIT["doubles"] + " validated_ratio", ints="nearby_same_ratio_count source_split_row_id security_id episode_distance_days")


@query("tb26_split_audit", "SELECT * FROM y_audit", **_AUDIT)
def _(v):
    return audit(v)


@query("dq12_split_price_check", "SELECT s.act_symbol, s.ex_date, s.to_factor, s.for_factor, s.to_factor / s.for_factor AS stated_ratio, p.previous_trading_date, p.previous_close, p.close AS event_close, p.close / p.previous_close AS raw_price_ratio, p.close * s.to_factor / s.for_factor / p.previous_close - 1 AS implied_return FROM splits s LEFT JOIN y_lag p ON p.act_symbol = s.act_symbol AND p.date = s.ex_date", doubles=_AUDIT["doubles"])
def _(v):
    return A.split_price_check(v.symbol_bars, v.splits)


@query("dq12_shifted_split_check", """SELECT c.*, p.previous_trading_date, p.previous_close, p.close AS event_close, p.close * c.stated_ratio / p.previous_close - 1 AS implied_return, candidate_trading_date - source_ex_date AS calendar_days_shift FROM
    (SELECT s.act_symbol, s.source_ex_date, s.stated_ratio, min(p.date) AS candidate_trading_date FROM y_audit s JOIN symbol_bars p ON p.act_symbol = s.act_symbol AND p.date - s.source_ex_date BETWEEN 0 AND 7 WHERE NOT has_price_on_ex_date GROUP BY ALL) c JOIN y_lag p ON p.act_symbol = c.act_symbol AND p.date = c.candidate_trading_date""",
       doubles="stated_ratio previous_close event_close implied_return", ints="calendar_days_shift")
def _(v):
    return A.shifted_split_check(audit(v), v.symbol_bars)


@query("tb27_split_candidate", "SELECT * FROM y_candidate", **_CAND)
def _(v):
    return A.split_candidates(audit(v), spans(v), owners(v))


@query("tb28_split_external_comparison", """SELECT source_split_row_id, security_id, candidate_ticker_episode_id, episode_mapping_method, episode_distance_days, ticker, source_ex_date, stated_ratio, has_price_on_ex_date, nearby_same_ratio_duplicate, large_implied_return, provider_observation_id, provider_split_date, provider_split_ratio, provider_to_factor, provider_for_factor,
    date_distance_days, ratio_difference, date_matches, ratio_matches, provider_candidates_within_45d, same_ratio_candidates_within_45d, comparison_status FROM y_history WHERE validation_status = 'requires_reconciliation'""",
       doubles="stated_ratio provider_split_ratio ratio_difference", ints="source_split_row_id security_id episode_distance_days date_distance_days provider_candidates_within_45d same_ratio_candidates_within_45d")
def _(v):
    return A.split_external_comparison(candidates(v), provider_splits(v))


@query("tb29_split_full_history_comparison", "SELECT * EXCLUDE (provider_candidates_within_45d, same_ratio_candidates_within_45d) FROM y_history", doubles=_CAND["doubles"] + " provider_split_ratio ratio_difference", ints=_CAND["ints"] + " date_distance_days")
def _(v):
    return history(v)


@query("tb30_split_reconciliation_enriched", """SELECT h.source_split_row_id, h.security_id, h.comparison_status, r.resolution_status AS provider_identity_status, CASE WHEN h.security_id IS NOT NULL THEN h.security_id WHEN r.resolution_status = 'resolved' THEN e.security_id END AS resolved_security_id,
    CASE WHEN h.security_id IS NOT NULL THEN 'existing_security_mapping' WHEN r.resolution_status = 'resolved' AND e.security_id IS NOT NULL THEN 'provider_identity_resolution' WHEN r.resolution_status = 'unresolved' THEN 'provider_identity_ambiguous' ELSE 'unresolved' END AS security_resolution_method
    FROM y_history h LEFT JOIN symbol_resolutions r ON r.ticker = h.ticker AND r.relevant_date = h.provider_split_date LEFT JOIN episode_spans e ON e.act_symbol = h.ticker AND h.provider_split_date BETWEEN e.start_date AND e.end_date WHERE h.validation_status = 'requires_reconciliation'""",
       ints="source_split_row_id security_id resolved_security_id")
def _(v):
    rows = A.split_reconciliation_enriched(A.split_external_comparison(candidates(v), provider_splits(v)), v.symbol_resolutions, spans(v), owners(v))
    return rows.select("source_split_row_id", "security_id", "comparison_status", "provider_identity_status", "resolved_security_id", "security_resolution_method")


@query("tb31_split_event", "SELECT * FROM y_split_event", doubles="split_ratio", ints="security_id source_row_count")
def _(v):
    return A.split_events(history(v)).select("security_id", "ticker", "split_date", "split_ratio", "to_factor", "for_factor", "validation_source", "validation_method", "provider_observation_id", "source_row_count")


@query("tb32_split_factor", "SELECT * FROM y_factor", doubles="daily_split_ratio cumulative_split_multiplier:3 cumulative_log_split_multiplier")
def _(v):
    return A.split_factor(v.priced, events(v), overrides(v))


@query("tb33_split_factor_reconciled", """SELECT f.security_id, f.date, f.daily_split_ratio * COALESCE(b.r, 1) AS daily_split_ratio, exp(f.cumulative_log_split_multiplier + sum(ln(COALESCE(b.r, 1))) OVER w) AS cumulative_split_multiplier, f.cumulative_log_split_multiplier + sum(ln(COALESCE(b.r, 1))) OVER w AS cumulative_log_split_multiplier,
    f.daily_split_ratio AS original_daily_split_ratio, f.cumulative_split_multiplier AS original_cumulative_split_multiplier, COALESCE(b.r, 1.0e0) AS automatic_backfill_ratio, COALESCE(b.r, 1) <> 1 AS has_automatic_split_backfill
    FROM y_factor f LEFT JOIN (SELECT e.security_id, s.split_date, s.to_factor / s.for_factor AS r FROM vendor_splits s JOIN episode_spans e ON e.act_symbol || '.US' = s.provider_symbol) b ON b.security_id = f.security_id AND b.split_date = f.date WINDOW w AS (PARTITION BY f.security_id ORDER BY f.date)""",
       doubles="daily_split_ratio cumulative_split_multiplier:2 cumulative_log_split_multiplier original_daily_split_ratio original_cumulative_split_multiplier:3 automatic_backfill_ratio")
def _(v):
    own = v.episode_spans.select("security_id", F.concat("act_symbol", F.lit(".US")).alias("provider_symbol"))
    backfills = provider_splits(v).join(own, "provider_symbol").select("security_id", "split_date", "split_ratio")
    return A.split_factor_reconciled(factors(v), backfills)


@query("tb34_corporate_action_override", "SELECT * FROM y_override", doubles="override_dividend_amount")
def _(v):
    return overrides(v)


@query("mut10_resolve_seed", "SELECT security_id, ticker, event_date FROM y_override")
def _(v):
    return overrides(v).select("security_id", "ticker", "event_date")


@query("tb35_dividend_candidate", "SELECT * FROM y_dividend", doubles="amount previous_close raw_indicated_dividend_yield")
def _(v):
    return dividend_rows(v)


@query("tb36_same_day_split_dividend", """SELECT d.security_id, d.ticker, d.ex_date, d.amount AS raw_dividend_amount, s.split_ratio, s.to_factor, s.for_factor, s.validation_source AS split_validation_source, s.validation_method AS split_validation_method, p.close AS previous_close, c.close AS event_close, g.cumulative_split_multiplier AS previous_split_multiplier,
    f.cumulative_split_multiplier AS event_split_multiplier, d.amount * s.split_ratio AS dividend_prev_basis_if_post_split_quote, d.amount / p.close AS yield_if_pre_split_quote, d.amount * s.split_ratio / p.close AS yield_if_post_split_quote, 'unresolved' AS dividend_share_basis, 'unresolved' AS event_order
    FROM y_dividend d JOIN y_split_event s ON s.security_id = d.security_id AND s.split_date = d.ex_date JOIN priced p ON p.security_id = d.security_id AND p.date = d.previous_session AND p.research_eligible JOIN priced c ON c.security_id = d.security_id AND c.date = d.ex_date AND c.research_eligible
    JOIN y_factor g ON g.security_id = d.security_id AND g.date = d.previous_session JOIN y_factor f ON f.security_id = d.security_id AND f.date = d.ex_date""",
       doubles="raw_dividend_amount split_ratio previous_close event_close previous_split_multiplier:3 event_split_multiplier:3 dividend_prev_basis_if_post_split_quote yield_if_pre_split_quote yield_if_post_split_quote")
def _(v):
    return A.same_day_split_dividends(v.sessions, dividend_rows(v), events(v), v.priced, factors(v))


@query("tb37_dividend_event", "SELECT * FROM y_dividend_event", doubles="raw_dividend_amount effective_dividend_amount dividend_previous_share_basis daily_split_ratio")
def _(v):
    return A.dividend_events(dividend_rows(v), factors(v), v.sessions, overrides(v), A.dividend_corrections(v.dividend_validation))


@query("tb38_dividend_correction", "SELECT * FROM y_correction", doubles="original_dividend_amount corrected_dividend_amount vendor_adjusted retrospective_adjustment_factor")
def _(v):
    return A.dividend_corrections(v.dividend_validation)


@query("tb39_return_basis", "SELECT security_id, date, close, price_research_eligible, daily_split_ratio, cumulative_split_multiplier, split_normalized_close FROM y_basis", doubles="close daily_split_ratio cumulative_split_multiplier:3 split_normalized_close:1")
def _(v):
    return R.return_basis(v.priced, factors(v)).select("security_id", "date", "close", "price_research_eligible", "daily_split_ratio", "cumulative_split_multiplier", "split_normalized_close")


@query("tb40_daily_return", "SELECT security_id, date, ticker, previous_date, previous_close, dividend_previous_share_basis, dividend_source_rows, eligible_dividend_rows, price_return, gross_total_return, return_status, research_eligible FROM y_return",
       doubles="previous_close dividend_previous_share_basis price_return gross_total_return", ints="dividend_source_rows eligible_dividend_rows")
def _(v):
    rows = R.daily_return(v.sessions, dividend_events(v), R.return_basis(v.priced, factors(v)))
    return rows.select("security_id", "date", "ticker", "previous_date", "previous_close", "dividend_previous_share_basis", "dividend_source_rows", "eligible_dividend_rows", "price_return", "gross_total_return", "return_status", "research_eligible")


_EX = ["security_id", "date", "primary_price_return", "primary_gross_total_return", "provider_raw_return", "provider_adjusted_return", "provider_to_primary_previous_close_ratio", "provider_to_primary_current_close_ratio", "comparison_status"]


@query("tb41_extreme_return_comparison", f"SELECT {', '.join(_EX)} FROM y_extreme", doubles=" ".join(_EX[2:8]))
def _(v):
    return comparison(v).select(*_EX)


@query("tb42_extreme_return_diagnostic", "SELECT security_id, date, diagnostic_class, price_level_diagnostic FROM y_diagnostic")
def _(v):
    return A.extreme_return_diagnostic(comparison(v)).select("security_id", "date", "diagnostic_class", "price_level_diagnostic")


CHECKS["y_price_fix"] = """SELECT DISTINCT security_id, ticker, CASE WHEN en <= 0.01 AND ep > 0.1 THEN previous_date ELSE date END AS correction_date, CASE WHEN en <= 0.01 AND ep > 0.1 THEN 'bad_previous_good_current' ELSE 'good_previous_bad_current' END AS correction_reason FROM (
    SELECT r.security_id, r.ticker, r.date, r.previous_date, abs(n.close / r.close - 1) AS en, abs(b.close / r.previous_close - 1) AS ep FROM y_return r JOIN validation_bars n ON n.ticker = r.ticker AND n.date = r.date JOIN validation_bars b ON b.ticker = r.ticker AND b.date = r.previous_date
    WHERE r.research_eligible AND abs(r.price_return) > 1 AND abs(r.gross_total_return) > 1 AND abs(n.close / b.close - 1) <= 1) p WHERE (en <= 0.01 AND ep > 0.1) OR (ep <= 0.01 AND en > 0.1)"""


@query("tb46_price_correction", "SELECT f.*, v.close, v.volume FROM y_price_fix f JOIN validation_bars v ON v.ticker = f.ticker AND v.date = f.correction_date", doubles="close")
def _(v):
    rows = A.automatic_price_corrections(v.sessions, dividend_events(v), v.priced, factors(v), v.validation_bars)
    return rows.select("security_id", "ticker", "correction_date", "correction_reason", "close", "volume")


@query("tb47_research_return", "SELECT security_id, date, gross_total_return, diagnostic_class, research_quarantine_reason, final_research_eligible FROM y_research", doubles="gross_total_return")
def _(v):
    return R.research_return(returns(v), diagnostics(v)).select("security_id", "date", "gross_total_return", "diagnostic_class", "research_quarantine_reason", "final_research_eligible")


@query("tb48_total_return_index", """SELECT security_id, ticker, date, gross_total_return, final_research_eligible, research_quarantine_reason, diagnostic_class, return_segment_id, CASE WHEN final_research_eligible THEN sum(CASE WHEN final_research_eligible THEN ln(1 + gross_total_return) END) OVER w END AS cumulative_gtr_log,
    CASE WHEN final_research_eligible THEN exp(sum(CASE WHEN final_research_eligible THEN ln(1 + gross_total_return) END) OVER w) END AS gross_total_return_index FROM y_segment WINDOW w AS (PARTITION BY security_id, return_segment_id ORDER BY date)""", doubles="gross_total_return cumulative_gtr_log gross_total_return_index", ints="return_segment_id")
def _(v):
    return R.total_return_index(research(v))
