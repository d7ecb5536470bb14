"""Queries for reference, universe, share and market-cap tables (TB-49 to TB-79, STR-2, MUT-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.catalog.views import CHECKS
from marketspark.plans import reference as R
from marketspark.plans import shares as S

_AGREE = """SELECT security_id, ticker, count(*) AS n, count(DISTINCT instrument_type) AS t, count(DISTINCT exchange) AS e, min(instrument_type) AS kind, min(exchange) AS ex, min(isin) AS isin, bool_or(NOT is_delisted) AS active, bool_or(is_delisted) AS gone FROM s_candidate WHERE candidate_method = '{m}' GROUP BY security_id, ticker"""
_BAND = "CASE WHEN {r} IS NULL THEN 'not_comparable' WHEN {r} BETWEEN 800 AND 1250 THEN 'near_1000x_high' WHEN {r} BETWEEN 0.0008 AND 0.00125 THEN 'near_1000x_low' WHEN {r} BETWEEN 0.8 AND 1.25 THEN 'near_1x' ELSE 'other_ratio' END"
_PIT = """SELECT m.*, p.shares_outstanding AS vendor_pit_shares, p.shares_period_date AS vendor_shares_period_date, CASE WHEN p.shares_period_date IS NULL THEN FALSE ELSE EXISTS (SELECT 1 FROM bar_factors f WHERE f.security_id = m.security_id AND f.date > p.shares_period_date AND f.date <= m.price_date AND abs(f.daily_split_ratio - 1) > 0.000001) END AS intervening_split,
    COALESCE(p.shares_pit_available, FALSE) AS av, COALESCE(p.ticker_identity_ambiguous, FALSE) AS amb FROM {t} m LEFT JOIN s_pit p ON p.security_id = m.security_id AND p.date = m.price_date AND p.ticker = m.ticker"""
_OK = "identity_status = 'candidate_exact_code_name' AND project_security_matches = 1 AND av AND NOT amb AND NOT intervening_split AND vendor_pit_shares > 0"

CHECKS |= {
    "s_span": "SELECT security_id, ticker, min(date) AS first_date, max(date) AS last_date FROM research_rows GROUP BY security_id, ticker",
    "s_candidate": """SELECT t.*, r.* RENAME (code AS provider_code), CASE WHEN upper(r.code) = upper(t.ticker) THEN 'exact_code' ELSE 'canonicalized_code' END AS candidate_method FROM s_span t JOIN reference_symbols r ON upper(r.code) = upper(t.ticker) OR replace(regexp_replace(upper(r.code), '_OLD[0-9]*$', ''), '-', '.') = upper(t.ticker)""",
    "s_fallback": """SELECT * RENAME (act_symbol AS ticker), CASE WHEN is_etf = 1 THEN 'ETF' WHEN security_name LIKE '% preferred stock%' THEN 'Preferred Stock' WHEN security_name LIKE '%- warrants%' THEN 'Warrant' WHEN security_name LIKE '%common stock%' OR security_name LIKE '%ordinary share%' THEN 'Common Stock' END AS inferred_instrument_type
        FROM listed_symbols QUALIFY row_number() OVER (PARTITION BY upper(act_symbol) ORDER BY last_seen DESC, security_name DESC) = 1""",
    "s_exact": _AGREE.format(m="exact_code"), "s_canonical": _AGREE.format(m="canonicalized_code"),
    "s_resolution": """SELECT t.security_id, t.ticker, b.security_name AS bronze_security_name, CASE WHEN m.instrument_type IS NOT NULL THEN m.instrument_type WHEN b.inferred_instrument_type <> 'Common Stock' THEN b.inferred_instrument_type WHEN e.t = 1 THEN e.kind WHEN b.inferred_instrument_type IS NOT NULL THEN b.inferred_instrument_type WHEN c.t = 1 THEN c.kind END AS resolved_instrument_type,
        CASE WHEN e.e = 1 THEN e.ex WHEN b.listing_exchange IS NOT NULL THEN b.listing_exchange WHEN c.e = 1 THEN c.ex END AS resolved_exchange, COALESCE(e.isin, c.isin) AS resolved_isin, COALESCE(e.active, c.active, FALSE) AS has_active_reference, COALESCE(e.gone, c.gone, FALSE) AS has_delisted_reference,
        CASE WHEN m.instrument_type IS NOT NULL THEN 'resolved_manual_override' WHEN b.inferred_instrument_type <> 'Common Stock' THEN 'resolved_bronze_explicit_noncommon' WHEN e.t = 1 THEN 'resolved_vendor_exact' WHEN e.t > 1 THEN 'ambiguous_vendor_exact' WHEN b.inferred_instrument_type IS NOT NULL THEN 'resolved_bronze_symbol'
            WHEN c.t = 1 THEN 'resolved_vendor_canonical' WHEN c.t > 1 THEN 'ambiguous_vendor_canonical' ELSE 'unresolved' END AS reference_resolution_status
        FROM s_span t LEFT JOIN manual_types m ON m.ticker = t.ticker LEFT JOIN s_fallback b ON b.ticker = t.ticker LEFT JOIN s_exact e ON e.security_id = t.security_id AND e.ticker = t.ticker LEFT JOIN s_canonical c ON c.security_id = t.security_id AND c.ticker = t.ticker""",
    "s_universe": """SELECT r.security_id, r.date, r.ticker, x.resolved_instrument_type AS instrument_type, x.resolved_exchange AS exchange, x.resolved_isin AS isin, x.reference_resolution_status, x.has_active_reference, x.has_delisted_reference, COALESCE(x.resolved_instrument_type = 'Common Stock', FALSE) AS common_equity_broad,
        COALESCE(x.resolved_instrument_type = 'Common Stock' AND x.resolved_exchange IN ('NASDAQ', 'NYSE', 'AMEX', 'NYSE MKT'), FALSE) AS common_equity_primary_exchange, r.final_research_eligible AS return_research_eligible, r.final_research_eligible AND common_equity_broad AS primary_research_eligible_broad, r.final_research_eligible AND common_equity_primary_exchange AS primary_research_eligible_exchange
        FROM research_rows r LEFT JOIN s_resolution x USING (security_id, ticker)""",
    "s_pair": """SELECT a.cik, a.security_id AS security_id_a, b.security_id AS security_id_b, greatest(a.first_date, b.first_date) AS overlap_start, least(a.last_date, b.last_date) AS overlap_end FROM (SELECT u.*, i.cik FROM (SELECT security_id, upper(ticker) AS ticker, min(date) AS first_date, max(date) AS last_date FROM s_universe WHERE primary_research_eligible_exchange GROUP BY ALL) u JOIN (SELECT DISTINCT cik, upper(ticker) AS ticker FROM issuer_tickers WHERE cik IS NOT NULL) i USING (ticker)) a
        JOIN (SELECT u.*, i.cik FROM (SELECT security_id, upper(ticker) AS ticker, min(date) AS first_date, max(date) AS last_date FROM s_universe WHERE primary_research_eligible_exchange GROUP BY ALL) u JOIN (SELECT DISTINCT cik, upper(ticker) AS ticker FROM issuer_tickers WHERE cik IS NOT NULL) i USING (ticker)) b ON a.cik = b.cik AND a.security_id < b.security_id AND a.first_date <= b.last_date AND b.first_date <= a.last_date""",
    "s_observed": """SELECT *, 'vendor_balance_sheet' AS shares_source FROM landed_filings WHERE filing_date IS NOT NULL AND period_date <= filing_date AND shares_outstanding > 0 QUALIFY row_number() OVER (PARTITION BY ticker, period_date, filing_date ORDER BY retrieved_at DESC) = 1""",
    "s_effective": "SELECT * FROM s_observed QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY period_date DESC, retrieved_at DESC) = 1",
    "s_identity": "SELECT ticker, count(DISTINCT security_id) AS distinct_security_ids, count(DISTINCT resolved_isin) AS distinct_isins, min(resolved_isin) AS single_candidate_isin, count(DISTINCT resolved_isin) > 1 AS ticker_identity_ambiguous FROM s_resolution WHERE resolved_instrument_type = 'Common Stock' GROUP BY ticker",
    "s_pit": """SELECT d.security_id, d.date, d.ticker, o.provider_symbol, o.period_date AS shares_period_date, o.filing_date AS shares_filing_date, o.shares_outstanding, o.shares_source, d.date - o.filing_date AS shares_age_days, COALESCE(i.distinct_security_ids, 0) AS ticker_security_id_count, COALESCE(i.distinct_isins, 0) AS ticker_isin_count, COALESCE(i.ticker_identity_ambiguous, FALSE) AS ticker_identity_ambiguous,
        CASE WHEN o.filing_date IS NULL THEN 'missing' WHEN d.date - o.filing_date <= 120 THEN 'fresh' WHEN d.date - o.filing_date <= 180 THEN 'acceptable' WHEN d.date - o.filing_date <= 365 THEN 'stale' ELSE 'very_stale' END AS shares_freshness, COALESCE(d.date - o.filing_date <= 365, FALSE) AND NOT COALESCE(i.ticker_identity_ambiguous, FALSE) AS shares_pit_available
        FROM (SELECT * FROM s_universe WHERE primary_research_eligible_exchange) d ASOF LEFT JOIN s_effective o ON o.ticker = d.ticker AND d.date >= o.filing_date LEFT JOIN s_identity i ON i.ticker = d.ticker""",
    "s_ext": """SELECT observation_date, security_code, min(security_name) AS extension_name, min(issuer_code) AS extension_issuer_code, min(timeseries_code) AS extension_timeseries_code, min(shares_today) AS shares_today, min(closing_shares) AS closing_shares, count(*) AS extension_rows, count(DISTINCT security_name) AS extension_name_variants, count(DISTINCT issuer_code) AS extension_issuer_codes, count(DISTINCT timeseries_code) AS extension_timeseries_codes, count(DISTINCT (shares_today, closing_shares)) AS share_variants FROM archive_shares GROUP BY 1, 2""",
    "s_ids": """SELECT observation_date, security_code, min(security_name) AS identifier_name, min(issuer_code) AS identifier_issuer_code, min(timeseries_code) AS identifier_timeseries_code, min(isin) FILTER (WHERE parse_status = 'valid_isin') AS isin, count(*) AS identifier_rows, count(DISTINCT security_name) AS identifier_name_variants, count(DISTINCT isin) FILTER (WHERE parse_status = 'valid_isin') AS distinct_valid_isins, count(DISTINCT issuer_code) AS identifier_issuer_codes,
        count(DISTINCT timeseries_code) AS identifier_timeseries_codes, count(*) FILTER (WHERE parse_status <> 'valid_isin') AS invalid_isin_rows FROM archive_ids GROUP BY 1, 2""",
    "s_id_candidate": """SELECT *, CASE WHEN identifier_rows IS NULL THEN 'no_identifier_code_date' WHEN distinct_valid_isins <> 1 OR invalid_isin_rows > 0 THEN 'invalid_or_conflicting_isin' WHEN share_variants <> 1 OR extension_name_variants <> 1 OR identifier_name_variants <> 1 OR extension_issuer_codes <> 1 OR extension_timeseries_codes <> 1 OR identifier_issuer_codes <> 1 OR identifier_timeseries_codes <> 1 THEN 'conflicting_source_rows'
        WHEN extension_issuer_code <> identifier_issuer_code OR extension_timeseries_code <> identifier_timeseries_code THEN 'source_code_disagreement' WHEN NOT normalized_name_agreement THEN 'name_review' ELSE 'candidate_exact_code_name' END AS identity_status
        FROM (SELECT *, regexp_replace(upper(trim(extension_name)), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(trim(identifier_name)), '[^A-Z0-9]', '', 'g') AS normalized_name_agreement FROM s_ext LEFT JOIN s_ids USING (observation_date, security_code)) p""",
    "s_overlap": """SELECT *, count(*) OVER (PARTITION BY observation_date, security_code) AS project_security_matches FROM (SELECT c.observation_date, c.security_code, c.isin, c.identity_status, c.shares_today, c.closing_shares, u.security_id, u.ticker, u.date AS price_date, p.close AS raw_close
        FROM s_id_candidate c JOIN s_universe u ON u.isin = c.isin AND c.observation_date - u.date BETWEEN 0 AND 7 AND u.primary_research_eligible_exchange JOIN bars p ON p.security_id = u.security_id AND p.date = u.date WHERE c.identity_status IN ('candidate_exact_code_name', 'name_review')
        QUALIFY row_number() OVER (PARTITION BY c.observation_date, c.security_code, u.security_id ORDER BY u.date DESC) = 1) x""",
    "s_discrepancy": f"SELECT *, {_BAND.format(r='today_to_vendor_ratio')} AS today_scale_band, {_BAND.format(r='closing_to_vendor_ratio')} AS closing_scale_band FROM (SELECT *, {_OK} AS comparable, CASE WHEN {_OK} THEN shares_today / vendor_pit_shares END AS today_to_vendor_ratio, CASE WHEN {_OK} THEN closing_shares / vendor_pit_shares END AS closing_to_vendor_ratio FROM ({_PIT.format(t='s_overlap')}) a) b",
    "s_overlap_source": """SELECT o.observation_date, o.security_code, o.isin, o.security_id, o.ticker, o.price_date, o.identity_status, o.project_security_matches, s.* EXCLUDE (observation_date, security_code, isin) FROM s_overlap o LEFT JOIN (SELECT observation_date, security_code, isin, count(*) AS source_rows, count(DISTINCT closing_shares) AS closing_share_variants, count(DISTINCT shares_today) AS today_share_variants, min(closing_shares) AS snapshot_closing_shares, min(shares_today) AS snapshot_shares_today FROM archive_ids GROUP BY 1, 2, 3) s USING (observation_date, security_code, isin)""",
    "s_overlap_audit": f"SELECT *, {_OK} AS comparable, CASE WHEN {_OK} AND closing_share_variants = 1 THEN snapshot_closing_shares / vendor_pit_shares END AS closing_to_vendor_ratio, CASE WHEN {_OK} AND today_share_variants = 1 THEN snapshot_shares_today / vendor_pit_shares END AS today_to_vendor_ratio FROM ({_PIT.format(t='s_overlap_source')}) a",
    "s_implied": """SELECT *, price_lag: observation_date - price_date, CASE WHEN distinct_cap_values > 1 THEN 'conflicting_source_caps' WHEN matched_security_count > 1 THEN 'ambiguous_security_id' ELSE 'candidate_usd_millions_assumed' END AS candidate_status, CASE WHEN distinct_cap_values = 1 AND matched_security_count = 1 THEN mktcap_as_supplied * 1e6 / raw_close END AS implied_shares FROM (
        SELECT *, count(*) OVER (PARTITION BY source_sha256, observation_date, isin) AS matched_security_count FROM (SELECT s.*, u.security_id, u.ticker, u.date AS price_date, p.close AS raw_close FROM (SELECT source_sha256, observation_date, isin, min(source_row_number) AS source_row_number, min(mktcap_as_supplied) AS mktcap_as_supplied, count(*) AS source_rows, count(DISTINCT mktcap_as_supplied) AS distinct_cap_values FROM archive_caps WHERE parse_status = 'valid_isin' GROUP BY 1, 2, 3) s
        JOIN s_universe u ON u.isin = s.isin AND s.observation_date - u.date BETWEEN 0 AND 7 AND u.primary_research_eligible_exchange JOIN bars p ON p.security_id = u.security_id AND p.date = u.date QUALIFY row_number() OVER (PARTITION BY s.observation_date, s.isin, u.security_id ORDER BY u.date DESC) = 1) l) m""".replace("price_lag: observation_date - price_date", "observation_date - price_date AS price_lag_days"),
    "s_snapshot": """SELECT s.*, f.cumulative_split_multiplier AS anchor_split_multiplier FROM (SELECT *, count(*) OVER (PARTITION BY security_id, observation_date) AS same FROM (SELECT 'first' AS family, * FROM s_overlap_audit UNION ALL SELECT 'second', * FROM s_overlap_audit WHERE today_share_variants > 1) u) s
        LEFT JOIN bar_factors f ON f.security_id = s.security_id AND f.date = s.price_date WHERE identity_status = 'candidate_exact_code_name' AND project_security_matches = 1 AND closing_share_variants = 1 AND same = 1""",
    "s_calibration": """SELECT *, CASE WHEN retrospective_hits >= 2 AND contemporaneous_hits = 0 AND conflicting_hits = 0 THEN 'retrospective_confirmed' WHEN contemporaneous_hits >= 2 AND retrospective_hits = 0 AND conflicting_hits = 0 THEN 'contemporaneous_confirmed' WHEN conflicting_hits > 0 THEN 'cross_source_conflict' ELSE 'unverified' END AS calibration_status FROM (
        SELECT security_id, count(*) AS comparable_snapshots, count(*) FILTER (WHERE (l >= 1.5 OR l <= 1 / 1.5) AND abs(ln(r / l)) <= ln(1.25)) AS retrospective_hits, count(*) FILTER (WHERE (l >= 1.5 OR l <= 1 / 1.5) AND abs(ln(r)) <= ln(1.25)) AS contemporaneous_hits, count(*) FILTER (WHERE abs(ln(r)) > ln(1.5) AND abs(ln(r / l)) > ln(1.5)) AS conflicting_hits
        FROM (SELECT s.security_id, o.shares_outstanding / s.snapshot_closing_shares AS r, f.cumulative_split_multiplier / s.anchor_split_multiplier AS l FROM s_snapshot s ASOF LEFT JOIN s_effective o ON o.ticker = s.ticker AND s.observation_date >= o.filing_date ASOF LEFT JOIN bar_factors f ON f.security_id = s.security_id AND CAST(o.retrieved_at AS DATE) >= f.date
            WHERE o.shares_outstanding > 0 AND s.observation_date - o.filing_date BETWEEN 0 AND 365 AND f.cumulative_split_multiplier > 0) e GROUP BY security_id) c""",
    "s_base": """SELECT px.security_id, px.date, px.ticker, px.close, o.shares_outstanding AS vendor_filed_shares, o.provider_symbol AS vendor_provider_symbol, o.currency_symbol AS cur, o.filing_date AS shares_filing_date, o.period_date AS shares_period_date, px.date - o.filing_date AS shares_age_days, COALESCE(i.ticker_identity_ambiguous, FALSE) AS amb, f.cumulative_split_multiplier AS cm, COALESCE(fp.cumulative_split_multiplier, 1) AS pm, ef.cumulative_split_multiplier AS fm, bc.calibration_status AS cal,
        r.bronze_security_name AS nm, r.resolved_exchange AS ex, px.security_id IN (SELECT security_id_a FROM s_pair UNION SELECT security_id_b FROM s_pair) AS multi, m.sourced_shares AS ms, m.source_publication_date AS mp, px.research_eligible AS price_research_eligible,
        EXISTS (SELECT 1 FROM manual_shares b WHERE b.security_id = px.security_id AND b.target_provider_symbol = o.provider_symbol AND b.target_period_date = o.period_date AND b.target_filing_date = o.filing_date AND b.target_shares = o.shares_outstanding) AS bad, s.observation_date AS snapshot_date, s.price_date AS ap, s.snapshot_closing_shares AS ss, s.anchor_split_multiplier AS am
        FROM priced px ASOF LEFT JOIN s_effective o ON o.ticker = px.ticker AND px.date >= o.filing_date LEFT JOIN manual_shares m ON m.security_id = px.security_id AND m.price_date = px.date LEFT JOIN s_identity i ON i.ticker = px.ticker LEFT JOIN bar_factors f ON f.security_id = px.security_id AND f.date = px.date ASOF LEFT JOIN bar_factors fp ON fp.security_id = px.security_id AND o.period_date >= fp.date
        ASOF LEFT JOIN bar_factors ef ON ef.security_id = px.security_id AND CAST(o.retrieved_at AS DATE) >= ef.date LEFT JOIN s_calibration bc ON bc.security_id = px.security_id LEFT JOIN s_resolution r ON r.security_id = px.security_id AND r.ticker = px.ticker ASOF LEFT JOIN s_snapshot s ON s.security_id = px.security_id AND px.date >= s.observation_date""",
    "s_class": """SELECT *, COALESCE(date - snapshot_date BETWEEN 0 AND 365 AND ap <= date AND cm > 0 AND am > 0, FALSE) AS snap_ok, COALESCE(shares_age_days BETWEEN 0 AND 365 AND NOT amb, FALSE) AS vend_ok, COALESCE(ms > 0 AND date - mp BETWEEN 0 AND 365, FALSE) AS man_ok,
        CASE WHEN vendor_filed_shares IS NULL THEN 'no_source_count' WHEN shares_filing_date <= shares_period_date THEN 'publication_date_unverified' WHEN multi THEN 'multi_issue_issuer_total' WHEN contains(upper(COALESCE(nm, '')), 'DEPOSITARY') OR (ex IN ('NYSE', 'NASDAQ') AND cur <> 'USD') THEN 'quote_share_unit_unverified' WHEN cal = 'cross_source_conflict' THEN 'cross_source_conflict'
            WHEN fm IS NULL OR cm IS NULL THEN 'missing_split_factor' WHEN abs(ln(fm / pm)) <= ln(1.01) THEN 'no_later_recorded_split' WHEN cal IN ('retrospective_confirmed', 'contemporaneous_confirmed') THEN cal ELSE 'split_basis_unverified' END AS vendor_basis_status FROM s_base""",
    "s_norm": """SELECT *, CASE vendor_basis_status WHEN 'retrospective_confirmed' THEN vendor_filed_shares * cm / fm WHEN 'contemporaneous_confirmed' THEN vendor_filed_shares * cm / pm WHEN 'no_later_recorded_split' THEN vendor_filed_shares END AS vendor_normalized_shares, vend_ok AND vendor_basis_status IN ('retrospective_confirmed', 'contemporaneous_confirmed', 'no_later_recorded_split') AND NOT bad AS eligible FROM s_class""",
    "s_cap": """SELECT *, close * selected_shares_candidate AS market_cap_candidate FROM (SELECT *, CASE WHEN snap_ok THEN ss * cm / am END AS snapshot_current_shares_candidate, CASE WHEN man_ok THEN ms END AS manual_current_shares_candidate, CASE WHEN eligible THEN vendor_normalized_shares END AS vendor_current_shares_candidate,
        CASE WHEN snap_ok THEN 'snapshot' WHEN man_ok THEN 'manual_sourced' WHEN eligible THEN 'vendor' ELSE 'no_eligible_share_source' END AS selected_source, CASE WHEN snap_ok THEN ss * cm / am WHEN man_ok THEN ms WHEN eligible THEN vendor_normalized_shares END AS selected_shares_candidate FROM s_norm) c""",
    "s_fact": """SELECT security_id, ticker, vendor_provider_symbol, shares_period_date, shares_filing_date, vendor_filed_shares, min(date) AS first_price_date, min(date) FILTER (WHERE vendor_current_shares_candidate > 0) AS first_eligible_date, arg_min(vendor_current_shares_candidate, date) FILTER (WHERE vendor_current_shares_candidate > 0) AS first_eligible_shares,
        arg_min(cm, date) FILTER (WHERE vendor_current_shares_candidate > 0) AS first_eligible_factor, bool_or(bad) AS invalidated, count(*) AS priced_days, count(*) FILTER (WHERE selected_source = 'vendor') AS selected_days FROM s_cap WHERE vendor_filed_shares > 0 GROUP BY 1, 2, 3, 4, 5, 6""",
    "s_order": "SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY shares_filing_date, shares_period_date, vendor_provider_symbol, vendor_filed_shares) AS i FROM s_fact",
    "s_walk": """SELECT security_id, i, CASE WHEN invalidated OR first_eligible_shares IS NULL THEN 'not_eligible' ELSE 'no_prior_eligible_observation' END AS guard_status, CAST(NULL AS DOUBLE) AS ratio, CAST(NULL AS DATE) AS pf, CAST(NULL AS DOUBLE) AS ps, CAST(NULL AS DOUBLE) AS pfac,
            CASE WHEN NOT invalidated THEN CASE WHEN first_eligible_shares IS NOT NULL THEN shares_filing_date END END AS nf, CASE WHEN NOT invalidated THEN first_eligible_shares END AS ns, CASE WHEN NOT invalidated THEN CASE WHEN first_eligible_shares IS NOT NULL THEN first_eligible_factor END END AS nfac FROM s_order WHERE i = 1
        UNION ALL SELECT o.security_id, o.i, t.st, CASE WHEN t.st IN ('accepted', 'quarantined_100x_up') THEN o.first_eligible_shares / w.ns END, w.nf, w.ns, w.nfac, CASE WHEN t.st IN ('accepted', 'no_prior_eligible_observation', 'split_boundary_unchecked') THEN o.shares_filing_date ELSE w.nf END,
            CASE WHEN t.st IN ('accepted', 'no_prior_eligible_observation', 'split_boundary_unchecked') THEN o.first_eligible_shares ELSE w.ns END, CASE WHEN t.st IN ('accepted', 'no_prior_eligible_observation', 'split_boundary_unchecked') THEN o.first_eligible_factor ELSE w.nfac END
        FROM s_walk w JOIN s_order o ON o.security_id = w.security_id AND o.i = w.i + 1, LATERAL (SELECT CASE WHEN o.invalidated OR o.first_eligible_shares IS NULL THEN 'not_eligible' WHEN w.ns IS NULL THEN 'no_prior_eligible_observation' WHEN abs(o.first_eligible_factor / w.nfac - 1) > 0.01 THEN 'split_boundary_unchecked' WHEN o.first_eligible_shares / w.ns >= 100 THEN 'quarantined_100x_up' ELSE 'accepted' END AS st) t""",
    "s_guard": "SELECT o.* EXCLUDE (i), w.guard_status, w.ratio AS ratio_to_last_accepted, w.pf AS prior_accepted_filing_date, w.ps AS prior_accepted_shares, w.pfac AS prior_accepted_factor FROM s_order o JOIN s_walk w USING (security_id, i)",
    "s_impact": """SELECT *, CASE WHEN dry_run_shares > 0 THEN dry_run_shares * close END AS dry_run_cap FROM (SELECT c.security_id, c.date, c.ticker, c.close, c.market_cap_candidate AS original_cap, c.selected_shares_candidate AS original_shares, g.shares_filing_date, g.vendor_filed_shares, g.ratio_to_last_accepted, g.prior_accepted_filing_date,
        CASE WHEN c.date - g.prior_accepted_filing_date BETWEEN 0 AND 365 AND abs(c.cm / g.prior_accepted_factor - 1) <= 0.01 THEN g.prior_accepted_shares END AS dry_run_shares, g.shares_period_date AS period FROM s_cap c JOIN s_guard g ON g.guard_status = 'quarantined_100x_up' AND g.security_id = c.security_id AND g.ticker = c.ticker AND g.shares_period_date = c.shares_period_date AND g.shares_filing_date = c.shares_filing_date AND g.vendor_filed_shares = c.vendor_filed_shares WHERE c.selected_source = 'vendor') i""",
    "s_guarded": """SELECT c.* REPLACE (CASE WHEN i.date IS NULL THEN c.selected_source WHEN i.dry_run_shares > 0 THEN 'vendor_guard_carry' ELSE 'no_eligible_share_source' END AS selected_source, CASE WHEN i.date IS NULL THEN c.selected_shares_candidate ELSE i.dry_run_shares END AS selected_shares_candidate, CASE WHEN i.date IS NULL THEN c.market_cap_candidate ELSE i.dry_run_cap END AS market_cap_candidate,
        CASE WHEN i.date IS NULL THEN c.vendor_current_shares_candidate END AS vendor_current_shares_candidate), CASE WHEN i.date IS NOT NULL THEN 'quarantined_100x_up' END AS vendor_guard_status FROM s_cap c LEFT JOIN s_impact i ON i.security_id = c.security_id AND i.date = c.date""",
    "s_seen": """SELECT security_id, vendor_provider_symbol, shares_period_date, shares_filing_date, vendor_filed_shares, count(*) AS priced_days, count(*) FILTER (WHERE selected_source = 'vendor') AS selected_days, max(market_cap_candidate) FILTER (WHERE selected_source = 'vendor') AS max_selected_cap, max(close * vendor_filed_shares) AS max_raw_cap, median(vendor_normalized_shares / cm) AS share_basis_proxy,
        bool_or(vendor_basis_status IN ('retrospective_confirmed', 'contemporaneous_confirmed', 'no_later_recorded_split')) AS basis, max(abs(ln(vendor_normalized_shares / snapshot_current_shares_candidate))) AS ls, max(abs(ln(vendor_normalized_shares / manual_current_shares_candidate))) AS lm FROM s_guarded WHERE vendor_filed_shares > 0 GROUP BY 1, 2, 3, 4, 5""",
    "s_level": "SELECT *, ln(share_basis_proxy) AS x, median(ln(share_basis_proxy)) OVER (PARTITION BY security_id) AS m, count(*) OVER (PARTITION BY security_id) AS n, lag(share_basis_proxy) OVER (PARTITION BY security_id ORDER BY shares_filing_date, shares_period_date, vendor_provider_symbol, vendor_filed_shares) AS b FROM s_seen",
    "s_scored": "SELECT *, CASE WHEN n >= 4 AND share_basis_proxy > 0 THEN 0.67448975 * abs(x - m) / greatest(COALESCE(mad, 0), ln(1.05)) END AS robust_z, abs(x - m) AS md, CASE WHEN b > 0 THEN abs(ln(share_basis_proxy / b)) END AS adj, CASE WHEN ls IS NULL THEN lm WHEN lm IS NULL THEN ls ELSE greatest(ls, lm) END AS cx FROM (SELECT *, median(abs(x - m)) OVER (PARTITION BY security_id) AS mad FROM s_level) d",
    "s_anomaly": """SELECT *, CASE WHEN cx >= ln(10) THEN 'cross_source_10x' WHEN basis AND adj >= ln(10) THEN 'adjacent_10x' WHEN basis AND robust_z >= 8 AND md >= ln(1.5) THEN 'robust_z_8' WHEN cx >= ln(2) THEN 'cross_source_2x' WHEN basis AND adj >= ln(2) THEN 'adjacent_2x' WHEN basis AND robust_z >= 5 AND md >= ln(1.5) THEN 'robust_z_5' WHEN max_selected_cap >= 500000000000 AND ls IS NULL AND lm IS NULL THEN 'large_cap_unverified' ELSE 'no_flag' END AS review_reason FROM s_scored""",
}


def candidates(v):
    return v.keep("ref_candidates", lambda: R.ticker_candidates(v.research_rows, v.reference_symbols))


def resolution(v):
    return v.keep("resolution", lambda: R.ticker_reference_resolution(v.research_rows, v.manual_types, candidates(v), R.symbol_fallback(v.listed_symbols)))


def universe(v):
    return v.keep("universe", lambda: R.research_universe(v.research_rows, resolution(v)))


def members(v):
    return v.keep("members", lambda: R.eligible_universe(v.research_rows, resolution(v)))


def pairs(v):
    return R.multi_listed_pairs(members(v), v.issuer_tickers)


def effective(v):
    return v.keep("effective", lambda: S.effective_shares(S.share_observations(v.landed_filings)))


def identity(v):
    return S.ticker_identity_diagnostic(resolution(v))


def pit(v):
    return v.keep("pit", lambda: S.daily_pit_shares(members(v), effective(v), identity(v)))


def identities(v):
    return v.keep("identities", lambda: S.identity_candidates(v.archive_shares, v.archive_ids))


def overlap(v):
    return v.keep("overlap", lambda: S.priced_overlap(identities(v), members(v), v.bars))


def factors(v):
    return v.bar_factors


def overlap_audit(v):
    return v.keep("overlap_audit", lambda: S.share_overlap_audit(v.archive_ids, overlap(v), pit(v), factors(v)))


def single_audit(v):
    """The overlap audit around codes that match one security: all that a snapshot can come from."""
    single = v.keep("single_overlap", lambda: S.priced_overlap(identities(v), members(v), v.bars, around_single=True))
    return v.keep("single_audit", lambda: S.share_overlap_audit(v.archive_ids, single, pit(v), factors(v)))


def snapshots(v):
    audit = single_audit(v)
    return v.keep("snapshots", lambda: S.preferred_snapshots({"first": audit, "second": audit.where("today_share_variants > 1")}, factors(v)))


def calibration(v):
    return S.basis_calibration(snapshots(v), effective(v), factors(v))


def caps(v):
    """Market caps, equal rows kept once with their number: a day of a shared ticker may have a row per sourced count of each other one."""
    listed = v.keep("listed", lambda: R.multi_listed_securities(members(v), v.issuer_tickers))
    return v.keep("caps", lambda: S.counted_market_cap(v.priced, effective(v), v.manual_shares, identity(v), factors(v), calibration(v), resolution(v), listed, snapshots(v)))


def guard(v):
    return v.keep("guard", lambda: S.guard_observations(caps(v)))


def impact(v):
    return v.keep("impact", lambda: S.guard_impact(caps(v), guard(v)))


def guarded(v):
    return v.keep("guarded", lambda: S.apply_guard(caps(v), impact(v)))


@query("tb49_reference_candidate", "SELECT * FROM s_candidate")
def _(v):
    return R.reference_candidates(v.research_rows, v.reference_symbols)


@query("tb50_symbol_fallback", "SELECT * FROM s_fallback")
def _(v):
    return R.symbol_fallback(v.listed_symbols)


_RES = ["security_id", "ticker", "bronze_security_name", "resolved_instrument_type", "resolved_exchange", "resolved_isin", "has_active_reference", "has_delisted_reference", "reference_resolution_status"]


@query("tb51_ticker_reference_resolution", f"SELECT {', '.join(_RES)} FROM s_resolution")
def _(v):
    return R.ticker_reference_resolution(v.research_rows, v.manual_types, candidates(v), R.symbol_fallback(v.listed_symbols)).select(*_RES)


@query("tb52_security_reference_resolution", """SELECT security_id, count(*) AS observed_tickers, count(resolved_instrument_type) AS resolved_tickers, count(*) - count(resolved_instrument_type) AS unresolved_tickers, count(DISTINCT resolved_instrument_type) AS distinct_resolved_types, min(resolved_instrument_type) AS candidate_security_type,
    CASE WHEN count(DISTINCT resolved_instrument_type) = 1 THEN min(resolved_instrument_type) END AS resolved_security_type, CASE WHEN count(DISTINCT resolved_instrument_type) > 1 THEN 'ticker_history_type_conflict' WHEN count(resolved_instrument_type) = 0 THEN 'unresolved' WHEN count(*) = count(resolved_instrument_type) THEN 'resolved_all_tickers_consistent' ELSE 'partially_resolved_consistent' END AS security_reference_status
    FROM (SELECT s_nationkey AS security_id, resolved_instrument_type FROM s_resolution JOIN supplier ON s_suppkey = security_id) r GROUP BY security_id""", ints="observed_tickers resolved_tickers unresolved_tickers distinct_resolved_types")
def _(v):
    # tickers of one nation as the history of one security
    merged = resolution(v).join(v.supplier, F.col("s_suppkey") == F.col("security_id")).withColumn("security_id", F.col("s_nationkey"))
    return R.security_reference_resolution(merged)


@query("tb53_research_universe", "SELECT * FROM s_universe")
def _(v):
    return R.research_universe(v.research_rows, resolution(v))


@query("tb54_symbol_search", r"""SELECT query_ticker, result_rank, result_code, body AS parsed_ticker_body, m AS match_rank, CASE m WHEN 1 THEN 'parsed_body_exact_match' WHEN 2 THEN 'punctuation_normalized_match' ELSE 'no_usable_search_match' END AS resolution_status FROM (SELECT *, CASE WHEN body = upper(query_ticker) THEN 1 WHEN regexp_replace(body, '[^A-Z0-9]', '', 'g') = regexp_replace(upper(query_ticker), '[^A-Z0-9]', '', 'g') THEN 2 ELSE 99 END AS m
    FROM (SELECT *, regexp_replace(upper(result_code), '\.US$', '') AS body FROM search_results) p) r QUALIFY row_number() OVER (PARTITION BY query_ticker ORDER BY m, result_rank) = 1""", ints="match_rank result_rank")
def _(v):
    return R.symbol_search_resolution(v.search_results)


@query("tb55_multi_listed_pairs", "SELECT *, overlap_end - overlap_start + 1 AS overlap_calendar_days FROM s_pair", ints="overlap_calendar_days")
def _(v):
    return pairs(v).select("cik", "security_id_a", "security_id_b", "overlap_start", "overlap_end", "overlap_calendar_days")


@query("tb56_share_observation", "SELECT * FROM s_observed", doubles="shares_outstanding:2")
def _(v):
    return S.share_observations(v.landed_filings)


@query("tb56_effective_shares", "SELECT * FROM s_effective", doubles="shares_outstanding:2")
def _(v):
    return S.effective_shares(S.share_observations(v.landed_filings))


@query("tb56_identity_diagnostic", "SELECT * FROM s_identity", ints="distinct_security_ids distinct_isins")
def _(v):
    return identity(v)


@query("tb57_daily_pit_shares", "SELECT * FROM s_pit", doubles="shares_outstanding:2", ints="shares_age_days ticker_security_id_count ticker_isin_count")
def _(v):
    return S.daily_pit_shares(members(v), effective(v), identity(v))


@query("tb59_identity_candidate", "SELECT observation_date, security_code, isin, shares_today, closing_shares, extension_rows, identifier_rows, normalized_name_agreement, identity_status FROM s_id_candidate", ints="extension_rows identifier_rows", doubles="shares_today:2 closing_shares:2")
def _(v):
    rows = S.identity_candidates(v.archive_shares, v.archive_ids)
    return rows.select("observation_date", "security_code", "isin", "shares_today", "closing_shares", "extension_rows", "identifier_rows", "normalized_name_agreement", "identity_status")


@query("tb60_priced_overlap", "SELECT observation_date, security_code, isin, identity_status, security_id, ticker, price_date, raw_close, project_security_matches FROM s_overlap", doubles="raw_close", ints="project_security_matches")
def _(v):
    rows = S.priced_overlap(S.identity_candidates(v.archive_shares, v.archive_ids), members(v), v.bars)
    return rows.select("observation_date", "security_code", "isin", "identity_status", "security_id", "ticker", "price_date", "raw_close", "project_security_matches")


@query("tb61_share_discrepancy", "SELECT observation_date, security_code, security_id, intervening_split, today_to_vendor_ratio, closing_to_vendor_ratio, today_scale_band, closing_scale_band FROM s_discrepancy", doubles="today_to_vendor_ratio closing_to_vendor_ratio")
def _(v):
    rows = S.share_discrepancies(overlap(v), pit(v), factors(v))
    return rows.select("observation_date", "security_code", "security_id", "intervening_split", "today_to_vendor_ratio", "closing_to_vendor_ratio", "today_scale_band", "closing_scale_band")


_OA = ["observation_date", "security_code", "security_id", "source_rows", "closing_share_variants", "today_share_variants", "snapshot_closing_shares", "closing_to_vendor_ratio", "today_to_vendor_ratio"]


@query("tb62_share_overlap_audit", f"SELECT {', '.join(_OA)} FROM s_overlap_audit", ints="source_rows closing_share_variants today_share_variants", doubles="snapshot_closing_shares:2 closing_to_vendor_ratio today_to_vendor_ratio")
def _(v):
    return S.share_overlap_audit(v.archive_ids, overlap(v), pit(v), factors(v)).select(*_OA)


@query("tb62_share_overlap_summary", """SELECT count(*) AS matched_snapshots, count(DISTINCT security_id) AS matched_issues, count(*) FILTER (WHERE snapshot_closing_shares > 0) AS closing_share_rows, count(*) FILTER (WHERE snapshot_shares_today > 0) AS today_share_rows, count(*) FILTER (WHERE vendor_pit_shares > 0 AND av) AS vendor_share_rows, count(*) FILTER (WHERE comparable) AS comparable_basis_rows,
    count(closing_to_vendor_ratio) AS closing_ratios, count(today_to_vendor_ratio) AS today_ratios, count(*) FILTER (WHERE closing_to_vendor_ratio BETWEEN 800 AND 1250) AS closing_near_1000x_high, count(*) FILTER (WHERE closing_to_vendor_ratio BETWEEN 0.0008 AND 0.00125) AS closing_near_1000x_low, count(*) FILTER (WHERE closing_to_vendor_ratio BETWEEN 800000 AND 1250000) AS closing_near_million_high,
    count(*) FILTER (WHERE closing_to_vendor_ratio BETWEEN 0.0000008 AND 0.00000125) AS closing_near_million_low, count(*) FILTER (WHERE closing_to_vendor_ratio BETWEEN 0.8 AND 1.25) AS closing_near_1x, count(*) FILTER (WHERE closing_share_variants > 1) AS conflicting_closing_rows FROM s_overlap_audit""")
def _(v):
    return S.share_overlap_summary(overlap_audit(v))


@query("tb63_implied_shares", "SELECT observation_date, isin, security_id, source_rows, distinct_cap_values, matched_security_count, price_lag_days, candidate_status, implied_shares AS implied_shares_usd_millions_assumed FROM s_implied", ints="source_rows distinct_cap_values matched_security_count price_lag_days", doubles="implied_shares_usd_millions_assumed:3")
def _(v):
    rows = S.implied_shares(v.archive_caps, members(v), v.bars)
    return rows.select("observation_date", "isin", "security_id", "source_rows", "distinct_cap_values", "matched_security_count", "price_lag_days", "candidate_status", "implied_shares_usd_millions_assumed")


@query("tb63_implied_scale_audit", f"SELECT observation_date, isin, security_id, r AS implied_to_vendor_ratio, {_BAND.format(r='r')} AS scale_diagnostic FROM (SELECT i.*, CASE WHEN candidate_status = 'candidate_usd_millions_assumed' AND p.shares_pit_available AND NOT p.ticker_identity_ambiguous THEN implied_shares / p.shares_outstanding END AS r FROM s_implied i LEFT JOIN s_pit p ON p.security_id = i.security_id AND p.date = i.price_date) x", doubles="implied_to_vendor_ratio")
def _(v):
    rows = S.implied_scale_audit(S.implied_shares(v.archive_caps, members(v), v.bars), pit(v))
    return rows.select("observation_date", "isin", "security_id", "implied_to_vendor_ratio", "scale_diagnostic")


@query("tb65_preferred_snapshot", "SELECT family, security_id, observation_date, price_date, security_code, snapshot_closing_shares, anchor_split_multiplier FROM s_snapshot", doubles="snapshot_closing_shares:2 anchor_split_multiplier:3")
def _(v):
    return snapshots(v).select("family", "security_id", "observation_date", "price_date", "security_code", "snapshot_closing_shares", "anchor_split_multiplier")


@query("tb66_basis_calibration", "SELECT * FROM s_calibration", ints="comparable_snapshots retrospective_hits contemporaneous_hits conflicting_hits")
def _(v):
    return calibration(v)


_CAP = ["security_id", "date", "ticker", "snapshot_date", "vendor_filed_shares", "shares_filing_date", "vendor_basis_status", "selected_source", "selected_shares_candidate", "market_cap_candidate"]
_CAPD = dict(doubles="vendor_filed_shares:2 selected_shares_candidate:2 market_cap_candidate:0")


@query("tb67_daily_market_cap", f"SELECT {', '.join(_CAP)} FROM s_cap", **_CAPD)
def _(v):
    return S.repeated(caps(v).select(*_CAP, S.TIMES))


@query("tb67_source_counts", "SELECT selected_source, count(*) AS issue_days, count(DISTINCT security_id) AS issues, count(*) FILTER (WHERE market_cap_candidate > 0) AS priced_issue_days, max(market_cap_candidate) AS largest_cap_candidate FROM s_guarded GROUP BY selected_source", doubles="largest_cap_candidate:0")
def _(v):
    return S.source_counts(guarded(v))


_G = ["security_id", "shares_filing_date", "shares_period_date", "vendor_filed_shares", "first_eligible_date", "first_eligible_shares", "priced_days", "selected_days", "guard_status", "ratio_to_last_accepted", "prior_accepted_filing_date", "prior_accepted_shares"]
_GK = dict(doubles="vendor_filed_shares:2 first_eligible_shares:2 ratio_to_last_accepted:4 prior_accepted_shares:2", ints="priced_days selected_days")


@query("tb68_guard_observation", f"SELECT {', '.join(_G)} FROM s_guard", **_GK)
def _(v):
    return S.guard_observations(caps(v)).select(*_G)


@query("str2_forward_only_guard", f"SELECT {', '.join(_G)} FROM s_guard", **_GK)
def _(v):
    from marketspark.streaming.guard import classify_filings

    return classify_filings(guard(v).drop("guard_status", "ratio_to_last_accepted", "prior_accepted_filing_date", "prior_accepted_shares", "prior_accepted_factor")).select(*_G)


_I = ["security_id", "date", "original_cap", "shares_filing_date", "ratio_to_last_accepted", "dry_run_shares", "dry_run_cap"]


@query("tb69_guard_impact", f"SELECT {', '.join(_I)} FROM s_impact", doubles="original_cap:0 ratio_to_last_accepted:4 dry_run_shares:2 dry_run_cap:0")
def _(v):
    return S.repeated(S.guard_impact(caps(v), guard(v)).select(*_I, S.TIMES))


@query("tb69_apply_guard", f"SELECT {', '.join(_CAP)}, vendor_guard_status FROM s_guarded", **_CAPD)
def _(v):
    return S.repeated(S.apply_guard(caps(v), impact(v)).select(*_CAP, "vendor_guard_status", S.TIMES))


@query("mut4_update_from", "SELECT security_id, date, selected_source, vendor_guard_status FROM s_guarded")
def _(v):
    return S.repeated(S.apply_guard(caps(v), impact(v)).select("security_id", "date", "selected_source", "vendor_guard_status", S.TIMES))


_AN = ["security_id", "shares_filing_date", "shares_period_date", "vendor_filed_shares", "priced_days", "selected_days", "share_basis_proxy", "robust_z", "adjacent_log_ratio", "cross_source_log_ratio", "review_reason"]
_ANS = "SELECT security_id, shares_filing_date, shares_period_date, vendor_filed_shares, priced_days, selected_days, share_basis_proxy, robust_z, adj AS adjacent_log_ratio, cx AS cross_source_log_ratio, review_reason FROM s_anomaly"
_AND = dict(doubles="vendor_filed_shares:2 share_basis_proxy:2 robust_z:4 adjacent_log_ratio cross_source_log_ratio", ints="priced_days selected_days")


@query("tb70_anomaly_audit", _ANS, **_AND)
def _(v):
    return S.anomaly_audit(guarded(v)).select(*_AN)


@query("tb70_anomaly_summary", "SELECT review_reason, count(*) AS observations, count(DISTINCT security_id) AS issues, sum(priced_days) AS priced_days, sum(selected_days) AS selected_days, max(max_selected_cap) AS largest_selected_cap FROM s_anomaly GROUP BY review_reason", ints="priced_days selected_days", doubles="largest_selected_cap:0")
def _(v):
    return S.anomaly_summary(S.anomaly_audit(guarded(v)))


@query("tb70_anomaly_queue", f"""SELECT * FROM (SELECT * FROM ({_ANS}, max_selected_cap AS cap) WHERE review_reason NOT IN ('no_flag', 'large_cap_unverified') AND selected_days > 0 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY cap DESC NULLS LAST, shares_filing_date DESC) = 1 ORDER BY cap DESC NULLS LAST, security_id LIMIT 30) q""".replace("review_reason FROM s_anomaly, max_selected_cap AS cap", "review_reason, max_selected_cap AS cap FROM s_anomaly").replace("SELECT * FROM (SELECT * FROM (", "SELECT * EXCLUDE (cap) FROM (SELECT * FROM (", 1), **_AND)
def _(v):
    return S.anomaly_queue(S.anomaly_audit(guarded(v)), "selected_signal", 30).select(*_AN)


_J = ["security_id", "flagged_filings", "first_flagged_filing", "largest_jump", "selected_days", "carried_days", "uncovered_days", "median_carried_cap", "snapshot_matches_new_days", "snapshot_matches_prior_days", "first_near_prior_after_flag", "research_eligible_days", "peak_reported_weight_bps", "evidence_category"]


@query("tb71_jump_review", """WITH b AS (SELECT * FROM s_guard WHERE guard_status = 'quarantined_100x_up' AND selected_days > 0), f AS (SELECT security_id, count(*) AS flagged_filings, min(shares_filing_date) AS first_flagged_filing, max(ratio_to_last_accepted) AS largest_jump, arg_min(prior_accepted_shares, shares_filing_date) AS ps, arg_min(prior_accepted_factor, shares_filing_date) AS pf FROM b GROUP BY security_id),
    i AS (SELECT security_id, count(*) AS selected_days, count(*) FILTER (WHERE dry_run_shares > 0) AS carried_days, count(*) FILTER (WHERE dry_run_shares IS NULL) AS uncovered_days, median(dry_run_cap) AS median_carried_cap FROM s_impact GROUP BY security_id),
    d AS (SELECT b.security_id, count(*) FILTER (WHERE c.vendor_normalized_shares / c.snapshot_current_shares_candidate BETWEEN 0.5 AND 2) AS sn, count(*) FILTER (WHERE abs(c.cm / b.prior_accepted_factor - 1) <= 0.01 AND b.prior_accepted_shares / c.snapshot_current_shares_candidate BETWEEN 0.5 AND 2) AS sp,
        count(*) FILTER (WHERE c.vendor_normalized_shares / c.manual_current_shares_candidate BETWEEN 0.5 AND 2) AS mn, count(*) FILTER (WHERE abs(c.cm / b.prior_accepted_factor - 1) <= 0.01 AND b.prior_accepted_shares / c.manual_current_shares_candidate BETWEEN 0.5 AND 2) AS mp FROM b JOIN s_guarded c ON c.security_id = b.security_id AND c.shares_filing_date = b.shares_filing_date AND c.shares_period_date = b.shares_period_date AND c.vendor_filed_shares = b.vendor_filed_shares GROUP BY b.security_id),
    l AS (SELECT f.security_id, min(g.shares_filing_date) AS near FROM f JOIN s_guard g ON g.security_id = f.security_id AND g.shares_filing_date > f.first_flagged_filing AND g.guard_status IN ('accepted', 'split_boundary_unchecked') AND abs(g.first_eligible_factor / f.pf - 1) <= 0.01 AND g.first_eligible_shares / f.ps BETWEEN 0.5 AND 2 GROUP BY f.security_id),
    t AS (SELECT date, sum(market_cap_candidate) AS s FROM s_guarded WHERE price_research_eligible AND market_cap_candidate > 0 AND date IN (SELECT date FROM s_impact) GROUP BY date), h AS (SELECT i.*, c.price_research_eligible FROM s_impact i JOIN s_guarded c USING (security_id, date)), w AS (SELECT t.date, t.s + COALESCE((SELECT sum(original_cap - COALESCE(dry_run_cap, 0)) FROM h WHERE h.date = t.date AND price_research_eligible), 0) AS total FROM t),
    m AS (SELECT security_id, count(*) AS research_eligible_days, max(10000 * original_cap / total) AS peak FROM h LEFT JOIN w USING (date) WHERE price_research_eligible GROUP BY security_id)
    SELECT f.security_id, flagged_filings, first_flagged_filing, largest_jump, i.selected_days, carried_days, uncovered_days, median_carried_cap, sn AS snapshot_matches_new_days, sp AS snapshot_matches_prior_days, near AS first_near_prior_after_flag, research_eligible_days, peak AS peak_reported_weight_bps,
    CASE WHEN sp + mp > 0 AND sn + mn = 0 THEN 'independent_supports_prior' WHEN sn + mn > 0 AND sp + mp = 0 THEN 'independent_supports_new' WHEN sp + mp > 0 THEN 'conflicting_independent_evidence' WHEN near IS NOT NULL THEN 'later_vendor_near_prior' WHEN median_carried_cap < 1000000 THEN 'tiny_prior_cap_review' ELSE 'unresolved' END AS evidence_category
    FROM f JOIN i USING (security_id) LEFT JOIN d USING (security_id) LEFT JOIN l USING (security_id) LEFT JOIN m USING (security_id)""",
       ints="flagged_filings selected_days carried_days uncovered_days snapshot_matches_new_days snapshot_matches_prior_days research_eligible_days", doubles="largest_jump:3 median_carried_cap:0 peak_reported_weight_bps:3")
def _(v):
    return S.jump_review(guarded(v), guard(v), impact(v)).select(*_J)


@query("tb72_market_cap_closure", """WITH p AS (SELECT * FROM (SELECT * FROM s_guarded WHERE price_research_eligible AND market_cap_candidate > 0 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY market_cap_candidate DESC, date) = 1) ORDER BY market_cap_candidate DESC, security_id LIMIT 30)
    SELECT p.ticker, p.date, p.security_id, r.bronze_security_name, p.market_cap_candidate / 1e9 AS cap_usd_bn, 1e4 * p.market_cap_candidate / (SELECT sum(market_cap_candidate) FROM s_guarded g WHERE g.date = p.date AND g.price_research_eligible AND g.market_cap_candidate > 0) AS weight_bps, p.selected_source,
    p.selected_shares_candidate / (SELECT median(selected_shares_candidate) FROM s_guarded g WHERE g.security_id = p.security_id AND g.selected_shares_candidate > 0) AS ratio_to_issue_median FROM p LEFT JOIN s_resolution r ON r.security_id = p.security_id AND r.ticker = p.ticker""", doubles="cap_usd_bn:3 weight_bps:2 ratio_to_issue_median:3")
def _(v):
    return S.market_cap_closure(guarded(v), resolution(v), rounded=False).select("ticker", "date", "security_id", "bronze_security_name", "cap_usd_bn", "weight_bps", "selected_source", "ratio_to_issue_median")


@query("tb73_basis_impact", "SELECT vendor_basis_status, count(*) AS issue_days, count(DISTINCT security_id) AS issues, count(*) FILTER (WHERE selected_source = 'vendor') AS selected_vendor_days, max(close * vendor_filed_shares) AS largest_raw_cap FROM s_guarded WHERE vend_ok AND vendor_filed_shares > 0 GROUP BY vendor_basis_status", doubles="largest_raw_cap:0")
def _(v):
    return S.basis_impact(guarded(v))


@query("tb73_vendor_outliers", """SELECT p.date, p.security_id, p.ticker, r.resolved_instrument_type, p.market_cap_candidate FROM (SELECT * FROM (SELECT * FROM s_guarded WHERE selected_source = 'vendor' AND market_cap_candidate > 0 QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY market_cap_candidate DESC, date) = 1) ORDER BY market_cap_candidate DESC, security_id LIMIT 12) p LEFT JOIN s_resolution r ON r.security_id = p.security_id AND r.ticker = p.ticker""", doubles="market_cap_candidate:0")
def _(v):
    return S.top_vendor_outliers(guarded(v), resolution(v)).select("date", "security_id", "ticker", "resolved_instrument_type", "market_cap_candidate")


@query("tb73_known_cases", "SELECT ticker, date, vendor_basis_status, selected_source FROM s_guarded WHERE (security_id, date) IN (SELECT security_id, price_date FROM manual_shares)")
def _(v):
    cases = v.manual_shares.select("security_id", F.col("price_date").alias("date"))
    return S.known_cases(guarded(v), cases).select("ticker", "date", "vendor_basis_status", "selected_source")


CHECKS["s_stage"] = """SELECT p.security_id, p.ticker, p.date AS price_date, s.sourced_shares, s.source_document_id, s.publication_date AS source_publication_date, CASE WHEN o.shares_outstanding >= 100 * s.sourced_shares AND o.provider_symbol = p.ticker || '.US' THEN o.filing_date END AS target_filing_date, CASE WHEN o.shares_outstanding >= 100 * s.sourced_shares THEN o.shares_outstanding END AS target_shares FROM (
    SELECT b.security_id, b.ticker, b.date, s.source_document_id, s.publication_date, s.sourced_shares FROM bars b JOIN share_sources s ON s.security_id = b.security_id AND s.ticker = b.ticker AND b.date >= s.first_price_date AND b.date - s.publication_date <= 365 QUALIFY row_number() OVER (PARTITION BY b.security_id, b.date ORDER BY s.publication_date DESC, s.source_document_id) = 1) s
    JOIN bars p ON p.security_id = s.security_id AND p.date = s.date ASOF LEFT JOIN s_effective o ON o.ticker = p.ticker AND p.date >= o.filing_date"""


@query("tb74_stage_corrections", "SELECT * FROM s_stage", doubles="sourced_shares target_shares:2")
def _(v):
    return S.stage_corrections(v.bars, v.share_sources, effective(v)).select("security_id", "ticker", "price_date", "sourced_shares", "source_document_id", "source_publication_date", "target_filing_date", "target_shares")


@query("tb74_staged_cohorts", "SELECT ticker, source_document_id, sourced_shares, count(*) AS price_days, min(price_date) AS first_day, max(price_date) AS last_day, count(DISTINCT (target_filing_date, target_shares)) FILTER (WHERE target_shares IS NOT NULL) AS targets, count(target_shares) AS flagged_issue_days FROM s_stage GROUP BY 1, 2, 3", doubles="sourced_shares")
def _(v):
    return S.staged_cohorts(S.stage_corrections(v.bars, v.share_sources, effective(v)))


_REQ = "SELECT ticker, status_code AS http_status FROM validation_requests"
CHECKS["s_history"] = "SELECT *, ntile(10) OVER (ORDER BY research_rows, security_id) AS history_decile FROM (SELECT security_id, min(date) AS first_date, max(date) AS last_date, count(*) AS research_rows FROM s_universe WHERE primary_research_eligible_exchange GROUP BY security_id) h"
CHECKS["s_sample"] = "SELECT * FROM s_history QUALIFY row_number() OVER (PARTITION BY history_decile ORDER BY md5(security_id || '|shares-quality-v2'), security_id) <= 20"
CHECKS["s_member"] = "SELECT u.* FROM s_universe u JOIN s_sample s USING (security_id) WHERE u.primary_research_eligible_exchange"
CHECKS["s_quality"] = f"""SELECT s.*, x.* EXCLUDE (security_id), p.* EXCLUDE (security_id), l.m AS median_dollar_volume_proxy FROM s_sample s LEFT JOIN (SELECT t.security_id, count(*) AS historical_tickers, sum(COALESCE(r.n, 0)) AS recorded_requests, bool_or(COALESCE(r.ok, FALSE)) AS http_success, sum(COALESCE(o.n, 0)) AS source_records, sum(COALESCE(o.f, 0)) AS filed_records, sum(COALESCE(o.u, 0)) AS usable_records FROM (SELECT DISTINCT security_id, ticker FROM s_member) t
    LEFT JOIN (SELECT ticker, count(*) AS n, bool_or(http_status = 200) AS ok FROM ({_REQ}) q GROUP BY ticker) r USING (ticker) LEFT JOIN (SELECT ticker, count(*) AS n, count(filing_date) AS f, count(*) FILTER (WHERE shares_outstanding > 0 AND period_date <= filing_date) AS u FROM landed_filings GROUP BY ticker) o USING (ticker) GROUP BY t.security_id) x USING (security_id)
    LEFT JOIN (SELECT m.security_id, count(DISTINCT m.date) FILTER (WHERE p.shares_pit_available) AS pit_covered_rows, bool_or(m.date = s.first_date AND COALESCE(p.shares_pit_available, FALSE)) AS covers_research_start, min(p.shares_filing_date) FILTER (WHERE p.shares_pit_available) AS earliest_usable_filing_date FROM s_member m JOIN s_sample s USING (security_id) LEFT JOIN s_pit p ON p.security_id = m.security_id AND p.date = m.date GROUP BY m.security_id) p USING (security_id)
    LEFT JOIN (SELECT m.security_id, median(b.close * b.volume) AS m FROM s_member m JOIN bars b ON b.security_id = m.security_id AND b.date = m.date WHERE b.volume > 0 GROUP BY m.security_id) l USING (security_id)"""


def quality(v):
    return S.quality_audit(members(v), v.sql(_REQ), v.landed_filings, pit(v), v.bars)


@query("tb78_quality_audit", "SELECT * FROM s_quality", ints="research_rows history_decile historical_tickers recorded_requests source_records filed_records usable_records pit_covered_rows", doubles="median_dollar_volume_proxy:3")
def _(v):
    return quality(v).drop("pit_row_coverage", "filing_date_record_share", "all_records_have_filing_date")


@query("tb78_quality_summary", """SELECT count(*) AS sample_securities, avg(CAST(http_success AS INT)) AS http_success_rate, avg(CAST(usable_records > 0 AS INT)) AS any_usable_source_rate, avg(CAST(covers_research_start AS INT)) AS pit_at_research_start_rate, sum(pit_covered_rows) / sum(research_rows) AS pit_row_coverage_weighted,
    avg(CAST(source_records > 0 AND source_records = filed_records AS INT)) AS all_records_filed_security_rate, sum(filed_records) / sum(source_records) AS filing_date_record_share FROM s_quality""", doubles="http_success_rate any_usable_source_rate pit_at_research_start_rate pit_row_coverage_weighted all_records_filed_security_rate filing_date_record_share")
def _(v):
    return S.quality_summary(quality(v))


@query("tb78_quality_gaps", """WITH f AS (SELECT *, pit_covered_rows / research_rows AS c FROM s_quality), g AS (SELECT 'short_history_at_most_220_rows' AS "group", * FROM f WHERE research_rows <= 220 UNION ALL SELECT 'ended_before_2001', * FROM f WHERE last_date < DATE '2001-11-01' UNION ALL SELECT 'research_start_before_1995', * FROM f WHERE first_date < DATE '1995-01-15'
    UNION ALL SELECT 'lowest_quartile_dollar_volume_proxy', * FROM f WHERE median_dollar_volume_proxy <= (SELECT quantile_cont(median_dollar_volume_proxy, 0.25) FROM f)) SELECT "group", count(*) AS securities, count(*) FILTER (WHERE usable_records = 0) AS no_usable_source, count(*) FILTER (WHERE NOT covers_research_start) AS missing_pit_at_start, median(c) AS median_pit_row_coverage FROM g GROUP BY 1""", doubles="median_pit_row_coverage")
def _(v):
    return S.quality_gaps(v.keep("quality", lambda: quality(v)), 220, "2001-11-01", "1995-01-15")


@query("tb79_coverage_audit", """SELECT s.security_id, s.ticker, COALESCE(q.n, 0) AS quarterly_records, q.a AS earliest_fundamental_date, q.b AS latest_fundamental_date, COALESCE(q.s, 0) AS records_with_shares, COALESCE(q.f, 0) AS records_with_filing_date, COALESCE(q.u, 0) AS usable_records, COALESCE(q.a <= s.first_date, FALSE) AS covers_research_start, COALESCE(q.b >= s.last_date, FALSE) AS covers_research_end FROM s_span s
    LEFT JOIN (SELECT ticker, count(*) AS n, min(period_date) AS a, max(period_date) AS b, count(*) FILTER (WHERE shares_outstanding > 0) AS s, count(filing_date) AS f, count(filing_date) AS u FROM landed_filings GROUP BY ticker) q USING (ticker)""")
def _(v):
    rows = S.coverage_audit(R.ticker_spans(v.research_rows), v.landed_filings.withColumnRenamed("shares_outstanding", "shares"))
    return rows.drop("first_date", "last_date")
