"""Queries for identity and price tables (TB-1 to TB-25, JN-18, MUT-6, MUT-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.catalog.views import CHECKS
from marketspark.functions.scalars import valid_bar
from marketspark.operators.mutate import assign_ids
from marketspark.plans import identity as I
from marketspark.plans import prices as P

CHECKS |= {
    "x_calendar": """SELECT session_date, session_minutes, session_minutes < (SELECT mode(session_minutes) FROM open_sessions) AS is_early_close, 'XTST' AS calendar_code FROM open_sessions""",
    "x_bar": "SELECT date, act_symbol, {'o': open, 'h': high, 'l': low, 'c': close, 'v': volume} AS bar FROM raw_bars",
    "x_day": """SELECT d.date, p.session_date AS before, n.session_date AS after, d.date IN (SELECT session_date FROM open_sessions) AS is_expected_session
        FROM (SELECT DISTINCT date FROM raw_bars) d ASOF LEFT JOIN open_sessions p ON d.date > p.session_date ASOF LEFT JOIN open_sessions n ON d.date < n.session_date""",
    "x_copies": """SELECT b.date, b.act_symbol, d.is_expected_session, list_filter(['previous', 'next'], lambda side: CASE side WHEN 'previous' THEN p.bar = b.bar ELSE n.bar = b.bar END) AS sides
        FROM x_bar b JOIN x_day d USING (date) LEFT JOIN x_bar p ON p.act_symbol = b.act_symbol AND p.date = d.before LEFT JOIN x_bar n ON n.act_symbol = b.act_symbol AND n.date = d.after""",
    "x_quality": """SELECT date, act_symbol, CASE WHEN is_expected_session THEN 'valid_session' ELSE 'closed_session_' || CASE len(sides) WHEN 0 THEN 'anomalous' WHEN 1 THEN 'duplicate_' || sides[1] ELSE 'duplicate_both' END END AS quality_status, is_expected_session
        FROM x_copies""",
    "x_clean": "SELECT b.* FROM raw_bars b JOIN open_sessions c ON c.session_date = b.date",
    "x_boundary": """SELECT DISTINCT act_symbol, effective_date FROM (SELECT from_ticker AS act_symbol, effective_date FROM evidence WHERE same_security UNION ALL SELECT to_ticker, effective_date FROM evidence WHERE same_security) b""",
    "x_assigned": """SELECT o.act_symbol, o.date, 1 + count(b.effective_date) AS n FROM x_clean o LEFT JOIN x_boundary b ON b.act_symbol = o.act_symbol AND b.effective_date <= o.date GROUP BY o.act_symbol, o.date""",
    "x_episode": """SELECT act_symbol || '_E' || lpad(CAST(n AS VARCHAR), 3, '0') AS ticker_episode_id, act_symbol, n AS episode_number, min(date) AS start_date, max(date) AS end_date, count(*) AS n_observations,
        max(gap) AS max_internal_gap_days, count(*) FILTER (WHERE gap > 7) AS gaps_over_7_days, count(*) FILTER (WHERE gap > 30) AS gaps_over_30_days
        FROM (SELECT *, date - lag(date) OVER (PARTITION BY act_symbol, n ORDER BY date) AS gap FROM x_assigned) a GROUP BY act_symbol, n""",
    "x_transition": """SELECT md5(evidence_id || '|' || from_episode_id || '|' || to_episode_id) AS transition_id, *, CASE WHEN days_old_end_to_effective <= 4 AND days_effective_to_new_start = 0 THEN 'observed_transition'
        WHEN days_old_end_to_effective <= 4 THEN 'new_side_gap' WHEN days_effective_to_new_start = 0 THEN 'old_side_gap' ELSE 'both_sides_gap' END AS coverage_diagnostic FROM (
        SELECT e.*, o.ticker_episode_id AS from_episode_id, o.start_date AS from_episode_start, o.end_date AS from_episode_end, n.ticker_episode_id AS to_episode_id, n.start_date AS to_episode_start, n.end_date AS to_episode_end,
            e.effective_date - o.end_date AS days_old_end_to_effective, n.start_date - e.effective_date AS days_effective_to_new_start
        FROM evidence e JOIN x_episode o ON o.act_symbol = e.from_ticker AND o.end_date <= e.effective_date JOIN x_episode n ON n.act_symbol = e.to_ticker AND n.start_date >= e.effective_date WHERE e.same_security
        QUALIFY row_number() OVER (PARTITION BY e.evidence_id ORDER BY abs(o.end_date - e.effective_date) + abs(n.start_date - e.effective_date), o.ticker_episode_id, n.ticker_episode_id) = 1) t""",
    "x_edge": "SELECT from_episode_id AS a, to_episode_id AS b FROM x_transition UNION SELECT to_episode_id, from_episode_id FROM x_transition",
    "x_reach": "SELECT a AS root, a AS node FROM x_edge UNION SELECT r.root, e.b FROM x_reach r JOIN x_edge e ON e.a = r.node",
    "x_component": """SELECT c.component_root, e.* FROM (SELECT node, min(root) AS component_root FROM x_reach GROUP BY node) c JOIN x_episode e ON e.ticker_episode_id = c.node""",
    "x_latest": "SELECT component_root, act_symbol AS latest_ticker FROM x_component QUALIFY row_number() OVER (PARTITION BY component_root ORDER BY end_date DESC, start_date DESC, ticker_episode_id DESC) = 1",
    "x_preview": "SELECT latest_ticker || '_1' AS lineage_code, ticker_episode_id, act_symbol, start_date, end_date, n_observations FROM x_component JOIN x_latest USING (component_root)",
    "x_master": """SELECT row_number() OVER (ORDER BY lineage_code) AS lineage_id, * FROM (SELECT lineage_code, arg_max(act_symbol, (end_date, start_date, ticker_episode_id)) AS latest_ticker, min(start_date) AS first_observed_date, max(end_date) AS last_observed_date FROM x_preview GROUP BY lineage_code) m""",
    "x_member": "SELECT m.lineage_id, p.ticker_episode_id, row_number() OVER (PARTITION BY m.lineage_id ORDER BY p.start_date, p.ticker_episode_id) AS sequence_number FROM x_preview p JOIN x_master m USING (lineage_code)",
    "x_security": """SELECT row_number() OVER (ORDER BY k) AS security_id, * FROM (SELECT 'E|' || ticker_episode_id AS k, 'singleton_episode' AS identity_status, CAST(NULL AS BIGINT) AS lineage_id, start_date AS first_observed_date, end_date AS last_observed_date, ticker_episode_id
        FROM x_episode WHERE ticker_episode_id NOT IN (SELECT ticker_episode_id FROM x_member) UNION ALL SELECT 'L|' || lpad(CAST(lineage_id AS VARCHAR), 19, '0'), 'validated_lineage', lineage_id, first_observed_date, last_observed_date, NULL FROM x_master) s""",
    "x_lineage_bar": """SELECT m.lineage_id, l.lineage_code, e.ticker_episode_id, e.act_symbol, o.date, o.open, o.high, o.low, o.close, o.volume FROM x_member m JOIN x_master l USING (lineage_id) JOIN x_episode e ON e.ticker_episode_id = m.ticker_episode_id
        JOIN x_clean o ON o.act_symbol = e.act_symbol AND o.date BETWEEN e.start_date AND e.end_date""",
    "x_lag": "SELECT *, lag(session_date) OVER (ORDER BY session_date) AS previous_session, lead(session_date) OVER (ORDER BY session_date) AS next_session FROM x_calendar",
    "x_coverage_audit": """SELECT *, CASE WHEN continuity_coverage_pct < 80 THEN 'extreme_low_coverage' WHEN continuity_coverage_pct < 97 THEN 'low_coverage' WHEN continuity_coverage_pct < 99 THEN 'moderate_low_coverage' ELSE 'normal_coverage' END AS coverage_status FROM (
        SELECT c.session_date, c.session_minutes, c.is_early_close, c.previous_session, c.next_session, count(*) AS expected_continuing_tickers, count(d.act_symbol) AS observed_continuing_tickers, count(*) - count(d.act_symbol) AS missing_continuing_tickers, 100.0 * count(d.act_symbol) / count(*) AS continuity_coverage_pct
        FROM x_lag c JOIN x_clean p ON p.date = c.previous_session JOIN x_clean n ON n.date = c.next_session AND n.act_symbol = p.act_symbol LEFT JOIN x_clean d ON d.date = c.session_date AND d.act_symbol = p.act_symbol GROUP BY ALL) m""",
    "x_coverage_ranked": """SELECT *, CASE WHEN continuity_coverage_pct < 80 THEN 'extreme_anomaly' WHEN coverage_percentile <= 0.01 THEN 'very_low_for_session_type' WHEN coverage_percentile <= 0.05 THEN 'low_for_session_type' ELSE 'typical_for_session_type' END AS coverage_diagnostic
        FROM (SELECT *, percent_rank() OVER (PARTITION BY is_early_close ORDER BY continuity_coverage_pct) AS coverage_percentile FROM x_coverage_audit) r""",
    "x_daily_coverage": """SELECT m.lineage_id, m.lineage_code, c.session_date, o.date IS NOT NULL AS observation_present, o.ticker_episode_id, o.act_symbol, o.close, o.volume, CASE WHEN o.date IS NULL THEN 'missing_expected_session' ELSE 'observed' END AS coverage_status
        FROM x_master m JOIN x_calendar c ON c.session_date BETWEEN m.first_observed_date AND m.last_observed_date LEFT JOIN x_lineage_bar o ON o.lineage_id = m.lineage_id AND o.date = c.session_date""",
    "x_queue": """SELECT g.lineage_id, g.lineage_code, g.session_date, p.date AS previous_observation_date, p.ticker_episode_id AS previous_episode_id, p.act_symbol AS previous_ticker, p.close AS previous_close,
        n.date AS next_observation_date, n.ticker_episode_id AS next_episode_id, n.act_symbol AS next_ticker, n.close AS next_close, t.effective_date AS transition_effective_date,
        CASE WHEN p.act_symbol = n.act_symbol THEN p.act_symbol WHEN g.session_date < t.effective_date THEN t.from_ticker WHEN g.session_date >= t.effective_date THEN t.to_ticker END AS candidate_ticker,
        CASE WHEN p.act_symbol = n.act_symbol THEN 'same_ticker_gap' WHEN t.transition_id IS NOT NULL THEN 'validated_transition_gap' ELSE 'unresolved_cross_ticker_gap' END AS gap_type,
        r.is_early_close, r.continuity_coverage_pct, r.coverage_percentile, r.coverage_diagnostic, 'unresolved' AS reconciliation_status
        FROM x_daily_coverage g LEFT JOIN x_lineage_bar p ON p.lineage_id = g.lineage_id AND p.date = (SELECT max(o.date) FROM x_lineage_bar o WHERE o.lineage_id = g.lineage_id AND o.date < g.session_date)
        LEFT JOIN x_lineage_bar n ON n.lineage_id = g.lineage_id AND n.date = (SELECT min(o.date) FROM x_lineage_bar o WHERE o.lineage_id = g.lineage_id AND o.date > g.session_date)
        LEFT JOIN x_transition t ON t.from_episode_id = p.ticker_episode_id AND t.to_episode_id = n.ticker_episode_id LEFT JOIN x_coverage_ranked r ON r.session_date = g.session_date WHERE NOT g.observation_present""",
    "x_candidate": """SELECT q.lineage_id AS current_lineage_id, q.lineage_code AS current_lineage_code, q.session_date, q.candidate_ticker, q.gap_type, o.* EXCLUDE (session_date, lineage_id, lineage_code), o.lineage_id AS bronze_stored_lineage_id, o.lineage_code AS bronze_stored_lineage_code,
        CASE o.lookup_method WHEN 'historical_ticker_lookup' THEN 1 WHEN 'lineage_latest_ticker_fallback' THEN 2 ELSE 9 END AS match_priority, o.provider_symbol = q.candidate_ticker || '.US' AS provider_symbol_matches_candidate,
        concat_ws('|', o.open, o.high, o.low, o.close, o.provider_adjusted_close, o.provider_volume) AS economic_fingerprint, count(*) OVER (PARTITION BY o.observation_id) AS current_match_count
        FROM x_queue q JOIN outside o ON o.session_date = q.session_date AND upper(o.historical_ticker) = upper(q.candidate_ticker)""",
    "x_best": "SELECT * FROM x_candidate QUALIFY match_priority = min(match_priority) OVER (PARTITION BY current_lineage_id, session_date)",
    "x_resolution": """SELECT q.lineage_id AS current_lineage_id, q.lineage_code AS current_lineage_code, q.session_date, q.candidate_ticker, q.gap_type, s.observation_id, s.request_id, s.provider, s.provider_symbol, s.bronze_stored_lineage_id, s.bronze_stored_lineage_code,
        s.historical_ticker, s.lookup_method, s.open, s.high, s.low, s.close, s.provider_adjusted_close, s.provider_volume, s.retrieved_at, s.match_priority,
        COALESCE(a.n, 0) AS all_candidate_count, COALESCE(c.n, 0) AS best_priority_candidate_count, COALESCE(c.o, 0) AS distinct_observation_count, COALESCE(c.v, 0) AS economic_variant_count, COALESCE(c.m, 0) AS max_current_match_count,
        CASE WHEN q.candidate_ticker IS NULL THEN 'no_candidate_ticker' WHEN c.n IS NULL THEN 'no_cached_observation' WHEN c.m > 1 THEN 'ambiguous_observation_maps_multiple_current_lineages' WHEN c.v > 1 THEN 'conflicting_cached_observations' ELSE 'resolved' END AS resolution_status
        FROM x_queue q LEFT JOIN (SELECT current_lineage_id AS i, session_date AS d, count(*) AS n FROM x_candidate GROUP BY ALL) a ON a.i = q.lineage_id AND a.d = q.session_date
        LEFT JOIN (SELECT current_lineage_id AS i, session_date AS d, count(*) AS n, count(DISTINCT observation_id) AS o, count(DISTINCT economic_fingerprint) AS v, max(current_match_count) AS m FROM x_best GROUP BY ALL) c ON c.i = q.lineage_id AND c.d = q.session_date
        LEFT JOIN (SELECT * FROM x_best QUALIFY row_number() OVER (PARTITION BY current_lineage_id, session_date ORDER BY provider_symbol_matches_candidate DESC, retrieved_at DESC, observation_id) = 1) s ON s.current_lineage_id = q.lineage_id AND s.session_date = q.session_date""",
    "x_fill": """SELECT current_lineage_id AS lineage_id, current_lineage_code AS lineage_code, session_date AS date, candidate_ticker AS ticker, open, high, low, close, provider_volume AS volume, 'vendor' AS source, provider_symbol AS source_symbol, lookup_method AS source_lookup_method,
        CASE WHEN flat THEN 'external_zero_volume_observation' WHEN lookup_method = 'lineage_latest_ticker_fallback' THEN 'accepted_external_fill_lineage_fallback' ELSE 'accepted_external_fill' END AS reconciliation_status,
        CASE WHEN flat THEN 'external_zero_volume_bar' ELSE 'external_traded_bar' END AS observation_type, NOT flat AS research_eligible, provider_adjusted_close, retrieved_at, observation_id AS bronze_observation_id, request_id AS bronze_request_id
        FROM (SELECT *, provider_volume = 0 AND open = high AND high = low AND low = close AS flat FROM x_resolution WHERE resolution_status = 'resolved') r""",
    "x_reconciled": """SELECT lineage_id, lineage_code, date, act_symbol AS ticker, open, high, low, close, volume, 'primary' AS source, act_symbol AS source_symbol, 'native' AS source_lookup_method, 'native' AS reconciliation_status, 'native' AS observation_type, TRUE AS research_eligible FROM x_lineage_bar
        UNION ALL SELECT lineage_id, lineage_code, date, ticker, open, high, low, close, volume, source, source_symbol, source_lookup_method, reconciliation_status, observation_type, research_eligible FROM x_fill f WHERE NOT EXISTS (SELECT 1 FROM x_lineage_bar b WHERE b.lineage_id = f.lineage_id AND b.date = f.date)""",
    "x_security_bar": """SELECT s.security_id, s.identity_status, r.* FROM x_reconciled r JOIN x_security s ON s.lineage_id = r.lineage_id
        UNION ALL SELECT s.security_id, s.identity_status, NULL, NULL, o.date, o.act_symbol, o.open, o.high, o.low, o.close, o.volume, 'primary', o.act_symbol, 'native', 'native', 'native', TRUE FROM x_security s JOIN x_episode e ON e.ticker_episode_id = s.ticker_episode_id JOIN x_clean o ON o.act_symbol = e.act_symbol AND o.date BETWEEN e.start_date AND e.end_date""",
}


# --- the same tables through the operators -------------------------------------------------

def calendar(v):
    return v.keep("calendar", lambda: P.trading_calendar(v.open_sessions, "XTST"))


def clean(v):
    return v.keep("clean", lambda: P.clean_ohlcv(v.raw_bars, P.ohlcv_quality(v.raw_bars, calendar(v))))


def episodes(v):
    return v.keep("episodes", lambda: I.ticker_episodes(v.evidence, clean(v)))


def transitions(v):
    return v.keep("transitions", lambda: I.ticker_transitions(v.evidence, episodes(v)))


def components(v):
    return v.keep("components", lambda: I.lineage_components(transitions(v), episodes(v)))


def master(v):
    return v.keep("master", lambda: I.lineage_master(I.lineage_preview(components(v))))


def membership(v):
    return v.keep("membership", lambda: I.lineage_membership(I.lineage_preview(components(v)), master(v)))


def securities(v):
    return I.security_tables(episodes(v), membership(v), master(v))


def lineage_bars(v):
    return v.keep("lineage_bars", lambda: P.lineage_ohlcv(membership(v), master(v), episodes(v), clean(v)))


def ranked(v):
    return v.keep("ranked", lambda: P.session_coverage_ranked(P.session_coverage_audit(calendar(v), clean(v))))


def queue(v):
    return v.keep("queue", lambda: P.missing_price_queue(P.daily_coverage(master(v), calendar(v), lineage_bars(v)), transitions(v), ranked(v)))


def candidates(v):
    return v.keep("candidates", lambda: P.external_price_candidates(queue(v), v.outside))


def resolution(v):
    return v.keep("resolution", lambda: P.external_price_resolution(queue(v), candidates(v)))


def reconciled(v):
    return v.keep("reconciled", lambda: P.reconciled_ohlcv(lineage_bars(v), P.price_reconciliation(resolution(v))))


def security_bars(v):
    def build():
        tables = securities(v)
        return P.security_daily_ohlcv(reconciled(v), tables["security_master"], clean(v), episodes(v), tables["security_episode_membership"])

    return v.keep("security_bars", build)


@query("tb01_trading_calendar", "SELECT * FROM x_calendar")
def _(v):
    return P.trading_calendar(v.open_sessions, "XTST")


@query("tb02_ohlcv_quality", "SELECT * FROM x_quality")
def _(v):
    return P.ohlcv_quality(v.raw_bars, calendar(v))


@query("tb03_clean_ohlcv", "SELECT *, 'valid_session' AS quality_status, 'primary' AS source FROM x_clean", doubles="open high low close")
def _(v):
    return P.clean_ohlcv(v.raw_bars, P.ohlcv_quality(v.raw_bars, calendar(v)))


@query("tb04_ticker_episode", "SELECT * FROM x_episode", ints="episode_number n_observations max_internal_gap_days gaps_over_7_days gaps_over_30_days")
def _(v):
    return I.ticker_episodes(v.evidence, clean(v))


_CHANGES = """SELECT from_ticker AS ticker, CASE WHEN cik < 20 THEN CAST(cik AS VARCHAR(10)) END AS cik, CASE WHEN same_security THEN to_ticker END AS old_ticker, same_security AS flat_file_only FROM evidence"""


@query("tb05_ticker_lineage_evidence", f"""WITH c AS ({_CHANGES}) SELECT md5('feed|ticker_cik_mapping|' || ticker || '|' || COALESCE(cik, '')) AS evidence_id, 'ticker_cik_mapping' AS claim_type, NULL AS from_ticker, ticker AS to_ticker, cik, 'feed' AS source_type, 'changes' AS source_reference, flat_file_only FROM c WHERE cik IS NOT NULL
    UNION ALL SELECT md5('feed|historical_predecessor|' || old_ticker || '|' || ticker || '|' || COALESCE(cik, '')), 'historical_predecessor', old_ticker, ticker, cik, 'feed', 'changes', flat_file_only FROM c WHERE old_ticker IS NOT NULL""")
def _(v):
    return I.ticker_lineage_evidence(v.sql(_CHANGES), "feed", "changes")


@query("tb06_ticker_transition", "SELECT * FROM x_transition", ints="days_old_end_to_effective days_effective_to_new_start")
def _(v):
    return I.ticker_transitions(v.evidence, episodes(v))


@query("jn18_best_interval_pair", "SELECT evidence_id, from_episode_id, to_episode_id FROM x_transition")
def _(v):
    return I.ticker_transitions(v.evidence, episodes(v)).select("evidence_id", "from_episode_id", "to_episode_id")


@query("tb07_transition_evidence", """WITH e AS (SELECT md5('feed|' || from_ticker || '|' || to_ticker || '|' || CAST(effective_date AS VARCHAR)) AS evidence_id, from_ticker, to_ticker, effective_date, 'feed' AS source_type, same_security FROM evidence)
    SELECT evidence_id, from_ticker, to_ticker, effective_date, source_type, CASE WHEN same_security THEN 'reviewed' ELSE 'loaded' END AS validation_method FROM e""")
def _(v):
    rows = v.evidence.select("from_ticker", "to_ticker", "effective_date", F.lit("feed").alias("source_type"), "same_security")
    loaded = I.record_transition_evidence(rows.select("*", F.lit("").alias("evidence_id"), F.lit("").alias("validation_method")).limit(0), rows.withColumn("validation_method", F.lit("loaded")))
    reviewed = rows.where("same_security").withColumn("validation_method", F.lit("reviewed"))
    return I.record_transition_evidence(loaded, reviewed).select("evidence_id", "from_ticker", "to_ticker", "effective_date", "source_type", "validation_method")


@query("tb08_lineage_preview", "SELECT * FROM x_preview", ints="n_observations")
def _(v):
    return I.lineage_preview(components(v))


@query("tb09_lineage_master", "SELECT lineage_id, lineage_code, latest_ticker, first_observed_date, last_observed_date FROM x_master", ints="lineage_id")
def _(v):
    return I.lineage_master(I.lineage_preview(components(v)))


@query("tb09_lineage_membership", "SELECT * FROM x_member", ints="lineage_id sequence_number")
def _(v):
    return I.lineage_membership(I.lineage_preview(components(v)), master(v))


# An earlier state for the reconcile step: every second component is known, and a few share a lineage.
CHECKS["x_known"] = """SELECT dense_rank() OVER (ORDER BY act_symbol) AS lineage_id, ticker_episode_id, 1 AS sequence_number FROM x_component WHERE n_observations > 60"""
CHECKS["x_known_master"] = """SELECT lineage_id, min(split_part(ticker_episode_id, '_E', 1)) || '_2' AS lineage_code, min(split_part(ticker_episode_id, '_E', 1)) AS latest_ticker, DATE '1990-01-01' AS first_observed_date, DATE '1990-01-01' AS last_observed_date FROM x_known GROUP BY lineage_id"""
CHECKS["x_plan"] = """SELECT s.component_root, s.episode_count, l.latest_ticker, s.first_observed_date, s.last_observed_date, k.n AS existing_lineage_count, k.i AS existing_lineage_id, CASE WHEN k.n = 0 THEN 'CREATE_NEW_LINEAGE' WHEN k.n = 1 THEN 'REUSE_EXISTING_LINEAGE' ELSE 'MANUAL_MERGE_REQUIRED' END AS reconciliation_action
    FROM (SELECT component_root, count(*) AS episode_count, min(start_date) AS first_observed_date, max(end_date) AS last_observed_date FROM x_component GROUP BY component_root) s JOIN x_latest l USING (component_root)
    JOIN (SELECT c.component_root, count(DISTINCT m.lineage_id) AS n, min(m.lineage_id) AS i FROM x_component c LEFT JOIN x_known m USING (ticker_episode_id) GROUP BY c.component_root) k USING (component_root)"""


def known(v):
    """Earlier lineages: one per ticker that has a long episode."""
    def build():
        long = components(v).where("n_observations > 60")
        ids = assign_ids(None, long.select("act_symbol").distinct(), ["act_symbol"], "lineage_id")
        return long.join(ids, "act_symbol").select("lineage_id", "ticker_episode_id", F.lit(1).cast("long").alias("sequence_number"), "act_symbol")

    return v.keep("known", build)


def known_master(v):
    day = F.lit("1990-01-01").cast("date")
    return known(v).groupBy("lineage_id").agg(F.min("act_symbol").alias("latest_ticker")).select(
        "lineage_id", F.concat("latest_ticker", F.lit("_2")).alias("lineage_code"), "latest_ticker",
        day.alias("first_observed_date"), day.alias("last_observed_date"))


@query("tb10_reconcile_preview", "SELECT * FROM x_plan", ints="episode_count existing_lineage_count existing_lineage_id")
def _(v):
    return I.reconcile_preview(components(v), known(v))


@query("tb10_reconcile_issues", """SELECT component_root, 'MULTIPLE_EXISTING_LINEAGES' AS issue_type, string_agg(DISTINCT CAST(m.lineage_id AS VARCHAR), ',' ORDER BY lpad(CAST(m.lineage_id AS VARCHAR), 9, '0')) AS existing_lineage_ids
    FROM x_component c JOIN x_known m USING (ticker_episode_id) GROUP BY component_root HAVING count(DISTINCT m.lineage_id) > 1""".replace("string_agg(DISTINCT CAST(m.lineage_id AS VARCHAR), ',' ORDER BY lpad(CAST(m.lineage_id AS VARCHAR), 9, '0'))", "array_to_string(list_sort(list(DISTINCT m.lineage_id)), ',')"))
def _(v):
    return I.reconcile_lineages(components(v), known_master(v), known(v).drop("act_symbol"))["lineage_reconciliation_issue"]


@query("mut7_reconcile_log", """WITH fresh AS (SELECT component_root, latest_ticker, episode_count, row_number() OVER (ORDER BY latest_ticker, component_root) AS k FROM x_plan WHERE existing_lineage_count = 0)
    SELECT component_root, 'CREATE_NEW_LINEAGE' AS action, latest_ticker || '_1' AS lineage_code, episode_count FROM fresh
    UNION ALL SELECT component_root, 'REUSE_EXISTING_LINEAGE', m.lineage_code, episode_count FROM x_plan p JOIN x_known_master m ON m.lineage_id = p.existing_lineage_id WHERE existing_lineage_count = 1""", ints="episode_count")
def _(v):
    log = I.reconcile_lineages(components(v), known_master(v), known(v).drop("act_symbol"))["lineage_reconciliation_log"]
    return log.drop("lineage_id")


@query("tb11_security_master", "SELECT security_id, identity_status, lineage_id, first_observed_date, last_observed_date FROM x_security", ints="security_id")
def _(v):
    return securities(v)["security_master"]


@query("tb11_security_membership", """SELECT security_id, ticker_episode_id, identity_status AS membership_method FROM x_security WHERE ticker_episode_id IS NOT NULL
    UNION ALL SELECT s.security_id, m.ticker_episode_id, 'validated_lineage' FROM x_security s JOIN x_member m ON m.lineage_id = s.lineage_id""", ints="security_id")
def _(v):
    return securities(v)["security_episode_membership"]


@query("mut6_assign_ids", """WITH old AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS id FROM supplier WHERE s_acctbal > 0), top AS (SELECT max(id) AS m FROM old)
    SELECT id, s_name FROM old UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY s_name), s_name FROM supplier WHERE NOT s_acctbal > 0""", ints="id")
def _(v):
    names = v.supplier.select("s_name")
    first = assign_ids(None, v.supplier.where("s_acctbal > 0").select("s_name"), ["s_name"], "id")
    return assign_ids(first, names, ["s_name"], "id")


@query("tb13_lineage_ohlcv", "SELECT * FROM x_lineage_bar", doubles="open high low close", ints="lineage_id")
def _(v):
    return P.lineage_ohlcv(membership(v), master(v), episodes(v), clean(v))


@query("tb14_session_coverage_audit", "SELECT * FROM x_coverage_audit", doubles="continuity_coverage_pct", ints="expected_continuing_tickers observed_continuing_tickers missing_continuing_tickers")
def _(v):
    return P.session_coverage_audit(calendar(v), clean(v))


@query("tb15_session_coverage_ranked", "SELECT session_date, is_early_close, coverage_percentile, coverage_diagnostic FROM x_coverage_ranked", doubles="coverage_percentile")
def _(v):
    audit = P.session_coverage_audit(calendar(v), clean(v))
    return P.session_coverage_ranked(audit).select("session_date", "is_early_close", "coverage_percentile", "coverage_diagnostic")


@query("tb16_daily_coverage", "SELECT * FROM x_daily_coverage", doubles="close", ints="lineage_id")
def _(v):
    return P.daily_coverage(master(v), calendar(v), lineage_bars(v))


@query("tb17_missing_price_queue", "SELECT * FROM x_queue", doubles="previous_close next_close continuity_coverage_pct coverage_percentile", ints="lineage_id")
def _(v):
    return P.missing_price_queue(P.daily_coverage(master(v), calendar(v), lineage_bars(v)), transitions(v), ranked(v))


@query("tb18_external_price_candidate", "SELECT * EXCLUDE (economic_fingerprint) FROM x_candidate", doubles="open high low close provider_adjusted_close", ints="current_lineage_id match_priority current_match_count")
def _(v):
    return P.external_price_candidates(queue(v), v.outside).drop("economic_fingerprint")


@query("tb19_external_price_resolution", "SELECT * FROM x_resolution", doubles="open high low close provider_adjusted_close",
       ints="current_lineage_id match_priority all_candidate_count best_priority_candidate_count distinct_observation_count economic_variant_count max_current_match_count")
def _(v):
    return P.external_price_resolution(queue(v), candidates(v))


@query("tb20_price_reconciliation", "SELECT * FROM x_fill", doubles="open high low close provider_adjusted_close", ints="lineage_id")
def _(v):
    return P.price_reconciliation(resolution(v))


@query("tb21_reconciled_ohlcv", "SELECT * FROM x_reconciled", doubles="open high low close", ints="lineage_id")
def _(v):
    return P.reconciled_ohlcv(lineage_bars(v), P.price_reconciliation(resolution(v)))


@query("tb22_reconciled_daily_coverage", """SELECT m.lineage_id, m.lineage_code, c.session_date, o.date IS NOT NULL AS has_observation, COALESCE(o.e, FALSE) AS has_research_eligible_observation
    FROM x_master m JOIN x_calendar c ON c.session_date BETWEEN m.first_observed_date AND m.last_observed_date LEFT JOIN (SELECT lineage_id, date, bool_or(research_eligible) AS e FROM x_reconciled GROUP BY ALL) o ON o.lineage_id = m.lineage_id AND o.date = c.session_date""", ints="lineage_id")
def _(v):
    return P.reconciled_daily_coverage(master(v), calendar(v), reconciled(v))


_BULK = """SELECT date, ticker, replace(ticker, '#', '-') AS provider_code, close * 0.99 AS open, close * 1.02 AS high, CASE WHEN volume > 90 THEN close * 1.5 ELSE close * 0.98 END AS low, CASE WHEN volume < 8 THEN close * 3 ELSE close END AS close, volume FROM returned_bars"""


@query("tb23_bulk_gap_candidate", f"""WITH provider AS (SELECT *, 0 < low AND low <= least(open, close) AND greatest(open, close) <= high AND volume >= 0 AS bar_valid, count(*) OVER (PARTITION BY date, ticker) AS pn FROM ({_BULK}) b),
    adjacent AS (SELECT d.session_date AS date, p.security_id, p.identity_status, p.lineage_id, p.lineage_code, p.ticker, p.close AS before_close, n.close AS after_close FROM x_lag d JOIN x_security_bar p ON p.date = d.previous_session AND p.research_eligible AND p.close > 0
        JOIN x_security_bar n ON n.date = d.next_session AND n.security_id = p.security_id AND n.ticker = p.ticker AND n.research_eligible AND n.close > 0
        WHERE NOT EXISTS (SELECT 1 FROM x_clean c WHERE c.date = d.session_date AND c.act_symbol = p.ticker) AND NOT EXISTS (SELECT 1 FROM x_security_bar e WHERE e.date = d.session_date AND e.security_id = p.security_id AND e.source_lookup_method IS DISTINCT FROM 'bulk')),
    counted AS (SELECT *, count(*) OVER (PARTITION BY date, ticker) AS idn FROM adjacent)
    SELECT a.security_id, a.identity_status, a.lineage_id, a.lineage_code, a.date, a.ticker, b.open, b.high, b.low, b.close, b.volume, b.provider_code, a.before_close, a.after_close,
    CASE WHEN pn <> 1 THEN 'duplicate_provider_code' WHEN idn <> 1 THEN 'ambiguous_security_identity' WHEN NOT bar_valid THEN 'invalid_provider_bar' WHEN b.close / before_close NOT BETWEEN 0.5 AND 2 OR b.close / after_close NOT BETWEEN 0.5 AND 2 THEN 'price_basis_review' ELSE 'candidate_usable' END AS candidate_status
    FROM counted a JOIN provider b ON b.date = a.date AND b.ticker = a.ticker""", doubles="open high low close before_close after_close", ints="security_id lineage_id")
def _(v):
    from marketspark.operators.joins import session_neighbours

    provider = v.sql(_BULK).withColumn("bar_valid", valid_bar())
    days = session_neighbours(calendar(v)).toDF("date", "before_date", "after_date").dropna()
    return P.bulk_gap_candidates(provider, days, security_bars(v), clean(v), "bulk")


@query("tb24_security_daily_ohlcv", "SELECT * FROM x_security_bar", doubles="open high low close", ints="security_id lineage_id")
def _(v):
    tables = securities(v)
    return P.security_daily_ohlcv(reconciled(v), tables["security_master"], clean(v), episodes(v), tables["security_episode_membership"])


@query("tb25_corrected_ohlcv", """SELECT b.security_id, b.ticker, b.date, COALESCE(c.close * 0.99, b.open) AS open, COALESCE(c.close * 1.02, b.high) AS high, COALESCE(c.close * 0.98, b.low) AS low, COALESCE(c.close, b.close) AS close, COALESCE(c.volume, b.volume) AS volume,
    CASE WHEN c.date IS NULL THEN 'primary' ELSE 'vendor' END AS source, CASE WHEN c.date IS NULL THEN b.ticker ELSE c.ticker || '.US' END AS source_symbol, CASE WHEN c.date IS NULL THEN 'native' ELSE 'automatic_high_confidence_price_correction' END AS source_lookup_method,
    CASE WHEN c.date IS NULL THEN 'native' ELSE 'automatic_price_correction' END AS reconciliation_status FROM bars b LEFT JOIN (SELECT * FROM vendor_bars WHERE volume > 50) c ON c.security_id = b.security_id AND c.date = b.date""", doubles="open high low close")
def _(v):
    prices = v.bars.withColumns({"source": F.lit("primary"), "source_symbol": F.col("ticker"), "source_lookup_method": F.lit("native"), "reconciliation_status": F.lit("native")})
    fixes = v.vendor_bars.where("volume > 50").select("security_id", F.col("date").alias("correction_date"), (F.col("close") * 0.99).alias("open"), (F.col("close") * 1.02).alias("high"),
                                                      (F.col("close") * 0.98).alias("low"), "close", "volume", F.concat("ticker", F.lit(".US")).alias("provider_symbol"))
    return P.corrected_ohlcv(prices, fixes)


@query("tb12_rebuild_identity", """SELECT security_id, ticker_episode_id, identity_status AS membership_method FROM x_security WHERE ticker_episode_id IS NOT NULL
    UNION ALL SELECT s.security_id, m.ticker_episode_id, 'validated_lineage' FROM x_security s JOIN x_member m ON m.lineage_id = s.lineage_id""", ints="security_id")
def _(v):
    return I.rebuild_identity(v.evidence, clean(v))["security_episode_membership"]
