"""Queries for research tables and evaluation (RS-*, PM-*, CS-*, RSI-*, CMP-1, ML-*)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketspark.catalog.registry import query
from marketspark.catalog.views import CHECKS
from marketspark.operators.joins import prev_session_join
from marketspark.plans import crosssection as C
from marketspark.plans import metrics as M
from marketspark.plans import models as L
from marketspark.plans import research as R
from marketspark.plans.returns import total_return_index
from marketspark.session import ensure_checkpoint_dir

TRAIN, VALID = "1998-12-31", "2000-06-30"

# the research inputs of the weekly panel
CHECKS |= {
    "z_return": """SELECT p.security_id, p.ticker, p.date, p.close AS split_normalized_close, p.volume, p.close / q.close - 1 AS gross_total_return, q.close IS NOT NULL AND p.volume > 5 AS final_research_eligible
        FROM panel p JOIN (SELECT session_date, lag(session_date) OVER (ORDER BY session_date) AS previous FROM sessions) s ON s.session_date = p.date LEFT JOIN panel q ON q.security_id = p.security_id AND q.date = s.previous""",
    "z_segment": "SELECT *, sum(CASE WHEN final_research_eligible THEN 0 ELSE 1 END) OVER (PARTITION BY security_id ORDER BY date) AS return_segment_id, security_id <> 3 AS broad, security_id > 1 AND security_id <> 3 AS exchange FROM z_return",
    "z_row": "SELECT * FROM z_segment WHERE final_research_eligible",
    "z_market": "SELECT date, avg(gross_total_return) AS market_return_1d, count(*) AS market_security_count FROM z_row WHERE exchange GROUP BY date",
    "z_market_ahead": "SELECT date, market_return_1d, " + ", ".join(
        f"CASE WHEN count(*) OVER w{h} = {h} THEN exp(sum(ln(1 + market_return_1d)) OVER w{h}) - 1 END AS market_forward_return_{h}d" for h in R.HORIZONS)
        + " FROM z_market WINDOW " + ", ".join(f"w{h} AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in R.HORIZONS),
    "z_label": "SELECT security_id, date, ticker, return_segment_id, " + ", ".join(
        f"CASE WHEN count(*) OVER w{h} = {h} THEN exp(sum(ln(1 + gross_total_return)) OVER w{h}) - 1 END AS security_forward_return_{h}d" for h in R.HORIZONS)
        + " FROM z_row WINDOW " + ", ".join(f"w{h} AS (PARTITION BY security_id, return_segment_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in R.HORIZONS),
    "z_source": """SELECT r.security_id, r.date, r.ticker, r.return_segment_id, r.gross_total_return, r.split_normalized_close, r.volume, ln(1 + r.volume) AS log_volume, m.market_return_1d, broad AS primary_research_eligible_broad, exchange AS primary_research_eligible_exchange,
        split_normalized_close - lag(split_normalized_close) OVER (PARTITION BY r.security_id, return_segment_id ORDER BY r.date) AS price_delta FROM z_row r LEFT JOIN z_market m ON m.date = r.date""",
    "z_rolling": "SELECT *, " + ", ".join(
        f"count(*) OVER p{n} AS n_prior_{n}, count(*) OVER t{n} AS n_trailing_{n}, sum(ln(1 + gross_total_return)) OVER t{n} AS trailing_log_return_{n}, stddev_samp(gross_total_return) OVER p{n} AS realized_vol_{n}d_raw, median(volume) OVER p{n} AS median_volume_{n}, "
        f"avg(log_volume) OVER p{n} AS mean_log_volume_{n}, stddev_samp(log_volume) OVER p{n} AS sd_log_volume_{n}, count(price_delta) OVER t{n} AS n_rsi_{n}, sum(greatest(COALESCE(price_delta, 0), 0)) OVER t{n} AS gain_{n}, sum(greatest(-COALESCE(price_delta, 0), 0)) OVER t{n} AS loss_{n}" for n in R.WINDOWS)
        + " FROM z_source WINDOW " + ", ".join(f"p{n} AS (PARTITION BY security_id, return_segment_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), t{n} AS (PARTITION BY security_id, return_segment_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in R.WINDOWS),
    "z_feature": "SELECT *, " + ", ".join(f"CASE WHEN forward_rel_return_{h}d > 0 THEN 1 WHEN forward_rel_return_{h}d <= 0 THEN 0 END AS target_outperform_{h}d" for h in R.HORIZONS) + f""" FROM (
        SELECT r.security_id, r.date, r.ticker, r.return_segment_id, primary_research_eligible_broad, primary_research_eligible_exchange, CASE WHEN r.date <= DATE '{TRAIN}' THEN 'train' WHEN r.date <= DATE '{VALID}' THEN 'validation' ELSE 'test' END AS sample_split, gross_total_return AS lag_1d_gtr, """ + ", ".join(
        f"""CASE WHEN n_trailing_{n} = {n} THEN exp(trailing_log_return_{n}) - 1 END AS trailing_gtr_{n}d, CASE WHEN n_prior_{n} = {n} THEN realized_vol_{n}d_raw END AS realized_vol_{n}d, CASE WHEN n_prior_{n} = {n} AND realized_vol_{n}d_raw > 0 THEN gross_total_return / realized_vol_{n}d_raw END AS scaled_lag_1d_return_{n}d,
        CASE WHEN n_rsi_{n} < {n} THEN NULL WHEN gain_{n} = 0 AND loss_{n} = 0 THEN 50.0 WHEN loss_{n} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain_{n} / loss_{n}) END AS rsi_{n}, CASE WHEN n_prior_{n} = {n} AND median_volume_{n} > 0 THEN volume / median_volume_{n} END AS relative_volume_{n}d,
        CASE WHEN n_prior_{n} = {n} AND sd_log_volume_{n} > 0 THEN (log_volume - mean_log_volume_{n}) / sd_log_volume_{n} END AS volume_zscore_{n}d""" for n in R.WINDOWS) + """, r.market_return_1d, (1 + gross_total_return) / (1 + r.market_return_1d) - 1 AS market_relative_return_1d, """ + ", ".join(
        f"security_forward_return_{h}d, (1 + security_forward_return_{h}d) / (1 + market_forward_return_{h}d) - 1 AS forward_rel_return_{h}d" for h in R.HORIZONS)
        + " FROM z_rolling r LEFT JOIN z_label l ON l.security_id = r.security_id AND l.date = r.date LEFT JOIN z_market_ahead m ON m.date = r.date WHERE primary_research_eligible_broad) f",
    "z_model": "SELECT *, " + ", ".join(f"""CASE WHEN target_end_date_{h}d <= DATE '{TRAIN}' THEN 'train' WHEN date > DATE '{TRAIN}' AND target_end_date_{h}d <= DATE '{VALID}' THEN 'validation' WHEN date > DATE '{VALID}' THEN 'test' END AS split_{h}d""" for h in R.HORIZONS)
        + " FROM (SELECT *, " + ", ".join(f"lead(date, {h}) OVER w AS target_end_date_{h}d" for h in R.HORIZONS) + " FROM z_feature WINDOW w AS (PARTITION BY security_id, return_segment_id ORDER BY date)) d",
    "z_pool": "SELECT security_id, date, ticker, " + ", ".join(R.FEATURES) + ", forward_rel_return_5d AS forward_relative_return, target_outperform_5d AS target, target_end_date_5d AS target_end_date FROM z_model WHERE primary_research_eligible_exchange AND split_5d = 'train' AND target_outperform_5d IS NOT NULL AND "
        + " AND ".join(f"{f} IS NOT NULL" for f in R.FEATURES),
}


def returns(v):
    def build():
        x = prev_session_join(v.panel, v.sessions, "security_id", "date", {"_before": "close"})
        return x.select(
            "security_id", "ticker", "date", F.col("close").alias("split_normalized_close"), "volume", (F.col("close") / F.col("_before") - 1).alias("gross_total_return"),
            (F.col("_before").isNotNull() & (F.col("volume") > 5)).alias("final_research_eligible"), F.lit(None).cast("string").alias("research_quarantine_reason"),
            F.lit(None).cast("string").alias("diagnostic_class"), F.lit(None).cast("double").alias("price_return"))

    return v.keep("panel_returns", build)


def index(v):
    return v.keep("panel_index", lambda: total_return_index(returns(v)))


def universe(v):
    s = F.col("security_id")
    return v.panel.select("security_id", "date", (s != 3).alias("primary_research_eligible_broad"), ((s > 1) & (s != 3)).alias("primary_research_eligible_exchange"))


def market(v):
    return v.keep("market", lambda: R.market_return(returns(v), universe(v)))


def source(v):
    return v.keep("feature_source", lambda: R.feature_source(returns(v), index(v), v.panel, market(v), universe(v)))


def rolling(v):
    return R.rolling_state(source(v))


def features(v):
    return v.keep("features", lambda: R.feature_label(rolling(v), R.forward_labels(returns(v), index(v)), R.market_forward(market(v)), TRAIN, VALID))


def model(v):
    return v.keep("model", lambda: R.label_model(features(v), TRAIN, VALID))


def pool(v, split="train"):
    return R.sample_candidates(model(v), 5, split)




def _cols(stem):
    return " ".join(f"{stem}_{h}d" for h in R.HORIZONS)


@query("rs1_market_return", "SELECT * FROM z_market", doubles="market_return_1d", ints="market_security_count")
def _(v):
    return R.market_return(returns(v), universe(v))


@query("rs2_market_forward", "SELECT * FROM z_market_ahead", doubles="market_return_1d " + _cols("market_forward_return"))
def _(v):
    return R.market_forward(market(v)).drop("market_security_count")


@query("rs3_forward_labels", "SELECT * FROM z_label", doubles=_cols("security_forward_return"), ints="return_segment_id")
def _(v):
    return R.forward_labels(returns(v), index(v))


@query("rs4_feature_source", "SELECT * FROM z_source", doubles="gross_total_return split_normalized_close log_volume market_return_1d price_delta", ints="return_segment_id")
def _(v):
    return R.feature_source(returns(v), index(v), v.panel, market(v), universe(v)).drop("price_return")


_ROLL = ["n_prior", "n_trailing", "trailing_log_return", "median_volume", "mean_log_volume", "sd_log_volume", "n_rsi", "gain", "loss"]
_ROLLED = [f"{s}_{n}" for s in _ROLL for n in R.WINDOWS] + [f"realized_vol_{n}d_raw" for n in R.WINDOWS]


@query("rs5_rolling_state", f"SELECT security_id, date, {', '.join(_ROLLED)} FROM z_rolling", doubles=" ".join(f"{c}:4" for c in _ROLLED if not c.startswith("n_")))
def _(v):
    return rolling(v).select("security_id", "date", *_ROLLED)


_FD = " ".join(f"{f}:4" for f in R.FEATURES) + " " + _cols("security_forward_return") + " " + _cols("forward_rel_return")


@query("rs6_feature_label", "SELECT * FROM z_feature", doubles=_FD, ints="return_segment_id " + _cols("target_outperform"))
def _(v):
    return R.feature_label(rolling(v), R.forward_labels(returns(v), index(v)), R.market_forward(market(v)), TRAIN, VALID)


_SPLITS = ["security_id", "date", *[f"target_end_date_{h}d" for h in R.HORIZONS], *[f"split_{h}d" for h in R.HORIZONS]]


@query("rs7_split_label", f"SELECT {', '.join(_SPLITS)} FROM z_model")
def _(v):
    return R.label_model(features(v), TRAIN, VALID).select(*_SPLITS)


@query("rs8_candidate_counts", "SELECT EXTRACT(YEAR FROM date) AS calendar_year, count(*) AS n FROM z_pool GROUP BY 1", ints="calendar_year n")
def _(v):
    return R.candidate_counts(pool(v))


def _quotas(v, total):
    return R.year_quotas(R.candidate_counts(pool(v)), total)


_QUOTA = """WITH RECURSIVE c AS (SELECT EXTRACT(YEAR FROM date) AS y, count(*) AS n FROM z_pool GROUP BY 1), level AS (SELECT max(k) AS k FROM range(0, 100000) t(k) WHERE (SELECT sum(least(n, k)) FROM c) <= least(600, (SELECT sum(n) FROM c))),
    base AS (SELECT y, n, least(n, k) AS q, row_number() OVER (PARTITION BY n > k ORDER BY y) AS i FROM c, level), gap AS (SELECT least(600, sum(n)) - sum(q) AS g FROM base)
    SELECT y AS calendar_year, q + CASE WHEN n > q AND i <= g THEN 1 ELSE 0 END AS quota FROM base, gap"""


@query("rs9_year_quotas", _QUOTA, ints="calendar_year quota")
def _(v):
    return _quotas(v, 600)


@query("rs10_hash_sample", f"""WITH RECURSIVE quotas AS ({_QUOTA.replace('WITH RECURSIVE', 'WITH', 1)}) SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY EXTRACT(YEAR FROM date) ORDER BY md5(security_id || '|' || date || '|seed|5'), security_id, date) AS i FROM z_pool) p JOIN quotas q ON q.calendar_year = EXTRACT(YEAR FROM p.date) WHERE i <= quota"""
       .replace("SELECT p.* FROM", "SELECT p.* EXCLUDE (i) FROM"), doubles=" ".join(f"{f}:4" for f in R.FEATURES) + " forward_relative_return", ints="target")
def _(v):
    return R.hash_sample(pool(v), _quotas(v, 600), 5, "seed")


CHECKS["z_quota"] = _QUOTA.replace("WITH RECURSIVE", "WITH", 1)
CHECKS["z_sample"] = """SELECT p.* EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY EXTRACT(YEAR FROM date) ORDER BY md5(security_id || '|' || date || '|seed|5'), security_id, date) AS i FROM z_pool) p
    JOIN z_quota q ON q.calendar_year = EXTRACT(YEAR FROM p.date) WHERE i <= quota"""


@query("rs11_sample_summary", "SELECT count(*) AS rows, count(DISTINCT security_id) AS securities, min(date) AS min_date, max(date) AS max_date, avg(target) AS positive_rate FROM z_pool", ints="rows securities", doubles="positive_rate")
def _(v):
    return R.sample_summary(pool(v))


@query("rs11_sample_manifest", """SELECT c.y AS calendar_year, c.n AS candidate_rows, COALESCE(q.quota, 0) AS quota, COALESCE(s.n, 0) AS rows, COALESCE(s.e, 0) AS securities, s.a AS min_date, s.b AS max_date, s.r AS positive_rate
    FROM (SELECT EXTRACT(YEAR FROM date) AS y, count(*) AS n FROM z_pool GROUP BY 1) c LEFT JOIN z_quota q ON q.calendar_year = c.y
    LEFT JOIN (SELECT EXTRACT(YEAR FROM date) AS y, count(*) AS n, count(DISTINCT security_id) AS e, min(date) AS a, max(date) AS b, avg(target) AS r FROM z_sample GROUP BY 1) s ON s.y = c.y""",
       ints="calendar_year candidate_rows quota rows securities", doubles="positive_rate")
def _(v):
    from uuid import uuid4

    stored = R.export_sample(pool(v), f"{ensure_checkpoint_dir(v.spark)}/sample-{uuid4().hex}", 600, 5, "seed")
    return stored.drop("dataset", "horizon", "sampling_seed", "features")


CHECKS["q_rank"] = "SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM scores"
_PM = """SELECT count(*) AS n, avg(target) AS positive_rate, avg(probability) AS mean_prediction, avg(-(target * ln(probability) + (1 - target) * ln(1 - probability))) AS log_loss, avg((probability - target) * (probability - target)) AS brier_score,
    avg(CASE WHEN (probability >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores"""


@query("pm1_roc_auc", "SELECT (sum(r * target) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))) AS roc_auc FROM q_rank", doubles="roc_auc")
def _(v):
    return M.roc_auc(v.scores, "target", "probability")


def _metric(name):
    @query(name, f"SELECT {name.split('_', 1)[1]} FROM ({_PM}) m", doubles=name.split("_", 1)[1])
    def _(v, column=name.split("_", 1)[1]):
        return M.probability_metrics(v.scores, "target", "probability").select(column)


for _name in ("pm2_log_loss", "pm3_brier_score", "pm4_accuracy"):
    _metric(_name)


@query("pm5_base_rate_metrics", f"""SELECT n, positive_rate, greatest(positive_rate, 1 - positive_rate) AS base_rate_accuracy, -(positive_rate * ln(positive_rate) + (1 - positive_rate) * ln(1 - positive_rate)) AS base_rate_log_loss, positive_rate * (1 - positive_rate) AS base_rate_brier_score FROM ({_PM}) m""",
       ints="n", doubles="positive_rate base_rate_accuracy base_rate_log_loss base_rate_brier_score")
def _(v):
    return M.probability_metrics(v.scores, "target", "probability").select("n", "positive_rate", "base_rate_accuracy", "base_rate_log_loss", "base_rate_brier_score")


CHECKS["q_bin"] = """SELECT bin AS calibration_bin, count(*) AS n, avg(probability) AS mean_prediction, avg(target) AS observed_rate, avg(probability) - avg(target) AS calibration_error FROM
    (SELECT *, least(ceil(CAST(row_number() OVER (ORDER BY probability, doc_id) AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE) * 10.0), 10) AS bin FROM scores) b GROUP BY bin"""


@query("pm6_calibration", "SELECT * FROM q_bin", ints="calibration_bin n", doubles="mean_prediction observed_rate calibration_error")
def _(v):
    return M.calibration(v.scores, "target", "probability", ["doc_id"])


@query("pm7_expected_calibration_error", "SELECT sum(n * abs(calibration_error)) / sum(n) AS expected_calibration_error FROM q_bin", doubles="expected_calibration_error")
def _(v):
    return M.expected_calibration_error(M.calibration(v.scores, "target", "probability", ["doc_id"]))


CHECKS |= {
    "c_ranked": "SELECT *, CAST(least(ceil(CAST(row_number() OVER (PARTITION BY date ORDER BY predicted_probability, security_id) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) * 10.0), 10) AS INTEGER) AS decile FROM signals QUALIFY count(*) OVER (PARTITION BY date) >= 10",
    "c_daily": "SELECT date, decile, avg(forward_relative_return) AS decile_return, count(*) AS n_stocks FROM c_ranked GROUP BY date, decile",
    "c_spread": "SELECT date, max(decile_return) FILTER (WHERE decile = 10) - max(decile_return) FILTER (WHERE decile = 1) AS decile_return FROM c_daily GROUP BY date",
    "c_series": "SELECT 'D' || decile AS decile, date, decile_return, CAST(n_stocks AS DOUBLE) AS n_stocks FROM c_daily UNION ALL SELECT 'D10-D1', date, decile_return, (SELECT avg(n_stocks) FROM c_daily WHERE decile IN (1, 10)) FROM c_spread WHERE decile_return IS NOT NULL",
    "c_centred": "SELECT decile, date, decile_return - avg(decile_return) OVER (PARTITION BY decile) AS u, row_number() OVER (PARTITION BY decile ORDER BY date) AS i FROM c_series",
    "c_long_run": "SELECT a.decile, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 5.0) END * a.u * b.u) AS s FROM c_centred a JOIN c_centred b ON a.decile = b.decile AND a.i - b.i BETWEEN 0 AND 4 GROUP BY a.decile",
    "c_statistics": """SELECT decile, count(*) AS observations, avg(decile_return) AS mean_period_return, avg(decile_return) * 50.4 AS annualized_return, stddev_samp(decile_return) * sqrt(50.4) AS annualized_volatility, avg(decile_return) * 50.4 / (stddev_samp(decile_return) * sqrt(50.4)) AS information_ratio,
        avg(decile_return) / (sqrt(any_value(s)) / count(*)) AS newey_west_t, sqrt(any_value(s)) / count(*) AS newey_west_se, avg(n_stocks) AS average_n_stocks FROM c_series JOIN c_long_run USING (decile) GROUP BY decile""",
    "c_ic": """SELECT date, corr(a, b) AS rank_ic, count(*) AS n_stocks FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY predicted_probability) + (count(*) OVER (PARTITION BY date, predicted_probability) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY forward_relative_return) + (count(*) OVER (PARTITION BY date, forward_relative_return) - 1) / 2.0 AS b FROM c_ranked) r GROUP BY date HAVING count(*) >= 3""",
    "c_ic_centred": "SELECT rank_ic - avg(rank_ic) OVER () AS u, row_number() OVER (ORDER BY date) AS i FROM c_ic",
    "c_ic_t": "SELECT (SELECT avg(rank_ic) FROM c_ic) / (sqrt(sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 5.0) END * a.u * b.u)) / (SELECT count(*) FROM c_ic)) AS t FROM c_ic_centred a JOIN c_ic_centred b ON a.i - b.i BETWEEN 0 AND 4",
    "c_ic_summary": "SELECT count(*) AS observations, avg(rank_ic) AS mean_ic, stddev_samp(rank_ic) AS std_ic, avg(rank_ic) / stddev_samp(rank_ic) AS icir, (SELECT t FROM c_ic_t) AS newey_west_t, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM c_ic",
    "c_period": "SELECT 'D' || decile AS series, date, CAST(date + INTERVAL 45 DAY AS DATE) AS target_end_date, decile_return AS period_return FROM c_daily UNION ALL SELECT 'D10-D1', date, CAST(date + INTERVAL 45 DAY AS DATE), decile_return FROM c_spread WHERE decile_return IS NOT NULL",
    "c_sleeve": "SELECT series, (dense_rank() OVER (PARTITION BY series ORDER BY date) - 1) % 5 AS sleeve, target_end_date, period_return FROM c_period",
    "c_wealth": "SELECT series, sleeve, target_end_date AS date, 100 * exp(sum(ln(1 + period_return)) OVER (PARTITION BY series, sleeve ORDER BY target_end_date)) AS wealth FROM c_sleeve",
    "c_time": "SELECT series, min(date) AS date FROM c_period GROUP BY series UNION SELECT series, target_end_date FROM c_period",
    "c_payoff": """SELECT series, date, 5 AS horizon, CASE WHEN date = min(date) OVER (PARTITION BY series) THEN 100.0 ELSE level END AS index_level FROM (SELECT t.series, t.date, avg(COALESCE(w.wealth, 100.0)) AS level FROM c_time t CROSS JOIN range(0, 5) s(sleeve)
        ASOF LEFT JOIN c_wealth w ON w.series = t.series AND w.sleeve = s.sleeve AND t.date >= w.date GROUP BY t.series, t.date) g""",
}


def ranked(v):
    return v.keep("ranked_signals", lambda: C.daily_deciles(v.signals))


def daily(v):
    return v.keep("decile_daily", lambda: C.decile_returns(ranked(v)))


_ST = "mean_period_return annualized_return annualized_volatility information_ratio:4 newey_west_t:4 newey_west_se average_n_stocks"


@query("cs1_daily_deciles", "SELECT security_id, date, decile FROM c_ranked")
def _(v):
    return C.daily_deciles(v.signals).select("security_id", "date", "decile")


@query("cs2_decile_returns", "SELECT * FROM c_daily", doubles="decile_return", ints="n_stocks")
def _(v):
    return C.decile_returns(ranked(v))


@query("cs3_newey_west", "SELECT decile, newey_west_t, newey_west_se FROM c_statistics", doubles="newey_west_t:4 newey_west_se")
def _(v):
    series = daily(v).select(F.concat(F.lit("D"), F.col("decile")).alias("decile"), "date", "decile_return").unionByName(C.spread_series(daily(v)).withColumn("decile", F.lit("D10-D1")))
    return C.newey_west(series, ["decile"], "date", "decile_return", 4).select("decile", "newey_west_t", "newey_west_se")


@query("cs4_decile_statistics", "SELECT * FROM c_statistics", doubles=_ST, ints="observations")
def _(v):
    return C.decile_statistics(daily(v), 5)


@query("cs5_spread", "SELECT * FROM c_spread WHERE decile_return IS NOT NULL", doubles="decile_return")
def _(v):
    return C.spread_series(daily(v))


@query("cs6_rank_ic", "SELECT * FROM c_ic", doubles="rank_ic", ints="n_stocks")
def _(v):
    return C.rank_ic(ranked(v))


@query("cs7_ic_summary", "SELECT * FROM c_ic_summary", doubles="mean_ic std_ic icir newey_west_t:4 hit_rate", ints="observations")
def _(v):
    return C.ic_summary(v.keep("ic", lambda: C.rank_ic(ranked(v))), 5)


CHECKS["c_mono"] = """SELECT corr(d, r) AS spearman_decile_return, bool_and(up) AS strictly_monotone FROM (SELECT d, rank() OVER (ORDER BY m) AS r, m > lag(m) OVER (ORDER BY d) AS up FROM (SELECT CAST(decile[2:] AS INT) AS d, mean_period_return AS m FROM c_statistics WHERE decile <> 'D10-D1') x) y"""


@query("cs8_monotonicity", "SELECT * FROM c_mono", doubles="spearman_decile_return")
def _(v):
    return C.monotonicity(C.decile_statistics(daily(v), 5))


@query("cs9_legs", "SELECT a.m AS long_leg_mean_return, -b.m AS short_leg_mean_return, a.m - b.m AS long_short_mean_return FROM (SELECT mean_period_return AS m FROM c_statistics WHERE decile = 'D10') a, (SELECT mean_period_return AS m FROM c_statistics WHERE decile = 'D1') b", doubles="long_leg_mean_return short_leg_mean_return long_short_mean_return")
def _(v):
    return C.legs(C.decile_statistics(daily(v), 5))


_RUN = """SELECT '{m}' AS model, 5 AS horizon_days, (SELECT count(*) FROM c_ranked) AS n, mean_ic, i.newey_west_t AS ic_newey_west_t, s.mean_period_return AS d10_minus_d1_mean, s.newey_west_t AS d10_minus_d1_nw_t FROM c_ic_summary i, (SELECT * FROM c_statistics WHERE decile = 'D10-D1') s"""
_RUND = dict(doubles="mean_ic ic_newey_west_t:4 d10_minus_d1_mean d10_minus_d1_nw_t:4", ints="n horizon_days")


@query("cs10_evaluate", _RUN.format(m="score"), **_RUND)
def _(v):
    return C.run_summary(C.evaluate_cross_section(v.signals, 5), "score", 5)


@query("cs11_payoff_index", "SELECT * FROM c_payoff WHERE series = 'D10-D1'", doubles="index_level:4", ints="horizon")
def _(v):
    periods = C.spread_series(daily(v)).select(F.lit("D10-D1").alias("series"), "date", F.date_add("date", 45).alias("target_end_date"), F.col("decile_return").alias("period_return"))
    return C.payoff_index(periods, 5)


@query("cs12_payoff_indices", "SELECT * FROM c_payoff", doubles="index_level:4", ints="horizon")
def _(v):
    return C.payoff_indices(ranked(v), 5)


def _oscillator(v):
    return v.signals.withColumn("rsi_14", F.col("predicted_probability") * 100)


CHECKS |= {
    "r_bucket": "SELECT date, CASE WHEN predicted_probability * 100 < 30 THEN 'below_30' WHEN predicted_probability * 100 > 70 THEN 'above_70' ELSE 'neutral' END AS bucket, forward_relative_return AS f FROM signals",
    "r_daily": "SELECT date, bucket, avg(f) AS mean_return, count(*) AS n FROM r_bucket GROUP BY date, bucket",
    "r_pair": "SELECT a.date, a.mean_return - b.mean_return AS d FROM r_daily a JOIN r_daily b ON b.date = a.date AND a.bucket = 'below_30' AND b.bucket = 'above_70'",
    "r_centred": "SELECT d - avg(d) OVER () AS u, row_number() OVER (ORDER BY date) AS i FROM r_pair",
}


@query("rsi1_threshold_contrast", """SELECT (SELECT count(*) FROM r_bucket WHERE bucket = 'below_30') AS below_30_rows, (SELECT count(*) FROM r_bucket WHERE bucket = 'above_70') AS above_70_rows, (SELECT count(*) FROM r_pair) AS paired_dates, (SELECT avg(d) FROM r_pair) AS below_30_minus_above_70_mean,
    (SELECT avg(d) FROM r_pair) / (sqrt(sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 5.0) END * a.u * b.u)) / (SELECT count(*) FROM r_pair)) AS below_30_minus_above_70_nw_t FROM r_centred a JOIN r_centred b ON a.i - b.i BETWEEN 0 AND 4""",
       ints="below_30_rows above_70_rows paired_dates", doubles="below_30_minus_above_70_mean below_30_minus_above_70_nw_t:4")
def _(v):
    return C.threshold_contrast(_oscillator(v), "rsi_14", 5)


# the same chain for the reversed score
CHECKS["signals_reversed"] = "SELECT * REPLACE (1 - predicted_probability AS predicted_probability) FROM signals"
CHECKS |= {
    "e_" + k[2:]: re.sub(r"\bc_", "e_", text).replace("FROM signals", "FROM signals_reversed") for k, text in list(CHECKS.items()) if k.startswith("c_")
}


@query("rsi2_hypotheses", f"{_RUN.format(m='rsi14_continuation')} UNION ALL " + re.sub(r"\bc_", "e_", _RUN.format(m="rsi14_reversal")), **_RUND)
def _(v):
    return C.directional_hypotheses(_oscillator(v), "rsi_14", 5, "rsi14")


@query("cmp1_compare_runs", f"{_RUN.format(m='a')} UNION ALL {_RUN.format(m='b')}", **_RUND)
def _(v):
    tables = C.evaluate_cross_section(v.signals, 5)
    return C.compare_runs(C.run_summary(tables, "a", 5), C.run_summary(tables, "b", 5))


def _ml_rows(v):
    return v.signals.select("security_id", "date", F.col("security_id").cast("string").alias("ticker"), "target_end_date", "target", "forward_relative_return", "predicted_probability",
                            (F.month("date") / 12.0).alias("season")).withColumnRenamed("predicted_probability", "level")


_CUT = "date < DATE '1999-01-01'"


@query("ml1_base_rate", f"SELECT security_id, date, (SELECT avg(target) FROM signals WHERE {_CUT}) AS predicted_probability FROM signals WHERE NOT ({_CUT})", doubles="predicted_probability")
def _(v):
    rows = _ml_rows(v)
    return L.base_rate(rows.where(_CUT), rows.where(f"NOT ({_CUT})")).select("security_id", "date", "predicted_probability")


CHECKS["z_pool_validation"] = CHECKS["z_pool"].replace("split_5d = 'train'", "split_5d = 'validation'")


def _fitted(v, name, fit):
    """Predictions of a model on the validation pool, and what holds for it, fitted on the whole feature table."""
    train, validation = pool(v), pool(v, "validation")
    L.validate_sample(train, R.FEATURES, "1900-01-01", TRAIN)
    L.validate_sample(validation, R.FEATURES, TRAIN, VALID)
    model = v.keep_object(name, lambda: fit(train))
    return L.predict(model, validation), L.predict(model, train)


def _invariants(v, scored, fitted):
    """Rows scored, probabilities within 0 and 1, and whether the fit beats the base rate on its own rows."""
    p, y = F.col("predicted_probability"), F.col("target").cast("double")

    def loss(q):
        return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))

    priced = fitted.withColumn("prior", fitted.agg(F.avg(y)).scalar())
    better = priced.agg(loss(F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))) <= loss(F.col("prior"))).scalar()
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(p.between(0, 1)).alias("probabilities")).withColumn("beats_base_rate", better)


_FIT = "SELECT count(*) AS rows, count(*) AS probabilities, TRUE AS beats_base_rate FROM z_pool_validation"


def _logistic(v):
    return _fitted(v, "logistic", lambda train: L.fit_logistic(train, R.FEATURES))


def _boosted(v):
    return _fitted(v, "boosted", lambda train: L.fit_gbt(train, R.FEATURES))


@query("ml2_logistic")
def _(v):
    return _logistic(v)[0].select("security_id", "date", "predicted_probability")


@query("ml2_logistic_fit", _FIT, ints="rows probabilities")
def _(v):
    return _invariants(v, *_logistic(v))


@query("ml3_boosted_trees")
def _(v):
    return _boosted(v)[0].select("security_id", "date", "predicted_probability")


@query("ml3_boosted_fit", _FIT, ints="rows probabilities")
def _(v):
    return _invariants(v, *_boosted(v))


@query("ml4_prediction_frame", f"SELECT security_id, date, CAST(security_id AS VARCHAR) AS ticker, target_end_date, 'base_rate' AS model, 5 AS horizon, 'validation' AS sample, target, forward_relative_return, (SELECT avg(target) FROM signals WHERE {_CUT}) AS predicted_probability FROM signals WHERE NOT ({_CUT})", doubles="forward_relative_return predicted_probability")
def _(v):
    rows = _ml_rows(v)
    return L.prediction_frame(L.base_rate(rows.where(_CUT), rows.where(f"NOT ({_CUT})")), "base_rate", 5)
