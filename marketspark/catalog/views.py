"""Market-shaped views over the given tables.

Each view is one SELECT that Spark and the checking engine both accept, so a query
and its SQL check start from the same rows. Views only reshape inputs; everything a
query claims to compute happens in the operators on one side and in plain SQL on
the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession

from marketspark.session import stage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_TIE = "0.00000123"  # keeps averages of few decimals off exact rounding ties

VIEWS: dict[str, str] = {
    # supplier-by-week price bars: about a fifth of the weeks are missing per supplier
    "bars": f"""
        SELECT l_suppkey AS security_id, s_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               round((min(p_retailprice * (1 - l_discount)) + max(p_retailprice * (1 - l_discount))) / 2 + {_TIE}, 4) AS open,
               round(max(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS high,
               round(min(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS low,
               round(avg(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        GROUP BY l_suppkey, s_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # a second source: the same bars from returned and shipped rows only
    "vendor_bars": f"""
        SELECT l_suppkey AS security_id, s_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               round(avg(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS close,
               round(avg(p_retailprice * (1 - l_discount) * (1 - l_tax)) + {_TIE}, 4) AS adjusted_close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_returnflag <> 'N'
        GROUP BY l_suppkey, s_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # nation-by-week panel: nearly gap-free, long enough for 60-row frames
    "panel": f"""
        SELECT CAST(s_nationkey AS BIGINT) AS security_id, n_name AS ticker,
               CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               round(avg(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey
        GROUP BY s_nationkey, n_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # trading calendar input: a week that starts early in the month closes early
    "sessions": """
        SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date,
               CASE WHEN EXTRACT(DAY FROM CAST(date_trunc('week', l_shipdate) AS DATE)) <= 3 THEN 210 ELSE 390 END AS session_minutes
        FROM lineitem""",
    # open sessions: the weeks around the turn of the year are closed
    "open_sessions": """
        SELECT session_date, session_minutes FROM sessions
        WHERE NOT (EXTRACT(MONTH FROM session_date) = 12 AND EXTRACT(DAY FROM session_date) >= 22)""",
    # quarterly share counts per ticker; the filing follows the period by up to a month
    "filings": """
        SELECT s_name AS ticker, concat(s_name, '.US') AS provider_symbol,
               CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period_date,
               CAST(max(l_shipdate) AS DATE) AS filing_date,
               (10000 + 100 * l_suppkey) * (1 + count(*) / 200e0) * CASE WHEN sum(l_quantity) > 330 THEN 1000 ELSE 1 END AS shares_outstanding,
               CASE WHEN max(l_tax) >= 0.08 THEN 'EUR' ELSE 'USD' END AS currency_symbol,
               max(l_shipdate) AS retrieved_at
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_returnflag = 'R'
        GROUP BY s_name, l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE)""",
    # as landed: some periods are filed again on the same day, later in retrieval
    "landed_filings": """
        SELECT ticker, provider_symbol, period_date, filing_date, shares_outstanding, currency_symbol, retrieved_at FROM filings
        UNION ALL SELECT ticker, provider_symbol, period_date, filing_date, shares_outstanding * 2, currency_symbol, retrieved_at - INTERVAL '1' DAY FROM filings WHERE currency_symbol = 'EUR'
        UNION ALL SELECT ticker, provider_symbol, CAST(period_date - INTERVAL '90' DAY AS DATE), filing_date, shares_outstanding * 3, currency_symbol, retrieved_at FROM filings WHERE currency_symbol = 'USD'
        UNION ALL SELECT ticker, provider_symbol, CAST(filing_date + INTERVAL '5' DAY AS DATE), filing_date, shares_outstanding, currency_symbol, retrieved_at FROM filings
        UNION ALL SELECT ticker, provider_symbol, period_date, NULL, shares_outstanding, currency_symbol, retrieved_at FROM filings""",
    # returns that reference and universe tables start from
    "research_rows": "SELECT security_id, ticker, date, volume > 4 AS final_research_eligible FROM bars",
    # a provider's symbol list: exact codes, old codes and some contradictions
    "reference_symbols": """
        SELECT upper(s_name) AS code, concat(s_name, '.US') AS provider_symbol,
               CASE WHEN s_nationkey < 18 THEN 'Common Stock' WHEN s_nationkey < 20 THEN 'ETF' END AS instrument_type,
               CASE WHEN s_nationkey < 8 THEN 'NYSE' WHEN s_nationkey < 14 THEN 'NASDAQ' ELSE 'OTC' END AS exchange,
               concat('US', upper(substr(md5(s_name), 1, 9)), '0') AS isin, s_acctbal < 0 AS is_delisted
        FROM supplier WHERE s_nationkey <> 5
        UNION ALL SELECT concat(s_name, '_OLD2'), concat(s_name, '.OLD'), 'Common Stock', 'AMEX', concat('US', upper(substr(md5(concat('x', s_name)), 1, 9)), '0'), TRUE
        FROM supplier WHERE s_nationkey = 5 OR s_acctbal > 5000
        UNION ALL SELECT s_name, concat(s_name, '.F'), 'FUND', 'NYSE', concat('US', upper(substr(md5(s_name), 1, 9)), '0'), FALSE FROM supplier WHERE s_nationkey = 2""",
    # a listing file: several dates per symbol, wording by nation
    "listed_symbols": """
        SELECT s_name AS act_symbol,
               concat(s_name, CASE WHEN s_nationkey IN (2, 7) THEN ' common stock' WHEN s_nationkey = 8 THEN ' - warrants' WHEN s_nationkey = 9 THEN ' depositary shares ordinary share' ELSE ' holdings' END) AS security_name,
               CASE WHEN s_nationkey = 5 THEN 'NYSE MKT' END AS listing_exchange, CASE WHEN s_nationkey = 21 THEN 1 ELSE 0 END AS is_etf,
               0 AS is_test_issue, DATE '2001-01-01' AS last_seen
        FROM supplier WHERE s_nationkey <> 11
        UNION ALL SELECT s_name, concat(s_name, ' preferred stock'), 'OTC', 0, 0, DATE '1999-01-01' FROM supplier""",
    "manual_types": "SELECT s_name AS ticker, 'FUND' AS instrument_type FROM supplier WHERE s_nationkey = 10",
    # search results for every supplier name
    "search_results": """
        SELECT s_name AS query_ticker, l_linenumber AS result_rank,
               CASE l_linenumber WHEN 1 THEN concat('Other', s_name, '.US') WHEN 2 THEN replace(concat(s_name, '.US'), '#', '-') WHEN 3 THEN concat(lower(s_name), '.us') ELSE s_name END AS result_code
        FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_tax >= 0.08 AND l_discount >= 0.095 AND l_quantity > 35) l JOIN supplier ON s_suppkey = l_suppkey""",
    "issuer_tickers": """
        SELECT CAST(s_nationkey AS VARCHAR(10)) AS cik, lower(s_name) AS ticker, 'X' AS exchange FROM supplier
        UNION ALL SELECT NULL, s_name, 'X' FROM supplier""",
    # dated archive rows of index constituents: shares, and identifiers
    "archive_shares": """
        SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL '27' DAY AS DATE) AS observation_date, concat('C', CAST(l_suppkey AS VARCHAR(10))) AS security_code,
               concat(s_name, CASE WHEN l_tax >= 0.075 THEN ' Inc' ELSE '' END) AS security_name, CAST(s_nationkey AS VARCHAR(10)) AS issuer_code, CAST(l_suppkey AS VARCHAR(10)) AS timeseries_code,
               (10000e0 + 100 * l_suppkey) * CASE WHEN l_quantity > 44 THEN 1000 ELSE 1 END AS shares_today, (10000e0 + 100 * l_suppkey) * 1.02e0 AS closing_shares
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1 AND l_returnflag = 'A'""",
    "archive_ids": """
        SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL '27' DAY AS DATE) AS observation_date, concat('C', CAST(l_suppkey AS VARCHAR(10))) AS security_code,
               CASE WHEN l_quantity > 48 THEN concat('The ', s_name) ELSE upper(s_name) END AS security_name, CAST(CASE WHEN l_discount >= 0.095 THEN 99 ELSE s_nationkey END AS VARCHAR(10)) AS issuer_code,
               CAST(l_suppkey AS VARCHAR(10)) AS timeseries_code, concat('US', upper(substr(md5(s_name), 1, 9)), '0') AS isin,
               CASE WHEN l_tax <= 0.005 THEN 'invalid_isin' ELSE 'valid_isin' END AS parse_status, 'USD' AS price_currency,
               (10000e0 + 100 * l_suppkey) * CASE WHEN l_quantity > 45 THEN 1000 ELSE 1 END AS shares_today,
               (10000e0 + 100 * l_suppkey) * CASE WHEN l_quantity < 3 THEN 1.5e0 ELSE 1.02e0 END AS closing_shares
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber IN (1, 2) AND l_returnflag <> 'N'""",
    "archive_caps": """
        SELECT 'file' AS source_sha256, l_orderkey * 10 + l_linenumber AS source_row_number, CAST(date_trunc('month', l_shipdate) + INTERVAL '27' DAY AS DATE) AS observation_date,
               concat('US', upper(substr(md5(s_name), 1, 9)), '0') AS isin, (10000e0 + 100 * l_suppkey) * CASE WHEN l_quantity > 40 THEN 1000 ELSE 1 END * 1000 / 1000000 AS mktcap_as_supplied,
               CASE WHEN l_tax <= 0.005 THEN 'invalid_isin' ELSE 'valid_isin' END AS parse_status
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 3 AND l_returnflag = 'R'""",
    # split factors of the bars: a jump in discounted weeks
    "bar_factors": """
        SELECT security_id, date, daily_split_ratio, exp(sum(ln(daily_split_ratio)) OVER (PARTITION BY security_id ORDER BY date)) AS cumulative_split_multiplier
        FROM (SELECT security_id, date, CASE WHEN volume > 140 THEN 2.5e0 ELSE 1e0 END AS daily_split_ratio FROM bars) b""",
    # sourced counts on some priced days; some reject the filed count in force
    "manual_shares": """
        SELECT security_id, ticker, date AS price_date, 12345e0 AS sourced_shares, date AS shares_as_of_date, CAST(date - INTERVAL '3' DAY AS DATE) AS source_publication_date, 'filing' AS source_name, 'D1' AS source_document_id,
               CASE WHEN volume > 90 THEN concat(ticker, '.US') END AS target_provider_symbol, CAST(NULL AS DATE) AS target_period_date, CAST(NULL AS DATE) AS target_filing_date, CAST(NULL AS DOUBLE) AS target_shares
        FROM bars WHERE volume > 80
        UNION ALL SELECT b.security_id, f.ticker, b.date, 1e0, f.filing_date, CAST(b.date - INTERVAL '400' DAY AS DATE), 'review', 'D2', f.provider_symbol, f.period_date, f.filing_date, f.shares_outstanding
        FROM filings f JOIN bars b ON b.ticker = f.ticker AND b.date = CAST(date_trunc('week', f.filing_date) AS DATE) AND b.volume <= 80 WHERE f.currency_symbol = 'EUR'""",
    "share_sources": """
        SELECT l_suppkey AS security_id, s_name AS ticker, CAST(l_shipdate AS DATE) AS publication_date, CAST(l_shipdate + INTERVAL '1' DAY AS DATE) AS first_price_date,
               CAST(l_shipdate - INTERVAL '3' DAY AS DATE) AS shares_as_of_date, 100e0 + l_suppkey AS sourced_shares, 'cover page' AS source_name, concat('S', CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_partkey AS VARCHAR(12))) AS source_document_id
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 49 AND l_linenumber = 5""",
    # stated splits: untaxed, undiscounted rows; half of them dated inside the week
    "splits": """
        SELECT s_name AS act_symbol,
               CASE WHEN l_linestatus = 'F' THEN CAST(date_trunc('week', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END AS ex_date,
               CAST(max(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 11 END) AS DOUBLE) AS to_factor,
               CAST(max(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 10 END) AS DOUBLE) AS for_factor
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_discount <= 0.005 AND l_tax <= 0.015
        GROUP BY s_name, CASE WHEN l_linestatus = 'F' THEN CAST(date_trunc('week', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END""",
    # a provider's split history: partly the same events, partly moved by some days or restated
    "vendor_splits": """
        SELECT concat(s_name, '.US') AS provider_symbol,
               CASE WHEN l_tax <= 0.005 THEN CAST(date_trunc('week', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END AS split_date,
               CAST(max(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 11 END) AS DOUBLE) AS to_factor,
               CAST(max(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 10 END) AS DOUBLE) AS for_factor,
               md5(concat(s_name, '|', CAST(CASE WHEN l_tax <= 0.005 THEN CAST(date_trunc('week', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END AS VARCHAR(10)))) AS observation_id
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_discount <= 0.005 AND l_tax <= 0.025
        GROUP BY s_name, CASE WHEN l_tax <= 0.005 THEN CAST(date_trunc('week', l_shipdate) AS DATE) ELSE CAST(l_shipdate AS DATE) END""",
    # dividends on the week of single-unit rows
    "dividends": """
        SELECT s_name AS act_symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ex_date,
               round(max(l_extendedprice) / 300, 4) AS amount
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_quantity <= 2
        GROUP BY s_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # ticker changes: a supplier's code passes to the next supplier of its nation
    "evidence": """
        SELECT md5(concat(a.s_name, '|', b.s_name)) AS evidence_id, a.s_name AS from_ticker, b.s_name AS to_ticker,
               a.s_nationkey AS cik, x.effective_date, a.s_acctbal > 0 AS same_security
        FROM (SELECT s_suppkey, s_name, s_nationkey, s_acctbal,
                     lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS next_key FROM supplier) a
        JOIN supplier b ON b.s_suppkey = a.next_key
        JOIN (SELECT l_suppkey, CAST(date_trunc('week', min(l_shipdate)) AS DATE) AS effective_date
              FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 7 GROUP BY l_suppkey) x ON x.l_suppkey = a.s_suppkey""",
    # raw bars under their ticker, from rows that were not returned
    "raw_bars": f"""
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, s_name AS act_symbol,
               round((min(p_retailprice * (1 - l_discount)) + max(p_retailprice * (1 - l_discount))) / 2 + {_TIE}, 4) AS open,
               round(max(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS high,
               round(min(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS low,
               round(avg(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_returnflag <> 'R'
        GROUP BY s_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # bars of the returned rows: weeks the raw bars may lack
    "returned_bars": f"""
        SELECT s_name AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               round(avg(p_retailprice * (1 - l_discount)) + {_TIE}, 4) AS close,
               round(avg(p_retailprice * (1 - l_discount) * (1 - l_tax)) + {_TIE}, 4) AS adjusted_close,
               CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_returnflag = 'R'
        GROUP BY s_name, CAST(date_trunc('week', l_shipdate) AS DATE)""",
    # outside observations for any ticker and week: from returned rows, under two lookup methods
    "outside": """
        SELECT md5(concat(ticker, '|', CAST(date AS VARCHAR(10)), '|', method)) AS observation_id, md5(ticker) AS request_id,
               'vendor' AS provider, concat(ticker, CASE WHEN volume > 40 THEN '.X' ELSE '.US' END) AS provider_symbol,
               CAST(0 AS BIGINT) AS lineage_id, 'none' AS lineage_code, ticker AS historical_ticker, method AS lookup_method,
               CASE WHEN volume < 6 THEN close ELSE close * 0.99 END AS open, CASE WHEN volume < 6 THEN close ELSE close * 1.02 END AS high,
               CASE WHEN volume < 6 THEN close ELSE close * 0.98 END AS low, close, adjusted_close AS provider_adjusted_close,
               CASE WHEN volume < 6 THEN 0 ELSE volume END AS provider_volume, date AS session_date, date AS retrieved_at
        FROM (SELECT *, 'historical_ticker_lookup' AS method FROM returned_bars WHERE volume > 3
              UNION ALL SELECT *, 'lineage_latest_ticker_fallback' AS method FROM returned_bars WHERE volume > 20 OR volume <= 3) v""",
    # one dated episode and one security per ticker
    "episode_spans": """
        SELECT concat(s_name, '_E001') AS ticker_episode_id, s_name AS act_symbol, CAST(l_suppkey AS BIGINT) AS security_id,
               CAST(min(CASE WHEN l_quantity >= 46 AND l_linenumber <= 2 THEN l_shipdate END) AS DATE) AS start_date,
               CAST(max(CASE WHEN l_quantity >= 46 AND l_linenumber >= 6 THEN l_shipdate END) AS DATE) AS end_date
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name, l_suppkey""",
    # bars as a priced series; thin weeks are not eligible
    "priced": """
        SELECT security_id, ticker, date, open, high, low, close, volume, 'primary' AS source, ticker AS source_symbol,
               'native' AS source_lookup_method, volume > 4 AS research_eligible FROM bars""",
    "symbol_bars": "SELECT ticker AS act_symbol, date, close FROM bars",
    # resolved provider identities for some split days
    "symbol_resolutions": """
        SELECT act_symbol AS ticker, split_date AS relevant_date, CASE WHEN p.to_factor > 2 THEN 'resolved' ELSE 'unresolved' END AS resolution_status,
               provider_symbol AS resolved_provider_symbol, 'search' AS resolution_method
        FROM vendor_splits p JOIN episode_spans ON concat(act_symbol, '.US') = provider_symbol WHERE p.to_factor > 1""",
    # curated events: large dividends, of a kind that follows from their size
    "override_seed": """
        SELECT d.act_symbol AS ticker, d.ex_date AS event_date,
               CASE WHEN amount > 12 THEN 'composite_cash_and_in_kind_distribution' WHEN amount > 11.5 THEN 'stock_dividend' ELSE 'cash_dividend' END AS corporate_action_type,
               CASE WHEN amount > 10.5 THEN 'pre_split' ELSE 'post_split' END AS dividend_share_basis,
               CASE WHEN amount > 11 THEN 1.5e0 END AS override_split_ratio, CASE WHEN amount > 10.8 THEN amount / 2 END AS override_dividend_amount,
               CASE WHEN amount > 11.2 THEN CAST(d.ex_date + INTERVAL '7' DAY AS DATE) END AS override_dividend_ex_date,
               'issuer' AS resolution_source, 'notice' AS source_reference, 'reviewed' AS resolution_notes
        FROM dividends d JOIN episode_spans e ON e.act_symbol = d.act_symbol AND d.ex_date BETWEEN e.start_date AND e.end_date
        WHERE amount > 10""",
    # checked dividends: what a provider says about large amounts
    "dividend_validation": """
        SELECT e.security_id, d.act_symbol AS ticker, d.ex_date AS effective_dividend_ex_date, d.amount AS dividend_previous_share_basis,
               d.amount / 4 AS vendor_unadjusted, d.amount AS vendor_adjusted,
               CASE WHEN d.amount > 8 THEN 'retrospective_adjustment_correction' ELSE 'confirmed' END AS validation_status
        FROM dividends d JOIN episode_spans e ON e.act_symbol = d.act_symbol WHERE d.amount > 7""",
    # provider requests and price validation rows
    "validation_requests": """
        SELECT s_name AS ticker, concat(s_name, '.US') AS provider_symbol, CASE WHEN s_nationkey < 3 THEN 404 WHEN s_nationkey < 5 THEN 500 ELSE 200 END AS status_code,
               s_suppkey AS response_row_count, CASE WHEN s_nationkey < 5 THEN 'failed' END AS error_text, s_acctbal AS retrieved_at
        FROM supplier WHERE s_nationkey < 22""",
    "validation_bars": """
        SELECT ticker, concat(ticker, '.US') AS provider_symbol, 'vendor' AS provider, date, close * 0.99 AS open, close * 1.01 AS high, close * 0.98 AS low,
               close * CASE WHEN volume > 60 THEN 3 ELSE 1 END AS close, CASE WHEN volume <= 90 THEN adjusted_close * CASE WHEN volume > 75 THEN 3 ELSE 1 END END AS adjusted_close, volume
        FROM vendor_bars""",
    "validation_splits": """
        SELECT provider_symbol, split_date AS ex_date, to_factor / for_factor AS split_ratio FROM vendor_splits""",
    # a market with planted faults: raw bars of some tickers jump by an unreported reverse split, and some bars are three times too high
    "missing_splits": """
        SELECT s_name AS act_symbol, CAST(date_trunc('week', min(l_shipdate)) AS DATE) AS split_date
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 44 AND l_linenumber = 1 AND l_suppkey % 3 = 0 GROUP BY s_name""",
    "market_base": """
        SELECT b.date, b.act_symbol, CASE WHEN b.date >= m.split_date THEN 4e0 ELSE 1e0 END AS scale, CASE WHEN b.volume % 37 = 5 THEN 3e0 ELSE 1e0 END AS fault,
               b.open, b.high, b.low, b.close, b.volume
        FROM raw_bars b LEFT JOIN missing_splits m ON m.act_symbol = b.act_symbol""",
    "market_bars": """
        SELECT date, act_symbol, open * scale * fault AS open, high * scale * fault AS high, low * scale * fault AS low, close * scale * fault AS close, volume FROM market_base""",
    "market_provider_bars": """
        SELECT act_symbol AS ticker, concat(act_symbol, '.US') AS provider_symbol, 'vendor' AS provider, date, open * scale AS open, high * scale AS high, low * scale AS low, close * scale AS close,
               close AS adjusted_close, volume
        FROM market_base WHERE volume % 11 <> 3""",
    "market_provider_splits": """
        SELECT concat(act_symbol, '.US') AS provider_symbol, split_date AS ex_date, 0.25e0 AS split_ratio FROM missing_splits
        UNION ALL SELECT v.provider_symbol, v.split_date, v.to_factor / v.for_factor FROM vendor_splits v
        WHERE NOT EXISTS (SELECT 1 FROM missing_splits m WHERE concat(m.act_symbol, '.US') = v.provider_symbol AND m.split_date = v.split_date)""",
    # purchases and clicks per user and day
    "purchases": """
        SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value, count(*) AS n
        FROM events WHERE event_type = 'purchase' GROUP BY user_id, CAST(ts AS DATE)""",
    "clicks": """
        SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'click'""",
    "user_days": """
        SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value, count(*) AS n
        FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    # order spans per customer
    "customer_spans": """
        SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n
        FROM orders GROUP BY o_custkey""",
    # scored documents: length rank as probability, quality label as target
    "scores": """
        SELECT l.doc_id, d.lang, l.quality AS target, 1.0 / (1.0 + exp(-(d.n_chars - 1500) / 1500.0)) AS probability
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    # cross-section: supplier-by-month score and the return that follows
    "signals": f"""
        SELECT security_id, date, target_end_date, forward_relative_return,
               CASE WHEN forward_relative_return > 0 THEN 1 ELSE 0 END AS target, predicted_probability
        FROM (SELECT l_suppkey AS security_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
                     CAST(CAST(date_trunc('month', l_shipdate) AS DATE) + INTERVAL '45' DAY AS DATE) AS target_end_date,
                     round(avg(l_discount) - 0.05 + sum(l_quantity) / 100000 + {_TIE}, 6) AS forward_relative_return,
                     round(avg(l_tax) * 10 + {_TIE}, 3) AS predicted_probability
              FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)) s
        WHERE predicted_probability <= 1""",
}

# oracle-only tables: plain SQL versions of derived tables, filled by the modules that check them
CHECKS: dict[str, str] = {}

# views that whole chains of tables start from: materialised once, not re-derived by each step
SHARED = {
    "raw_bars", "returned_bars", "symbol_bars", "priced", "filings", "landed_filings", "bar_factors", "research_rows", "panel",
    "archive_shares", "archive_ids", "archive_caps", "signals", "market_bars", "market_provider_bars", "bars",
}
# of these, what other views read too: they take the stored rows instead of aggregating the line items again
HELD = ("bars",)

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    """Views a text refers to, dependencies first."""
    found: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        words = set(_WORD.findall(text))
        for name in known:
            if name in words and name not in seen:
                seen.add(name)
                visit(known[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str, checks: bool = False, held: Collection[str] = ()) -> str:
    """Prefix a SELECT (or WITH ... SELECT) with the views it uses as common table expressions, but for those ``held`` as tables."""
    known = VIEWS | CHECKS if checks else {n: text for n, text in VIEWS.items() if n not in held}
    parts = [f"{name} AS ({known[name]})" for name in _needed(sql, known)]
    body = sql.strip()
    recursive = "RECURSIVE " if checks else ""
    if body.upper().startswith("WITH RECURSIVE "):
        body = "WITH " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}" + ", ".join([*parts, body[5:]])
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body


class Views:
    """Base tables and derived views of one folder as DataFrames, by attribute."""

    kept: dict[tuple, DataFrame] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in SHARED:
                self._known[name] = self.keep(name, lambda: self.sql(f"SELECT * FROM {name}", [h for h in HELD if h != name]))
            elif name in VIEWS:
                self._known[name] = self.sql(f"SELECT * FROM {name}")
            else:
                raise AttributeError(name)
        return self._known[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Materialise a derived table once per session and folder for all its readers."""
        key = (self.spark.sparkContext.applicationId, self.folder, build.__module__, name)
        if key not in Views.kept:
            Views.kept[key] = stage(build())
        return Views.kept[key]

    def keep_object(self, name: str, build: Callable[[], object]):
        """Fit a model once per session and folder for all its readers."""
        key = (self.spark.sparkContext.applicationId, self.folder, build.__module__, f"object:{name}")
        if key not in Views.kept:
            Views.kept[key] = build()
        return Views.kept[key]

    def sql(self, text: str, held: Collection[str] = HELD) -> DataFrame:
        """Run a SELECT over base tables and views."""
        full = with_views(text, held=held)
        for table in (*TABLES, *held):
            if re.search(rf"\b{table}\b", full):
                getattr(self, table).createOrReplaceTempView(table)
        return self.spark.sql(full)
