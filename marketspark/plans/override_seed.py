"""Curated corporate actions under natural keys; ids are resolved when they are applied (TB-34)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "ticker string, event_date date, corporate_action_type string, dividend_share_basis string, original_split_ratio double, "
    "original_dividend_amount double, override_split_ratio double, override_dividend_amount double, override_dividend_ex_date date, "
    "override_split_effective_date date, resolution_source string, source_reference string, resolution_notes string"
)

# Ticker, event date, action, share basis of the dividend, stated ratio and amount,
# accepted ratio and amount, accepted ex-date and split date; a dash is no value.
SEED = """
AIV   2019-02-21 composite_cash_and_in_kind_distribution unresolved 1.03125 0.39 1.0 - 2019-02-21 -
AIV   2020-11-03 composite_cash_and_in_kind_distribution unresolved 1.0 8.2 1.0 - 2020-11-03 -
BWLP  2026-03-13 cash_dividend_currency_correction pre_split 1.0 5.4297 1.0 0.57 2026-03-13 -
BWLP  2026-06-12 cash_dividend_currency_correction pre_split 1.0 6.196 1.0 0.67 2026-06-12 -
BWLP  2026-09-08 cash_dividend_currency_correction pre_split 1.0 8.8914 1.0 0.95 2026-09-08 -
CASS  2017-12-04 stock_dividend_plus_cash_dividend post_split 1.1 0.24 1.1 0.24 - -
CASS  2018-12-03 stock_dividend_plus_cash_dividend post_split 1.2 0.21666 1.2 0.26 - -
CBSH  2024-12-03 cash_dividend_plus_stock_dividend pre_split 1.05 0.27 1.05 0.27 - -
CBSH  2025-12-02 cash_dividend_plus_stock_dividend pre_split 1.05 0.275 1.05 0.275 - -
CIM   2014-01-06 cash_dividend pre_split 1.0 1.0 1.0 0.2 2014-01-06 -
CMCT  2019-09-03 cash_plus_reverse_split pre_split 0.3333333333333333 14.0 0.3333333333333333 14.0 - -
CRESY 2025-11-28 composite_cash_and_in_kind_distribution pre_split 1.025 0.62934 - 0.629341 - -
CTRE  2014-10-29 composite_cash_and_in_kind_distribution unresolved 1.0 5.88 1.0 - 2014-12-11 -
CZFS  2025-06-13 cash_dividend_plus_stock_dividend pre_split 1.01 0.495 1.01 0.495 2025-06-13 2025-06-13
EXPE  2011-12-21 composite_cash_and_in_kind_distribution unresolved 1.0 15.125 1.0 - 2011-12-21 -
FER   2026-05-19 scrip_or_cash_dividend pre_split 1.0096541310992386 0.5578 1.0 0.6472 2026-05-18 -
FSK   2020-06-16 reverse_split post_split 0.25 0.6 0.25 0.6 - -
IDT   2011-10-31 composite_cash_and_in_kind_distribution unresolved 1.0 7.72612 1.0 - 2011-10-31 -
MDLZ  2012-10-02 composite_cash_and_in_kind_distribution unresolved 1.0 14.173 1.0 - 2012-10-02 -
METC  2024-12-02 in_kind_dividend_other_share_class pre_split 1.01 0.1375 1.0 0.1375 2024-12-02 -
METC  2025-02-28 in_kind_dividend_other_share_class pre_split 1.014 0.1375 1.0 0.1375 2025-02-28 -
METCB 2024-12-02 stock_dividend not_applicable 1.0237349397590363 0.2364 1.0237349397590363 0.0 2024-12-02 2024-12-02
NGG   2024-11-22 scrip_or_cash_dividend pre_split 1.01646 1.0196 1.0 1.0196 - -
NGG   2025-05-30 scrip_or_cash_dividend pre_split 1.02922 2.0545 1.0 2.0545 - -
NGG   2025-11-21 scrip_or_cash_dividend pre_split 1.01435 1.0657 1.0 1.0657 - -
PEBK  2017-12-01 cash_dividend_then_stock_dividend pre_split 1.1 0.12 1.1 0.12 - -
PHG   2026-05-13 scrip_or_cash_dividend pre_split 1.03712 1.01303 1.0 1.01303 - -
PRTK  2014-10-22 cash_dividend pre_split 1.0 8.004 1.0 8.01 2014-10-31 -
QGEN  2017-01-25 cash_plus_share_consolidation pre_split 0.962 1.087 0.9629629629629629 1.04 - -
QGEN  2024-01-30 cash_plus_share_consolidation pre_split 0.97 1.32 0.97 1.28 - -
QGEN  2025-01-29 cash_plus_share_consolidation pre_split 0.9722222222222222 1.26 0.9722222222222222 1.26 - -
RAND  2020-05-12 composite_cash_and_in_kind_distribution unresolved 1.0 1000.0 1.0 - 2020-05-12 -
SBS   2025-12-29 gross_cash_plus_stock_dividend pre_split 1.02964 0.4772 1.029646975 0.4772 2025-12-29 2025-12-29
SCCO  2024-11-06 cash_dividend_plus_stock_dividend pre_split 1.0062 0.7 1.0062 0.7 2024-11-06 2024-11-06
SCCO  2025-02-11 cash_dividend_plus_stock_dividend pre_split 1.0073 0.7 1.0073 0.7 2025-02-11 2025-02-11
SCCO  2025-05-02 cash_dividend_plus_stock_dividend pre_split 1.0099 0.7 1.0099 0.7 2025-05-02 2025-05-02
SCCO  2025-08-15 cash_dividend_plus_stock_dividend pre_split 1.0101 0.8 1.0101 0.8 2025-08-15 2025-08-15
SCCO  2025-11-12 cash_dividend_plus_stock_dividend pre_split 1.0085 0.9 1.0085 0.9 2025-11-12 2025-11-12
SCCO  2026-05-13 cash_dividend_plus_stock_dividend pre_split 1.01 1.0 1.01 1.0 2026-05-13 2026-05-13
SCCO  2026-08-11 cash_dividend_plus_stock_dividend pre_split 1.012 1.1 1.012 1.1 2026-08-11 2026-08-11
SLGN  2017-05-30 stock_split_plus_cash_dividend post_split 2.0 0.09 2.0 0.09 - -
SRV   2020-06-12 cash_dividend pre_split 1.0 786.432 1.0 0.192 2020-06-12 -
TR    2025-03-05 cash_dividend_plus_stock_dividend pre_split 1.03 0.09 1.03 0.09 2025-03-05 2025-03-05
TR    2026-03-05 cash_dividend_plus_stock_dividend pre_split 1.03 0.09 1.03 0.09 2026-03-05 2026-03-05
TRI   2023-06-23 cash_plus_share_consolidation pre_split 0.963 4.845 0.963957 4.67 - -
TRI   2026-05-04 cash_plus_share_consolidation pre_split 0.9845620667926906 1.43551 0.98456 1.435518 2026-05-04 2026-05-04
VISN  2026-08-17 cash_dividend pre_split 1.0 5.0 1.0 5.0 2026-08-28 -
"""

# What the resolution of an event rests on; by ticker where it is not the issuer's own statement.
ISSUER = "issuer_primary_source"
SOURCES = {
    "CMCT": "issuer_and_exchange_primary_source",
    "CRESY": "issuer_and_exchange_primary_source",
    "CTRE": "issuer_exchange_primary_source",
    "FER": "issuer_primary_source_plus_provider_fx_conversion",
    "NGG": "issuer_primary_source_plus_vendor_cash_amount",
    "PHG": "issuer_primary_source_plus_vendor_cash_amount",
    "SBS": "issuer_primary_source_plus_gross_vendor_conversion",
    "SRV": "provider_historical_unadjusted",
}


def _changed(numbers: list) -> str:
    """What the resolution changes of the stated ratio and amount."""
    ratio, amount, accepted_ratio, accepted_amount = numbers
    parts = []
    if accepted_ratio is not None and accepted_ratio != ratio:
        parts.append(f"ratio {ratio} replaced by {accepted_ratio}")
    if accepted_amount is None:
        parts.append(f"amount {amount} not a cash dividend")
    elif accepted_amount != amount:
        parts.append(f"amount {amount} replaced by {accepted_amount}")
    return "; ".join(parts) or "stated ratio and amount confirmed"


def override_seed(spark: SparkSession) -> DataFrame:
    """The curated events as input of ``corporate_action_overrides``."""

    def day(text: str):
        return None if text == "-" else date.fromisoformat(text)

    def number(text: str):
        return None if text == "-" else float(text)

    rows = []
    for line in SEED.split("\n"):
        if not line.strip():
            continue
        ticker, event, kind, basis, *rest = line.split()
        numbers, days = [number(x) for x in rest[:4]], [day(x) for x in rest[4:]]
        rows.append((ticker, day(event), kind, basis, *numbers, *days, SOURCES.get(ticker, ISSUER), f"{ticker} {event} {kind}", _changed(numbers)))
    return spark.createDataFrame(rows, SCHEMA)
