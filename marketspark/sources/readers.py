"""Readers for stored tables, literal tables and provider evidence with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table by name (SRC-1)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet export; named columns are the only ones scanned (SRC-2)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def values_df(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table with an explicit schema (SRC-15)."""
    return spark.createDataFrame(list(rows), schema)


_REQUEST = "request_id string, provider string, provider_symbol string, status_code int, response_row_count bigint, error_text string, retrieved_at timestamp"
_PRICE = "open double, high double, low double, close double"

# Columns of the evidence tables, a request and its observations per kind.
EVIDENCE = {
    "price_request": f"{_REQUEST}, lineage_id bigint, lineage_code string, session_date date, historical_ticker string, lookup_method string, raw_payload_json string",
    "price": f"observation_id string, request_id string, provider string, provider_symbol string, lineage_id bigint, lineage_code string, session_date date, historical_ticker string, lookup_method string, {_PRICE}, provider_adjusted_close double, provider_volume bigint, retrieved_at timestamp, raw_payload_json string",
    "price_validation_request": f"{_REQUEST}, ticker string, start_date date, end_date date",
    "price_validation": f"provider string, ticker string, provider_symbol string, date date, {_PRICE}, adjusted_close double, volume bigint, retrieved_at timestamp",
    "split_request": f"{_REQUEST}, ticker string, window_start date, window_end date",
    "split": "observation_id string, request_id string, provider string, provider_symbol string, split_date date, split_text string, to_factor double, for_factor double, split_ratio double, retrieved_at timestamp",
    "split_full_history": "observation_id string, provider string, provider_symbol string, split_date date, to_factor double, for_factor double, split_ratio double, retrieved_at timestamp",
    "split_candidate_validation": "provider string, ticker string, provider_symbol string, ex_date date, split_ratio double, retrieved_at timestamp",
    "dividend": "observation_id string, request_id string, provider string, provider_symbol string, ex_date date, amount double, unadjusted_amount double, currency string, declaration_date date, record_date date, payment_date date, retrieved_at timestamp",
    "symbol_reference": "provider_symbol string, code string, name string, country string, exchange string, currency string, instrument_type string, isin string, is_delisted boolean, retrieved_at timestamp",
}


def evidence_schema(kind: str) -> T.StructType:
    """Schema of an evidence table (SRC-16)."""
    return T.StructType.fromDDL(EVIDENCE[kind])


def as_evidence(df: DataFrame, kind: str) -> DataFrame:
    """Project and cast to an evidence schema; a missing column is an error."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in evidence_schema(kind).fields])
