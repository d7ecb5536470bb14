"""Landed provider JSON as rows. Parsing is declarative; rows that do not parse are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import normalize_cik, valid_bar
from marketspark.operators.quality import digest_matches
from marketspark.session import bounded_broadcast


def json_observations(
    df: DataFrame, payload: str, fields: dict[str, tuple[str, str]], required: Sequence[str]
) -> DataFrame:
    """Rows of a JSON list (SRC-3).

    ``fields`` maps an output to (JSON name, type). Values are read as text and cast,
    so one bad value nulls a field, not the list; rows without a required field go.
    """
    names = sorted({source for source, _ in fields.values()})
    schema = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
    rows = df.withColumn("_row", F.explode(F.from_json(payload, schema))).select(
        *[c for c in df.columns if c != payload],
        *[F.col(f"_row.`{source}`").try_cast(kind).alias(out) for out, (source, kind) in fields.items()])
    return rows.dropna(subset=list(required))


def json_map_rows(df: DataFrame, payload: str, shares: str = "commonStockSharesOutstanding") -> DataFrame:
    """Rows of a JSON object keyed by period; counts that are blank, zero or negative are null (SRC-4)."""
    value = f"struct<date:string,filing_date:string,currency_symbol:string,`{shares}`:string>"
    rows = df.select(
        *[c for c in df.columns if c != payload], F.explode(F.from_json(payload, f"map<string,{value}>")).alias("_period", "_row"))
    count = F.col(f"_row.`{shares}`").try_cast("double")
    return rows.where("_row IS NOT NULL").select(
        *[c for c in df.columns if c != payload],
        F.coalesce(F.nullif("_row.date", F.lit("")), "_period").try_cast("date").alias("period_date"),
        F.nullif("_row.filing_date", F.lit("")).try_cast("date").alias("filing_date"),
        F.when(count > 0, count).alias("shares_outstanding"), F.col("_row.currency_symbol").alias("currency_symbol"))


_ENTITY = (
    "struct<cik:string,name:string,entityType:string,sic:string,tickers:array<string>,exchanges:array<string>,"
    "formerNames:array<struct<name:string,`from`:string,`to`:string>>>"
)


def explode_submissions(df: DataFrame, payload: str) -> dict[str, DataFrame]:
    """Entity, ticker and former-name tables of entity JSON (SRC-5).

    Tickers and exchanges are parallel lists; a missing exchange is null.
    """
    parsed = df.select(F.from_json(payload, _ENTITY).alias("e")).select(normalize_cik("e.cik").alias("cik"), "e.*")
    parsed = parsed.toDF("cik", "_raw_cik", *parsed.columns[2:]).drop("_raw_cik")
    entities = parsed.select("cik", F.col("name").alias("entity_name"), F.col("entityType").alias("entity_type"), "sic")
    tickers = parsed.select("cik", F.posexplode("tickers").alias("_i", "ticker"), "exchanges").select(
        "cik", "ticker", F.get("exchanges", F.col("_i")).alias("exchange"))
    former = parsed.select("cik", F.explode("formerNames").alias("f")).select(
        "cik", F.col("f.name").alias("former_name"), F.col("f.from").alias("from_date"), F.col("f.to").alias("to_date"))
    return {"entity": entities, "ticker": tickers, "former_name": former}


def zip_columns(df: DataFrame, payload: str, fields: Sequence[str]) -> DataFrame:
    """Rows of a columnar JSON block: one list per field (SRC-6)."""
    schema = "struct<" + ",".join(f"`{f}`:array<string>" for f in fields) + ">"
    others = [c for c in df.columns if c != payload]
    parsed = df.select(*others, F.from_json(payload, schema).alias("b"))
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"b.`{f}`"), F.array().cast("array<string>")).alias(f) for f in fields])
    return parsed.select(*others, F.inline(zipped))


def flatten_facts(df: DataFrame, payload: str, taxonomy: str, concept: str) -> DataFrame:
    """Facts of one concept: every unit and every reported value (SRC-7)."""
    fact = "array<struct<val:double,`end`:string,filed:string,form:string,accn:string,frame:string>>"
    schema = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<units:map<string,{fact}>>>>>"
    parsed = df.select(F.from_json(payload, schema).alias("d"))
    units = parsed.select(
        normalize_cik("d.cik").alias("cik"), F.col("d.entityName").alias("entity_name"),
        F.explode(F.col("d.facts")[taxonomy][concept]["units"]).alias("unit", "facts"))
    return units.select("cik", "entity_name", "unit", F.explode("facts").alias("f")).select(
        "cik", "entity_name", "unit", F.col("f.val").alias("shares_outstanding"), F.to_date("f.end").alias("shares_as_of_date"),
        F.to_date("f.filed").alias("filed_date"), F.col("f.form").alias("form"), F.col("f.accn").alias("accession_number"))


def explode_ticker_map(df: DataFrame, payload: str) -> DataFrame:
    """Rows of a JSON object keyed by ticker (SRC-8)."""
    value = "struct<cik:string,old_ticker:string,flat_file_only:boolean>"
    return df.select(F.explode(F.from_json(payload, f"map<string,{value}>")).alias("ticker", "v")).select(
        "ticker", "v.cik", "v.old_ticker", F.coalesce("v.flat_file_only", F.lit(False)).alias("flat_file_only"))


def bulk_day_rows(responses: DataFrame, bracketed: DataFrame) -> DataFrame:
    """Bars of archived bulk files for tickers known on both neighbouring sessions (SRC-14).

    The stored digest and every row's date are verified. A dashed code is read as a
    dotted ticker only when the dotted one is known and the code itself is not.
    ``bracketed`` has (date, ticker).
    """
    checked = responses.withColumn("_bytes", digest_matches("raw_response_bytes", "response_sha256"))
    fields = "array<struct<date:string,code:string,open:double,high:double,low:double,close:double,volume:bigint>>"
    rows = checked.select(
        F.col("requested_date").alias("date"), "response_sha256",
        F.explode(F.from_json(F.decode("_bytes", "UTF-8"), fields)).alias("r"))
    same_day = F.when(F.col("r.date") == F.col("date").cast("string"), F.col("r.code")).otherwise(
        F.raise_error(F.lit("bulk response holds another date")))
    rows = rows.select("date", "response_sha256", same_day.alias("provider_code"), "r.open", "r.high", "r.low", "r.close", "r.volume")
    known = bounded_broadcast(bracketed.select("date", "ticker").distinct())
    exact = rows.join(known, (rows.date == known.date) & (rows.provider_code == known.ticker), "left_semi").withColumn(
        "ticker", F.col("provider_code"))
    rest = rows.join(known, (rows.date == known.date) & (rows.provider_code == known.ticker), "left_anti").withColumn(
        "ticker", F.replace("provider_code", F.lit("-"), F.lit(".")))
    aliased = rest.join(known, ["date", "ticker"], "left_semi").select(*exact.columns)
    both = exact.unionByName(aliased).withColumn("bar_valid", valid_bar())
    return both.withColumns({c: F.when(F.col("bar_valid"), F.col(c)) for c in ("open", "high", "low", "close", "volume")})
