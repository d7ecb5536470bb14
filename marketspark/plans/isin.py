"""Names and ISINs of a dated market-cap list against a symbol reference (TB-64)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import alphanumeric
from marketspark.functions.text import name_similarity
from marketspark.operators.aggregates import distinct_list
from marketspark.operators.joins import count_over
from marketspark.session import stage


def _valid(observations: DataFrame) -> DataFrame:
    """The rows with a valid ISIN, written once, as they are read several times and the list is parsed by each reader."""
    rows = observations.where("parse_status = 'valid_isin'")
    return stage(rows.select("observation_date", "isin", "source_row_number", F.trim("raw_company_name").alias("name"), "mktcap_as_supplied"))


def duplicate_listings(observations: DataFrame) -> DataFrame:
    """Dates on which an ISIN is listed more than once, with every listed name and cap."""
    counted = count_over(_valid(observations), ["observation_date", "isin"], "listings")
    return counted.where("listings > 1").select("observation_date", "isin", "source_row_number", "name", "mktcap_as_supplied", "listings")


def invalid_isins(observations: DataFrame) -> DataFrame:
    """Rows per malformed ISIN."""
    return observations.where("parse_status = 'invalid_isin'").groupBy("isin").agg(F.count(F.lit(1)).alias("rows"))


def isin_profile(observations: DataFrame) -> DataFrame:
    """Span, names, latest cap and conflicting listings per ISIN."""
    rows = _valid(observations)
    order = F.struct("observation_date", -F.col("source_row_number"))
    spans = rows.groupBy("isin").agg(
        F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"),
        F.max_by("name", order).alias("latest_name"), F.count_distinct("name").alias("name_variants"), F.count(F.lit(1)).alias("rows"),
        F.max_by("mktcap_as_supplied", order).alias("latest_mktcap_as_supplied"))
    names = distinct_list(rows, ["isin"], "name", "all_names", " | ")
    conflicting = rows.groupBy("isin", "observation_date").agg(
        F.count_distinct(F.struct("name", "mktcap_as_supplied")).alias("_v")).groupBy("isin").agg(
        (F.max("_v") > 1).alias("conflicting_duplicate"))
    return spans.join(names, "isin").join(conflicting, "isin")


def isin_name_comparison(observations: DataFrame, references: DataFrame) -> DataFrame:
    """Do the list and the reference agree on a name for an ISIN? (text is evidence, not an identity)"""
    own = stage(observations.where("parse_status = 'valid_isin'").select("isin", F.trim("raw_company_name").alias("name")).distinct())
    known = stage(references.where("isin IS NOT NULL AND trim(isin) <> ''").select(F.upper(F.trim("isin")).alias("isin"), F.col("name").alias("other")).distinct())
    equal = own.withColumn("_n", alphanumeric("name")).join(
        known.withColumn("_n", alphanumeric("other")), ["isin", "_n"], "left_semi").select("isin", F.lit(True).alias("_equal")).distinct()
    scores = name_similarity(own, known, "isin", "name", "other")
    joined = own.select("isin").distinct().join(known.select("isin", F.lit(True).alias("_known")).distinct(), "isin", "left").join(
        equal, "isin", "left").join(scores, "isin", "left")
    status = F.when(F.col("_known").isNull(), "no_reference_isin").when(F.col("_equal"), "exact_normalized_alias").otherwise("name_review")
    return joined.select("isin", status.alias("name_status"), "best_name_similarity")
