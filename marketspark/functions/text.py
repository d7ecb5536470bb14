"""Name similarity, the one text comparison Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.functions.scalars import alphanumeric


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two strings, 1.0 for equal ones."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    )


def name_similarity(
    left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str, out: str = "best_name_similarity"
) -> DataFrame:
    """Best similarity of normalised names per exact key.

    Names are made distinct per key first, and a key that has one name on both sides
    scores 1.0 at once, so only keys without an equal name compare their names.
    """
    a = left.select(key, alphanumeric(left_name).alias("_a")).where(F.col("_a").isNotNull()).distinct()
    b = right.select(key, alphanumeric(right_name).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    equal = a.join(b.withColumnRenamed("_b", "_a"), [key, "_a"], "left_semi").select(key).distinct()
    rest = a.join(equal, key, "left_anti").join(b, key).withColumn("_s", similarity("_a", "_b"))
    return (
        rest.groupBy(key).agg(F.max("_s").alias(out)).unionByName(equal.withColumn(out, F.lit(1.0)))
    )
