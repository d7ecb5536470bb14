"""Registry of named queries, each with an independent SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.catalog.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PENDING: list[tuple] = []


def _digits(spec: str) -> dict[str, int]:
    pairs = (item.split(":") for item in spec.split())
    return {name: int(digits[0]) if digits else 6 for name, *digits in pairs}


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = ""):
    """Register a function from ``Views`` to a DataFrame under ``name``.

    ``doubles`` lists columns ("name" or "name:digits") that both engines round, as
    sums of doubles depend on their order; a tiny offset keeps exact ties from
    falling on different sides. ``ints`` lists columns cast to bigint on both sides.
    """
    rounding, integers = _digits(doubles), ints.split()

    def decorate(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Views(spark, sf_dir))
            return df.select(
                *[
                    (F.round(F.col(c) + F.lit(1.234 * 10.0 ** -(rounding[c] + 2)), rounding[c]) + 0.0).alias(c)
                    if c in rounding
                    else F.col(c).cast("bigint").alias(c) if c in integers else F.col(c)
                    for c in df.columns
                ]
            )

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            PENDING.append((name, sql, rounding, integers))
        return build

    return decorate


def finish() -> None:
    """Assemble the SQL checks once every module has registered its tables."""
    for name, sql, rounding, integers in PENDING:
        replaced = [
            f"round({c} + {1.234 * 10.0 ** -(d + 2)!r}, {d}) + 0.0 AS {c}" for c, d in rounding.items()
        ] + [f"CAST({c} AS BIGINT) AS {c}" for c in integers]
        star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
        ORACLES[name] = f"SELECT {star} FROM ({with_views(sql, checks=True)}) AS result"
    PENDING.clear()
