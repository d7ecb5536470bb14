"""Classifiers on the feature table, fitted by Spark ML, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.quality import assert_rules, finite, leakage_rules, validate_schema
from marketspark.plans import crosssection as C
from marketspark.plans import metrics as M
from marketspark.sources.sinks import write_csv, write_json, write_parquet

KEYS = ("security_id", "date", "ticker", "target_end_date")


def base_rate(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row gets the share of positives in the training rows (ML-1)."""
    prior = train.agg(F.avg(F.col("target").cast("double"))).scalar()
    return rows.withColumn("predicted_probability", prior)


def validate_model_rows(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fail before a fit on missing columns, features that are no finite numbers, or targets other than 0 and 1; one pass."""
    validate_schema(rows, ["target", *features])
    assert_rules(rows, {f"{name}_not_finite": finite(name) for name in features} | {"target_not_0_or_1": F.col("target").isin(0, 1)})
    return rows


def validate_sample(rows: DataFrame, features: Sequence[str], start: str, end: str) -> DataFrame:
    """As :func:`validate_model_rows`, and fail if a date or the end of its label lies outside the sample's split."""
    validate_schema(rows, [*KEYS, "forward_relative_return"])
    assert_rules(rows, {f"split_{name}": rule for name, rule in leakage_rules(start, end).items()})
    return validate_model_rows(rows, features)


def _assembler(features: Sequence[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def fit_logistic(train: DataFrame, features: Sequence[str], max_iter: int = 500) -> PipelineModel:
    """Standardised logistic regression with the unit ridge penalty on summed losses (ML-2)."""
    n = validate_model_rows(train, features).count()
    return Pipeline(stages=[
        _assembler(features, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_scaled", labelCol="target", maxIter=max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False),
    ]).fit(train)


def fit_gbt(
    train: DataFrame, features: Sequence[str], seed: int = 42, max_iter: int = 200, held_out: float = 0.1
) -> PipelineModel:
    """Boosted trees with early stopping on a hash-chosen share of the training rows (ML-3)."""
    validate_model_rows(train, features)
    bucket = F.pmod(F.xxhash64("security_id", "date", F.lit(seed)), F.lit(1000)) < int(held_out * 1000)
    return Pipeline(stages=[
        _assembler(features, "_raw"),
        GBTClassifier(
            featuresCol="_raw", labelCol="target", maxIter=max_iter, stepSize=0.08, maxDepth=5, minInstancesPerNode=40,
            seed=seed, validationIndicatorCol="_held_out", validationTol=0.001),
    ]).fit(train.withColumn("_held_out", bucket))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Probability of the positive class."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("predicted_probability"))


def prediction_frame(scored: DataFrame, model: str, horizon: int, sample: str = "validation") -> DataFrame:
    """Predictions with what is needed to evaluate them (ML-4)."""
    return scored.select(
        *KEYS, F.lit(model).alias("model"), F.lit(horizon).alias("horizon"), F.lit(sample).alias("sample"),
        F.col("target").cast("int").alias("target"), F.col("forward_relative_return").cast("double").alias("forward_relative_return"),
        F.col("predicted_probability").cast("double").alias("predicted_probability"))


def evaluate_and_persist(predictions: DataFrame, folder: str, model: str, horizon: int) -> DataFrame:
    """Write the predictions and every evaluation table of one run; return its summary row (RUN-1)."""
    place = f"{folder}/{model}/{horizon}d"
    write_parquet(predictions, f"{place}/predictions")
    rows = predictions.sparkSession.read.parquet(f"{place}/predictions")
    quality = M.evaluate_predictions(rows, "target", "predicted_probability")
    bins = M.calibration(rows, "target", "predicted_probability", ["security_id", "date"])
    tables = C.evaluate_cross_section(rows, horizon)
    write_csv(bins, f"{place}/calibration")
    for name in ("daily_decile_returns", "decile_statistics", "daily_rank_ic"):
        write_csv(tables[name], f"{place}/{name}")
    write_csv(C.payoff_indices(tables["ranked"], horizon), f"{place}/payoff_indices")
    summary = C.run_summary(tables, model, horizon).drop("n").withColumns({
        c: quality.select(c).scalar() for c in quality.columns
    }).withColumn("expected_calibration_error", M.expected_calibration_error(bins).scalar())
    write_json(summary, f"{place}/summary")
    return summary
