"""Quality of predicted probabilities: one pass of aggregates plus exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.ranking import equal_buckets, value_places

EPSILON = 2.0 ** -52  # spacing of doubles at one: keeps logarithms finite


def _clip(p):
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))


def roc_auc(df: DataFrame, target: str, probability: str) -> DataFrame:
    """Area under the ROC curve from mean ranks of the positives; null with one class (PM-1).

    Rows are counted per score before scores are ranked, so ties cost nothing.
    """
    scored = df.select(F.col(target).cast("double").alias("_y"), _clip(F.col(probability)).alias("_p"))
    places = value_places(scored, [], "_p", [F.sum("_y").alias("_ones"), F.count("_y").alias("_known")], "_first", "_last")
    rank = (F.col("_first") + F.col("_last")) / 2
    sums = places.agg(F.sum("_ones").alias("_pos"), F.sum("_known").alias("_n"), F.sum(F.col("_ones") * rank).alias("_r"))
    pos, neg = F.col("_pos"), F.col("_n") - F.col("_pos")
    return sums.select(F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"))


def _loss(y, p):
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def probability_metrics(df: DataFrame, target: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Log loss, Brier score and accuracy next to the same for the base rate (PM-2 to PM-5).

    The base rate is constant, so its scores follow from the share of positives.
    Targets other than 0 and 1 and probabilities outside [0, 1] fail the job.
    """
    y, p = F.col(target), F.col(probability)
    bad = ~F.coalesce(y.isin(0, 1) & p.between(0, 1), F.lit(False))
    checked = df.select(
        F.when(bad, F.raise_error(F.lit("target must be 0 or 1 and probability in [0, 1]"))).otherwise(y).cast("double").alias("_y"),
        _clip(p).alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    sums = checked.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("positive_rate"), F.avg("_p").alias("mean_prediction"),
        F.avg(_loss(y, p)).alias("log_loss"), F.avg((p - y) ** 2).alias("brier_score"),
        F.avg(((p >= threshold).cast("int") == y).cast("double")).alias("accuracy"))
    rate, base = F.col("positive_rate"), _clip(F.col("positive_rate"))
    return sums.withColumns({
        "base_rate_accuracy": F.when(rate >= threshold, rate).otherwise(1 - rate),
        "base_rate_log_loss": -(rate * F.ln(base) + (1 - rate) * F.ln(1 - base)),
        "base_rate_brier_score": rate * (base - 1) ** 2 + (1 - rate) * base ** 2,
    })


def evaluate_predictions(df: DataFrame, target: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """All probability metrics in one row."""
    auc = roc_auc(df, target, probability)
    return probability_metrics(df, target, probability, threshold).withColumn("roc_auc", auc.scalar())


def calibration(df: DataFrame, target: str, probability: str, tie: list[str], bins: int = 10) -> DataFrame:
    """Equal-frequency bins by probability rank, ties broken by ``tie`` (PM-6)."""
    binned = equal_buckets(df.select(target, probability, *tie), [], [probability, *tie], bins, "calibration_bin")
    table = binned.groupBy("calibration_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_prediction"),
        F.avg(F.col(target).cast("double")).alias("observed_rate"))
    return table.withColumn("calibration_error", F.col("mean_prediction") - F.col("observed_rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """Row-weighted mean absolute calibration error (PM-7)."""
    gap = F.abs(F.col("mean_prediction") - F.col("observed_rate"))
    return table.agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("expected_calibration_error"))
