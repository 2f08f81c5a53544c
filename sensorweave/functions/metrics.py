"""Error and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.operators.quantiles import range_buckets


def huber_loss(error: Column, delta: float = 1.0) -> Column:
    """Quadratic up to ``delta``, linear beyond."""
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * size - 0.5 * delta * delta)


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Prediction next to actual with ``residual`` (G19); both must already share a row."""
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def abs_error_summary(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum, mean and maximum of the absolute error."""
    e = F.abs(F.col(actual) - F.col(predicted))
    return df.groupBy(*by).agg(F.sum(e).alias("error_sum"), F.avg(e).alias("error_avg"), F.max(e).alias("error_max"))


def regression_summary(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, mean absolute percentage error (A23), mean Huber loss (A24), half SSE."""
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(100 * F.abs(F.try_divide(e, F.col(actual)))).alias("mape"),
        F.avg(huber_loss(e)).alias("huber"), (F.sum(e * e) / 2).alias("half_sse"))


def binary_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (A26); a ratio without cases is 0."""
    y, p = F.col(actual), F.col(predicted)

    def count(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    counts = df.agg(count((y == 1) & (p == 1)).alias("tp"), count((y == 0) & (p == 1)).alias("fp"),
                    count((y == 1) & (p == 0)).alias("fn"), count((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def average_precision(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Sum over score thresholds of (recall step) x precision.

    Positives and negatives are counted per distinct score, then per score range; running totals
    inside a range start from the totals of the higher ranges, so no task orders all scores.
    """
    y = F.col(actual)
    per_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum((y == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ranged = range_buckets(per_score, "_s")
    higher = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most 1024 rows
    whole = Window.partitionBy()
    totals = ranged.groupBy("_bucket").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn")).select(
        "_bucket", F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_bn").over(higher), F.lit(0)).alias("_n0"), F.sum("_bp").over(whole).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    steps = ranged.join(F.broadcast(totals), "_bucket").select(
        "_p", "_all", ((F.sum("_p").over(inside) + F.col("_p0")) / (F.sum("_n").over(inside) + F.col("_n0"))).alias("_prec"))
    return steps.agg(F.sum(F.try_divide(F.col("_p"), F.col("_all")) * F.col("_prec")).alias("average_precision"))
