"""Quality of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _hit(label: str, pred: str):
    return F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("int")


def accuracy(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(_hit(label, pred)).alias("accuracy"))


def accuracy_pct(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correct and total counts with the share in percent."""
    counted = df.groupBy(*keys).agg(
        F.sum(_hit(label, pred)).cast("bigint").alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("accuracy_pct", F.try_divide(100.0 * F.col("correct"), F.col("total")))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_wide(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """Confusion matrix with one column per predicted class."""
    return df.groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(F.col(pred) == F.lit(c)).alias(f"pred_{c}") for c in classes]
    )


def accuracy_from_confusion(matrix: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return matrix.agg(F.try_divide(right.cast("double"), F.sum("n")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Mean over classes of the share recognised."""
    per_class = df.groupBy(label).agg(F.avg(_hit(label, pred)).alias("recall"))
    return per_class.agg(F.avg("recall").alias("balanced_accuracy"))


def r2(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Coefficient of determination in one pass; null for a constant label."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    spread = F.var_pop(y) * F.count(y)
    return df.agg((1 - F.try_divide(F.sum((y - p) * (y - p)), spread)).alias("r2"))


def epoch_curve(df: DataFrame, epoch: str, loss: str, ts: str | None = None) -> DataFrame:
    """Mean batch loss per epoch in order, with its duration when ``ts`` is given."""
    aggs = [F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("batches")]
    if ts:
        aggs.append(F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)).alias("_us"))
    curve = df.groupBy(epoch).agg(*aggs)
    if ts:
        curve = curve.withColumn("epoch_seconds", F.col("_us") / 1e6).drop("_us")
    return curve.orderBy(epoch)
