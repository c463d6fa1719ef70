"""Exact best first split of a decision tree under Gini impurity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..operators.features import class_values
from ..plans.running import ROWS_PER_RANGE, running_totals


def gini_root_split(
    df: DataFrame, features: Sequence[str], label: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per feature: the split ``x <= threshold`` with the least impurity.

    Rows are first counted per value and class, so the ordered pass sees every
    distinct value once, and the running counts are taken range by range.
    """
    classes = class_values(df, label)
    names = [f"c{i}" for i in range(len(classes))]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    counts = (
        df.select(F.col(label).alias("y"), each.alias("v"))
        .filter(F.col("v.x").isNotNull() & F.col("y").isNotNull())
        .groupBy("v.feature", "v.x")
        .agg(*[F.count_if(F.col("y") == F.lit(c)).alias(n) for n, c in zip(names, classes)])
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        sums = counts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).collect()
        totals = {r["feature"]: [r[n] for n in names] for r in sums}
        found = [
            _best_split(counts.filter(F.col("feature") == f), f, names, totals[f], rows_per_range)
            for f in features
            if f in totals
        ]
    finally:
        counts.unpersist()
    return df.sparkSession.createDataFrame(
        [f for f in found if f],
        "feature string, threshold double, impurity double, n_left bigint, n_right bigint",
    )


def _best_split(
    counts: DataFrame, feature: str, names: Sequence[str], total: Sequence[int], rows_per_range: int
) -> tuple | None:
    upto = running_totals(counts, ["x"], {f"l{n}": F.col(n) for n in names}, rows_per_range)
    left = [F.col(f"l{n}").cast("double") for n in names]
    right = [F.lit(float(t)) - c for t, c in zip(total, left)]
    n_left, n_right = sum(left[1:], left[0]), sum(right[1:], right[0])
    rows = float(sum(total))

    def impure(parts, size):
        return size - sum([c * c for c in parts[1:]], parts[0] * parts[0]) / size

    scored = (
        upto.withColumn("n_left", n_left)
        .filter(n_right > 0)
        .withColumn("impurity", (impure(left, n_left) + impure(right, n_right)) / F.lit(rows))
    )
    place = F.struct(F.round("impurity", 12).alias("i"), F.col("x").alias("x"))
    best = scored.agg(F.min_by(F.struct("x", "impurity", "n_left"), place)).first()[0]
    if best is None:
        return None
    return feature, best["x"], best["impurity"], int(best["n_left"]), int(rows - best["n_left"])
