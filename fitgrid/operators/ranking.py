"""Rows at the ends of an order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# What makes a run the champion, with the direction that wins.
OBJECTIVES = {
    "fastest_training": ("train_time_sec_mean", "min"),
    "fastest_inference": ("inference_time_sec_mean", "min"),
    "best_accuracy": ("accuracy_mean", "max"),
    "most_efficient": ("memory_usage_mb_mean", "min"),
}


def first_n(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in order; each task keeps at most ``n`` candidates."""
    return df.orderBy(*order_by).limit(n)


def champions(
    df: DataFrame,
    objectives: Mapping[str, tuple[str, str]],
    names: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Winner of every objective, overall or per group; ties go to the lowest name.

    An objective whose metric is null everywhere has no winner. One aggregate finds
    all winners; rows ``(*keys, objective, *names, value)``.
    """
    aggs = []
    for title, (metric, direction) in objectives.items():
        value = F.col(metric).cast("double")
        rank = F.struct((value if direction == "min" else -value).alias("v"), *names)
        record = F.struct(F.lit(title).alias("objective"), *names, value.alias("value"))
        aggs.append(F.min_by(record, F.when(value.isNotNull(), rank)))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    found = F.filter(F.array(*aggs), lambda x: x.isNotNull())
    return grouped.agg(found.alias("found")).select(*keys, F.inline("found"))
