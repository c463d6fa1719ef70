"""Votes of one-vs-rest machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ovr_vote(df: DataFrame, key: str, cls: str, vote: str, first_class, out: str = "prediction") -> DataFrame:
    """One row per key: the lowest class with vote 1, or ``first_class`` without any."""
    lowest = F.min(F.when(F.col(vote) == 1, F.col(cls)))
    return df.groupBy(key).agg(F.coalesce(lowest, F.lit(first_class)).alias(out))
