"""The rule for vectors that models learn from: every row counts, so every row has to be complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def complete_vectors(df: DataFrame, col: str = "x") -> tuple[int, int]:
    """Rows and length of the vectors in ``col``, an array of doubles.

    Null vectors, null or non-finite components and unequal lengths are refused with their number:
    one such row would make sums undefined, and leaving it out is the caller's decision. No rows
    are refused too.
    """
    x = F.col(col)
    broken = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows, bad, shortest, longest = df.agg(F.count(F.lit(1)), F.count_if(broken), F.min(F.size(x)), F.max(F.size(x))).first()
    if not rows:
        raise ValueError("there are no rows")
    if bad:
        raise ValueError(f"{bad} of {rows} vectors are null or hold components that are null or not finite")
    if shortest != longest:
        raise ValueError(f"vectors have from {shortest} to {longest} components")
    return rows, longest
