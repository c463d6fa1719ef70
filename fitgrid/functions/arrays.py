"""Expressions over one array column per row; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def normalise_array(col: Column | str, scale: float, mean: float, std: float) -> Column:
    """``(x / scale - mean) / std`` for every entry."""
    return F.transform(_col(col), lambda x: (x.cast("double") / F.lit(float(scale)) - mean) / std)


def argmax(col: Column | str) -> Column:
    """0-based position of the first maximum."""
    col = _col(col)
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def dot(left: Column | str, right: Column | str) -> Column:
    pairs = F.zip_with(_col(left), _col(right), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(left: Column | str, right: Column | str) -> Column:
    pairs = F.zip_with(_col(left), _col(right), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def cross_entropy(scores: Column | str, label: Column | str) -> Column:
    """Loss of the true class under softmax; the maximum is taken out first."""
    scores = _col(scores)
    top = F.array_max(scores)
    mass = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.ln(mass) + top - F.try_element_at(scores, _col(label).cast("int") + 1)


def vote_first_positive(votes: Column | str, default: int = 0) -> Column:
    """Index of the lowest class that voted 1; ``default`` when none did."""
    place = F.array_position(_col(votes), 1)
    return F.when(place > 0, place - 1).otherwise(F.lit(default)).cast("int")
