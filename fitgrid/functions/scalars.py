"""Scalar expressions for preparing columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The number grammar of the lenient parser (no surrounding blanks,
# no type suffix), and its spellings of infinity and not-a-number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"
NOT_A_NUMBER = r"^[+-]?(?i:nan)$"


def to_double(col: Column | str, default: float = 0.0) -> Column:
    """Parse text as a double; whatever is not a number becomes ``default``."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return (
        F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.coalesce(text.try_cast("double"), F.lit(default)))
        .when(text.rlike(NOT_A_NUMBER), F.lit(float("nan")))
        .otherwise(F.lit(float(default)))
    )


def eq_target(col: Column | str, value) -> Column:
    """1 where the target equals ``value``, else 0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce((col == F.lit(value)).cast("int"), F.lit(0))


def above_target(col: Column | str, bound=0) -> Column:
    """1 where the value is above ``bound``, else 0; also for null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce((col > F.lit(bound)).cast("int"), F.lit(0))


def one_vs_others(col: Column | str, cls) -> Column:
    """Binary target: class ``cls`` against all others."""
    return eq_target(col, cls)


def delta(after: Column, before: Column) -> Column:
    return after - before


def clipped_delta(after: Column, before: Column) -> Column:
    """Difference that never goes below zero."""
    return F.greatest(F.lit(0.0), after - before)


def to_mb(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0)


def to_gb(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0 * 1024.0)


def size_class(rows: Column, small_below: int = 1000) -> Column:
    return F.when(rows < small_below, F.lit("small")).otherwise(F.lit("large"))
