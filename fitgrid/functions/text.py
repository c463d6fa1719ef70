"""Text formats used in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(col: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, half to even; ``nan`` when missing.

    ``format_string`` would round the shortest decimal spelling half up instead.
    """
    pattern = F.lit("0." + "0" * digits if digits else "0")
    shown = F.call_function("format_number", col, pattern)
    return F.when(col.isNotNull() & ~F.isnan(col), shown).otherwise(F.lit("nan"))


def fmt_mean_std(mean: Column, std: Column, digits: int) -> Column:
    """``mean±std``; a missing deviation prints as ``nan``."""
    return F.concat(fixed(mean, digits), F.lit("±"), fixed(std, digits))


def thousands(col: Column) -> Column:
    """Whole number with commas between groups of three digits."""
    return F.format_number(col, 0)


def title_case(col: Column) -> Column:
    """Capital first letter in every run of letters, also after a hyphen or underscore."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def file_stem(path: Column) -> Column:
    """Last path component without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def long_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
