"""Feature preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.joins import lookup_join

MAX_CLASSES = 10_000
FLAT = 1e-8


def split_xy(df: DataFrame, target: str | None = None, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and target as two frames; the last column is the target by default.

    Columns named in ``key`` stay in both so that the two can be joined again.
    """
    target = target or df.columns[-1]
    return df.drop(target), df.select(*key, target)


def assemble(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), out: str = "features") -> DataFrame:
    """One array column: numeric columns first, encoded columns after, in the order given."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in [*numeric, *categorical]]))


def class_values(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> list:
    """Sorted distinct target values; refuses a target that is no class label."""
    count = df.agg(F.approx_count_distinct(target)).first()[0]
    if count > 2 * max_classes:
        raise ValueError(f"{target} has about {count} values, more than {max_classes} classes")
    return [r[0] for r in df.select(target).filter(F.col(target).isNotNull()).distinct().orderBy(target).collect()]


def ovr_targets(df: DataFrame, target: str, classes: Sequence | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and class with the binary target of that class.

    The class list is small, so rows are widened in place and nothing is joined.
    """
    classes = list(classes) if classes is not None else class_values(df, target)
    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
    wide = df.select(*keep, F.col(target).alias("_target"), each)
    return wide.select(
        *keep, "cls", F.coalesce((F.col("_target") == F.col("cls")).cast("int"), F.lit(0)).alias("y")
    )


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column, fitted on training rows."""

    stats: Mapping[str, tuple[float, float]]

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
        names = list(cols or self.stats)
        return df.withColumns(
            {
                f"{c}{suffix}": (F.col(c).cast("double") - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1])
                for c in names
            }
        )


def scaler_stats(df: DataFrame, cols: Sequence[str], eps: float = FLAT) -> DataFrame:
    """Rows ``(column, mean, std)`` from one pass over ``df``.

    The deviation is the population form; below ``eps`` it counts as 1.
    """
    aggs = []
    for c in cols:
        std = F.stddev_pop(F.col(c).cast("double"))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.when(std < eps, F.lit(1.0)).otherwise(std).alias("std"),
            )
        )
    return df.agg(F.array(*aggs).alias("stats")).select(F.inline("stats"))


def fit_scaler(df: DataFrame, cols: Sequence[str], eps: float = FLAT) -> Scaler:
    rows = scaler_stats(df, cols, eps).collect()
    return Scaler({r["column"]: (r["mean"], r["std"]) for r in rows})


# Models trained on scaled features; all others see raw ones.
SCALED_ALGORITHMS = ("SVC", "LinearSVC", "MLPClassifier")


def feature_set_for(algorithm: str) -> str:
    return "scaled" if algorithm in SCALED_ALGORITHMS else "raw"


def feature_set(algorithm: Column) -> Column:
    return F.when(algorithm.isin(*SCALED_ALGORITHMS), F.lit("scaled")).otherwise(F.lit("raw"))


def lookup(df: DataFrame, col: str, mapping: Mapping | DataFrame, out: str, default: Column | str | None = None) -> DataFrame:
    """Translate ``col``; values not in the mapping give ``default`` or pass through.

    A dict becomes a literal map. A frame needs the columns ``key`` and
    ``value`` with unique keys and is joined by its measured size.
    """
    if default is None:
        default = F.col(col)
    elif isinstance(default, str):
        default = F.lit(default)
    if isinstance(mapping, DataFrame):
        pairs = mapping.select(F.col("key").alias(col), F.col("value").alias("_found"))
        joined = lookup_join(df, pairs, col, "left")
        return joined.withColumn(out, F.coalesce("_found", default)).drop("_found")
    if not mapping:
        return df.withColumn(out, default)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(col)), default))


def keep_members(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Rows whose ``col`` occurs in the only column of ``values``."""
    members = values.select(F.col(values.columns[0]).alias(col)).distinct()
    return lookup_join(df, members, col, "left_semi")


def drop_warmup(df: DataFrame, run: str, warmup: int) -> DataFrame:
    return df.filter(F.col(run) >= warmup)
