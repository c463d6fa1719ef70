"""Rows of conversations in order, numbered, also where one conversation holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.joins import lookup_join

GIANT_ROWS = 1_000_000
PARTS = 500
ACCURACY = 10_000


def numbered(
    df: DataFrame, conv: str, turn: str, ties: Sequence[Column | str], out: str = "row", giant_rows: int = GIANT_ROWS
) -> DataFrame:
    """Add the 1-based place of each row in its conversation, by ``turn`` (null first) and then ``ties``.

    A conversation of more than ``giant_rows`` rows is cut at turns into up to ``PARTS`` ranges that are
    ordered by a task each; the ranges' sizes give the places before them. Rows of one turn stay in one task.
    """
    sizes = df.groupBy(conv).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > giant_rows).select(conv)
    order = [F.asc_nulls_first(turn), *ties]
    if not sizes.take(1):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(conv).orderBy(*order)).cast("bigint"))
    probs = [i / PARTS for i in range(1, PARTS)]
    slim = df.select(F.to_json(F.struct(conv)).alias("_conv"), F.col(turn).alias("_turn"))
    large = sizes.select(F.to_json(F.struct(conv)).alias("_conv"))
    cuts = (
        lookup_join(slim, large, "_conv", "left_semi")
        .groupBy("_conv")
        .agg(F.percentile_approx("_turn", probs, ACCURACY).alias("_cuts"))
    )
    placed = lookup_join(df.withColumn("_conv", F.to_json(F.struct(conv))), cuts, "_conv")
    part = F.size(F.filter("_cuts", lambda c: c < F.col(turn)))
    placed = placed.withColumn("_part", F.when(F.col("_cuts").isNotNull() & F.col(turn).isNotNull(), part).otherwise(0)).drop("_cuts")
    inside = F.row_number().over(Window.partitionBy("_conv", "_part").orderBy(*order)).cast("bigint")
    counts = placed.groupBy("_conv", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") > 0).drop("n")
    found = placed.withColumn(out, inside).join(counts, ["_conv", "_part"], "left")
    return found.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_conv", "_part", "_before")
