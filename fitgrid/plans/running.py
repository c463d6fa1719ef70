"""Running totals and row numbers over a whole table.

A window without PARTITION BY sends every row to one task. Here the order is cut
into ranges at approximate quantiles, the ranges' totals (one small row each)
give the offsets, and the window runs inside each range. The cut points are
literals, so every job sees the same ranges, also after a task is run again.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .selection import ordinal

ROWS_PER_RANGE = 500_000
MAX_RANGES = 10_000
SAMPLED_PER_RANGE = 20
FINER = 100
CUT_LENGTH = 32


def cut_points(df: DataFrame, col: Column, ranges: int) -> list[float]:
    probs = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(col.cast("double"), probs, max(10_000, 10 * ranges))).first()[0]
    return sorted(set(found or []))


def with_range(df: DataFrame, order: Column, ranges: int, out: str = "_range") -> DataFrame:
    """Add the number of the range each row's order value falls into; NaN sorts last."""
    cuts = cut_points(df, order, ranges) if ranges > 1 else []
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *cuts, math.inf]
    mark = f"{out}_value"
    bucketed = Bucketizer(splits=splits, inputCol=mark, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(mark, order.cast("double"))
    )
    return bucketed.withColumn(out, F.col(out).cast("int")).drop(mark)


def with_text_range(df: DataFrame, order: Column, ranges: int, rows: int, out: str = "_range") -> DataFrame:
    """``with_range`` for text: cut points from a sorted sample of bounded size, searched by bisection.

    The cuts travel with the function, not in the plan; a cut is at most ``CUT_LENGTH`` characters long.
    """
    wanted = SAMPLED_PER_RANGE * ranges
    sampled = df.select(F.left(order, F.lit(CUT_LENGTH)).alias("v")).sample(fraction=min(1.0, wanted / rows), seed=ranges).collect()
    values = sorted(r["v"] for r in sampled)  # code points order like bytes
    cuts = sorted({values[len(values) * i // ranges] for i in range(1, ranges)} if values else ())
    if not cuts:
        return df.withColumn(out, F.lit(0))

    @F.arrow_udf("int")
    def below(texts: pa.Array) -> pa.Array:
        return pa.array([bisect_left(cuts, t) for t in texts.to_pylist()], pa.int32())

    return df.withColumn(out, below(order))


def with_part(ranged: DataFrame, order: Column, rows_per_range: int, text: bool) -> DataFrame:
    """Cut ranges that hold too many rows once more, into up to ``FINER`` parts each.

    There are at most ``MAX_RANGES`` ranges, so their cut points fit a broadcast: numbers by a sketch per
    range, texts from a hashed sample of each, of bounded number and length. Equal order values stay together.
    """
    whole = ranged.withColumn("_part", F.lit(0))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * rows_per_range)
    large = [(r["_range"], r["n"]) for r in sizes.collect()]
    if not large:
        return whole
    some = ranged.sparkSession.createDataFrame(large, "_range int, _n bigint")
    inside = ranged.join(F.broadcast(some), "_range")
    if text:
        chosen = F.pmod(F.xxhash64(order), F.greatest(F.lit(1), F.floor(F.col("_n") / (FINER * FINER)))) == 0
        values = F.array_sort(F.collect_set(F.left(order, F.lit(CUT_LENGTH))))
        sampled = inside.filter(chosen).groupBy("_range").agg(values.alias("_all"))
        step = F.greatest(F.lit(1), F.floor(F.size("_all") / FINER)).cast("int")
        cuts = sampled.select("_range", F.filter("_all", lambda v, i: i % step == step - 1).alias("_cuts"))
        value = order
    else:
        probs = [i / FINER for i in range(1, FINER)]
        value = order.cast("double")
        cuts = inside.groupBy("_range").agg(F.percentile_approx(value, probs, 10_000).alias("_cuts"))
    joined = ranged.join(F.broadcast(cuts), "_range", "left")
    part = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < value).cast("int"))
    return joined.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts")


def running_totals(
    df: DataFrame,
    order_by: Sequence[str],
    measures: Mapping[str, Column],
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
) -> DataFrame:
    """Add one inclusive running total per measure, in the order given.

    ``order_by`` must make the rows' order unique and hold no nulls; its first
    column, a number, date, timestamp or text, decides the range.
    """
    names = list(measures)
    rows = df.count()
    ranges = min(max_ranges, max(1, math.ceil(rows / rows_per_range)))
    lead = ordinal(df, order_by[0])
    text = isinstance(df.schema[order_by[0]].dataType, T.StringType)
    ranged = with_text_range(df, lead, ranges, rows) if ranges > 1 and text else with_range(df, lead, ranges)
    if rows > max_ranges * rows_per_range:
        ranged = with_part(ranged, lead, rows_per_range, text)
    else:
        ranged = ranged.withColumn("_part", F.lit(0))
    window = (
        Window.partitionBy("_range", "_part")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inner = ranged.withColumns({n: F.sum(measures[n]).over(window) for n in names})
    if ranges == 1 and rows <= max_ranges * rows_per_range:
        return inner.drop("_range", "_part")

    totals = (
        ranged.groupBy("_range", "_part").agg(*[F.sum(measures[n]).alias(n) for n in names]).orderBy("_range", "_part").collect()
    )
    carried = {n: 0 for n in names}
    offsets = []
    for row in totals:
        offsets.append((row["_range"], row["_part"], *[carried[n] for n in names]))
        for n in names:
            carried[n] += row[n] or 0
    kinds = {f.name: f.dataType.simpleString() for f in inner.schema}
    schema = ", ".join(["_range int", "_part int", *[f"_before_{n} {kinds[n]}" for n in names]])
    small = df.sparkSession.createDataFrame(offsets, schema)
    joined = inner.join(F.broadcast(small), ["_range", "_part"])
    return joined.withColumns(
        {n: F.col(n) + F.col(f"_before_{n}") for n in names}
    ).drop("_range", "_part", *[f"_before_{n}" for n in names])


def global_rank(
    df: DataFrame, order_by: Sequence[str], out: str = "rank", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """1-based row number over the whole table."""
    return running_totals(df, order_by, {out: F.lit(1).cast("bigint")}, rows_per_range)
