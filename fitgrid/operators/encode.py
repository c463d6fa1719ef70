"""Category codes in order of first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from ..plans.running import global_rank
from ..session import materialise


def fit_first_seen(
    df: DataFrame, cols: Sequence[str], order_by: str, small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Dictionary ``(column, value, code)``; code 0 is the value met first.

    One scan serves all columns: values and their lowest position are combined
    before the shuffle, so only distinct values move. ``order_by`` is unique.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    )
    seen = (
        df.select(F.col(order_by).alias("_pos"), pairs.alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy("p.column", "p.value")
        .agg(F.min("_pos").alias("_first"))
    )
    seen = materialise(seen, "first-seen")
    if fits_broadcast(seen, max_rows=small_rows):
        place = Window.partitionBy("column").orderBy("_first")
        coded = seen.withColumn("code", F.row_number().over(place).cast("bigint") - 1)
        return coded.select("column", "value", "code")
    parts = [
        global_rank(seen.filter(F.col("column") == c), ["_first"], "code").select(
            "column", "value", (F.col("code") - 1).alias("code")
        )
        for c in cols
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return materialise(whole, "codes")


def apply_codes(
    df: DataFrame, codes: DataFrame, cols: Sequence[str], suffix: str = "_code", small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add the code of every listed column.

    A dictionary that is small as a whole is broadcast, else column by column.
    """
    small = fits_broadcast(codes, max_rows=small_rows)
    for c in cols:
        name = f"{c}{suffix}"
        mine = codes.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(name))
        marked = df.withColumn("_value", F.col(c).cast("string"))
        if small:
            joined = marked.join(F.broadcast(mine), "_value", "left")
        else:
            joined = lookup_join(marked, mine, "_value", "left", max_rows=small_rows)
        df = joined.drop("_value")
    return df


def encode_first_seen(
    df: DataFrame, cols: Sequence[str], order_by: str, suffix: str = "_code", small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    codes = fit_first_seen(df, cols, order_by, small_rows)
    return apply_codes(df, codes, cols, suffix, small_rows)


def encode_target(df: DataFrame, target: str, order_by: str, out: str = "label") -> DataFrame:
    """Class codes of one target column in order of first appearance."""
    coded = encode_first_seen(df, [target], order_by, "_target_code")
    return coded.withColumnRenamed(f"{target}_target_code", out)
