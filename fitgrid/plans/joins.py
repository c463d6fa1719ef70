"""Joins against lookup tables whose size is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_SHARE = 0.001


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure rows and serialised bytes with one partial aggregate."""
    rows, size = df.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)),
    ).first()
    return rows <= max_rows and size <= max_bytes


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """Key values that hold more than ``share`` of all rows: at most 1/share of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("n") > total * share) & F.col(key).isNotNull()).select(key).collect()
    return [r[0] for r in rows]


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``left`` with a table that has one row per ``on``.

    A right side of measured small size is broadcast. Beyond that the few keys
    that hold many left rows are matched by broadcasting just their lookup rows,
    and everything else is shuffled, so no task receives a whole hot key.
    """
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    hot = heavy_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    near = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), on, how)
    far = left.filter(~is_hot).join(right, on, how)
    return near.unionByName(far)
