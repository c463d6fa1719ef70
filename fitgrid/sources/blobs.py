"""Gaussian blobs whose values depend on the seed and the row's key only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPREAD = 10.0
UNITS = 4294967296.0


def unit(digest: Column, at: int) -> Column:
    """Number in (0, 1] from eight hexadecimal digits of an md5, starting at ``at``."""
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1.0) / F.lit(UNITS)


def keyed(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def blob_centres(k: int, d: int, seed: int = 42) -> list[list[float]]:
    """Centres, uniform in a cube of side 20; a fixed function of the seed."""
    def entry(c: int, j: int) -> float:
        digest = hashlib.md5(f"{seed}:c:{c}:{j}".encode()).hexdigest()
        return ((int(digest[:8], 16) + 1.0) / UNITS * 2.0 - 1.0) * SPREAD

    return [[entry(c, j) for j in range(d)] for c in range(k)]


def blobs(df: DataFrame, key: str, k: int, d: int, seed: int = 42, std: float = 1.0) -> DataFrame:
    """One point per row of ``df``: columns ``key, cluster, features``.

    Clusters take turns by key. One hash gives the two uniforms of a normal pair
    (Box and Muller, 1958), which serves two features. ``randn`` is not used
    because its values follow the partitioning.
    """
    cluster = F.pmod(F.col(key), F.lit(k)).cast("int")
    pairs = -(-d // 2)
    hashed = df.select(
        F.col(key), cluster.alias("cluster"), *[keyed(seed, "p", F.col(key), p).alias(f"_h{p}") for p in range(pairs)]
    )
    centres = F.array(*[F.array(*[F.lit(v) for v in c]) for c in blob_centres(k, d, seed)])
    entries = []
    for j in range(d):
        digest = F.col(f"_h{j // 2}")
        radius = F.sqrt(-2.0 * F.ln(unit(digest, 1)))
        angle = unit(digest, 9) * (2.0 * math.pi)
        normal = radius * (F.cos(angle) if j % 2 == 0 else F.sin(angle))
        entries.append(F.get(F.get(centres, F.col("cluster")), F.lit(j)) + normal * std)
    return hashed.select(key, "cluster", F.array(*entries).alias("features"))


def make_blobs(spark: SparkSession, n: int, k: int, d: int, seed: int = 42, std: float = 1.0) -> DataFrame:
    return blobs(spark.range(n), "id", k, d, seed, std)
