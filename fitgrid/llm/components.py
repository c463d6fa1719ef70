"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node of each component, for every node with a link.

    Alternating star contraction: every node's larger neighbours are hung on its least
    neighbour, then every node's smaller ones on the least of them. The rounds grow with the
    logarithm of the longest path. A round's links are written to the shared folder, which
    cuts the lineage. All steps combine before they shuffle, so a hub is no hot spot.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = materialise(_small_star(_large_star(edges)), "links")
        fresh = _state(edges)
        if fresh == state:  # every node hangs on its root
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = fresh
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    wide = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(wide)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # larger neighbours of u go to the least of u and its neighbours
    hung = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return hung.unionByName(kept).filter("u <> v").distinct()
