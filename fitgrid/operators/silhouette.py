"""Silhouette of a clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import lookup_join
from ..plans.sums import rows_as_matrix
from ..plans.vectors import complete_vectors

BLOCK_ROWS = 8192
SMALLEST_BLOCK = 1024
MOST_CLUSTERS = 1_000
ASKED_ROWS = 4_096


def silhouette_squared(df: DataFrame, col: str, cluster: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance; linear in the rows. Vectors have to be complete."""
    complete_vectors(df.select(F.col(col).cast("array<double>").alias("x")))
    points = df.select(
        array_to_vector(F.col(col).cast("array<double>")).alias("features"), F.col(cluster).cast("int").alias("prediction")
    )
    score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(points)
    return df.sparkSession.createDataFrame([(score,)], "silhouette double")


def silhouette_exact(
    df: DataFrame, key: str, col: str, cluster: str, block_rows: int = BLOCK_ROWS, most_clusters: int = MOST_CLUSTERS
) -> DataFrame:
    """Silhouette of every row under Euclidean distance.

    A row's mean distance to a cluster is no less than its distance to the cluster's mean, and no more
    than the root of its mean squared distance, which follows from the cluster's mean and variance. So only
    clusters whose mean is nearer than the least such root can be the nearest other one; the rest are never
    looked at. Clusters are dealt into blocks by hash; a task holds one block and the rows that have to meet it
    stream past, so work and rows moved grow with the rows times the sizes of their own and open clusters
    (``meetings`` tells whom a row meets). Beyond ``most_clusters`` clusters all pairs of blocks meet.
    A row that is at distance zero from both clusters scores 0. Vectors have to be complete, keys
    unique; rows without a cluster take no part.
    """
    df = df.filter(F.col(cluster).isNotNull())
    rows, _ = complete_vectors(df.select(F.col(col).cast("array<double>").alias("x")))
    points = df.select(F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.col(col).cast("array<double>").alias("x"))
    known = _clusters(points, most_clusters)
    if known is None:
        sums = _all_pairs(points, rows, block_rows)
    else:
        sums = _open_pairs(points, known, block_rows)
    sizes = points.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    per_cluster = lookup_join(sums, sizes, "other", "inner")
    size = F.col("size")
    own = F.col("other") == F.col("cluster")
    means = per_cluster.groupBy("key", "cluster").agg(
        F.max(F.when(own & (size > 1), F.col("total") / (size - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / size)).alias("b"),
    )
    # equal points on both sides: neither cluster is nearer
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return means.select(
        F.col("key").alias(key), "cluster", F.coalesce(score, F.lit(0.0)).alias("silhouette")
    )


@dataclass(frozen=True)
class _Clusters:
    """Names, sizes, means and mean squared deviations, by name."""

    names: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    def open(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which clusters each row has to meet: its own, and those that can be the nearest other one."""
        gap = np.square(points).sum(axis=1)[:, None] + np.square(self.means).sum(axis=1)[None, :] - 2.0 * (points @ self.means.T)
        scale = 1e-9 * (np.square(points).sum(axis=1).max(initial=0.0) + np.square(self.means).sum(axis=1).max(initial=0.0) + 1e-300)
        least = np.sqrt(np.maximum(gap - scale, 0.0))
        most = np.sqrt(np.maximum(gap, 0.0) + scale + self.spreads[None, :]) * (1 + 1e-9)
        mine = self.names[None, :] == own[:, None]
        nearest = np.where(mine, np.inf, most).min(axis=1)
        return mine | (least <= nearest[:, None])


def _clusters(points: DataFrame, most: int) -> _Clusters | None:
    if len(points.select("cluster").distinct().limit(most + 1).collect()) > most:
        return None
    vector = array_to_vector("x")
    found = points.groupBy("cluster").agg(Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s"))
    rows = sorted(found.select("cluster", "s.count", "s.mean", "s.variance").collect(), key=lambda r: r["cluster"])
    sizes = np.array([r["count"] for r in rows])
    # the summary's variance is that of a sample; rounding must not make it too small
    spreads = np.array([r["variance"].toArray().sum() * (r["count"] - 1) / r["count"] if r["count"] > 1 else 0.0 for r in rows]) * (1 + 1e-9)
    return _Clusters(np.array([r["cluster"] for r in rows]), sizes, np.array([r["mean"].toArray() for r in rows]), spreads)


def meetings(df: DataFrame, key: str, col: str, cluster: str, most_clusters: int = MOST_CLUSTERS) -> DataFrame:
    """``key`` and the clusters ``other`` whose members each row's silhouette needs."""
    points = df.select(F.col(key).alias("key"), F.col(cluster).cast("int").alias("cluster"), F.col(col).cast("array<double>").alias("x"))
    known = _clusters(points, most_clusters)
    if known is None:
        raise ValueError(f"more than {most_clusters} clusters: all pairs meet")
    return _asked(points, known, 1 << 62).select(F.col("key").alias(key), "cluster", "other")


def _asked(points: DataFrame, known: _Clusters, block_rows: int) -> DataFrame:
    """One row for every point and block that it has to meet: other, block, kind 1, key, cluster, x."""
    blocks = -(-known.sizes // block_rows)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cluster").to_numpy()
            row, which = np.nonzero(known.open(rows_as_matrix(batch.column("x")), own))
            many = blocks[which]
            row, which = np.repeat(row, many), np.repeat(which, many)
            block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            for at in range(0, len(row), ASKED_ROWS):
                some = pa.array(row[at : at + ASKED_ROWS])
                other = pa.array(known.names[which[at : at + ASKED_ROWS]].astype(np.int32))
                first = [other, pa.array(block[at : at + ASKED_ROWS]), pa.array(np.ones(len(some), np.int32))]
                yield pa.RecordBatch.from_arrays([*first, *[batch.column(c).take(some) for c in ("key", "cluster", "x")]], ASKED)

    kind = points.schema["key"].dataType.simpleString()
    return points.mapInArrow(run, f"other int, block bigint, kind int, key {kind}, cluster int, x array<double>")


ASKED = ["other", "block", "kind", "key", "cluster", "x"]


def _open_pairs(points: DataFrame, known: _Clusters, block_rows: int) -> DataFrame:
    """Sums of distances per row and cluster that it has to meet: key, cluster, other, total."""
    blocks = {int(n): int(-(-s // block_rows)) for n, s in zip(known.names, known.sizes)}
    count = F.element_at(F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair]), F.col("cluster"))
    members = points.select(
        F.col("cluster").alias("other"), F.pmod(F.xxhash64("key"), count).cast("bigint").alias("block"), F.lit(0).alias("kind"), "key", "cluster", "x"
    )
    both = members.unionByName(_asked(points, known, block_rows))
    kind = points.schema["key"].dataType.simpleString()

    def run(batches):
        at, held, keys, x, place = None, [], [], None, {}
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("other", "block", "kind")], axis=1)
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == stop:
                    continue
                piece, mark = batch.slice(start, stop - start), tuple(marks[start])
                if mark[:2] != at:
                    at, held, keys, x = mark[:2], [], [], None
                points = rows_as_matrix(piece.column("x"))
                if mark[2] == 0:
                    held.append(points)
                    keys += piece.column("key").to_pylist()
                    continue
                if x is None and held:
                    x, held = np.concatenate(held), []
                    place = {k: i for i, k in enumerate(keys)}
                total = np.zeros(len(points))
                if x is not None:  # a hash may leave a block without members
                    own = np.flatnonzero(piece.column("cluster").to_numpy() == mark[0])
                    asked = piece.column("key").to_pylist()
                    same = [(i, place[asked[i]]) for i in own.tolist() if asked[i] in place]
                    total = _distances(points, x, same)
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("cluster"), piece.column("other"), pa.array(total)], ["key", "cluster", "other", "total"])

    met = both.repartition("other", "block").sortWithinPartitions("other", "block", "kind")
    sums = met.mapInArrow(run, f"key {kind}, cluster int, other int, total double")
    return sums.groupBy("key", "cluster", "other").agg(F.sum("total").alias("total"))


def _distances(points: np.ndarray, x: np.ndarray, same: list[tuple[int, int]], step: int = 256) -> np.ndarray:
    """Sum of each row's distances to all of ``x``; ``same`` names rows that are members themselves."""
    middle = x.mean(axis=0)
    points, x = points - middle, x - middle
    size = np.square(x).sum(axis=1)
    total = np.zeros(len(points))
    rows, places = (np.array(v, dtype=np.int64) for v in zip(*same)) if same else (np.empty(0, np.int64),) * 2
    for at in range(0, len(points), step):
        part = points[at : at + step]
        far = np.square(part).sum(axis=1)[:, None] + size[None, :] - 2.0 * (part @ x.T)
        np.maximum(far, 0.0, out=far)
        here = (rows >= at) & (rows < at + step)
        far[rows[here] - at, places[here]] = 0.0
        total[at : at + step] = np.sqrt(far, out=far).sum(axis=1)
    return total


def _all_pairs(points: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Sums of distances per row and cluster, from all pairs of blocks."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    enough = min(math.ceil(math.sqrt(2 * cores)), math.ceil(rows / SMALLEST_BLOCK))
    blocks = max(1, math.ceil(rows / block_rows), enough)
    points = points.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    # block b meets every block o once, in the task named by the unordered pair
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    meeting = points.select("*", other).select(
        "key", "cluster", "x", "block",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
    )
    key_type = points.schema["key"].dataType.simpleString()
    sums = meeting.groupBy("first", "second").applyInPandas(
        _pair_sums, f"key {key_type}, cluster int, other int, total double"
    )
    return sums.groupBy("key", "cluster", "other").agg(F.sum("total").alias("total"))


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    first, second = pdf["first"].iloc[0], pdf["second"].iloc[0]
    if first == second:
        return _cluster_sums(pdf, pdf)
    left, right = pdf[pdf["block"] == first], pdf[pdf["block"] == second]
    if left.empty or right.empty:
        return pd.DataFrame({"key": [], "cluster": [], "other": [], "total": []})
    return pd.concat([_cluster_sums(left, right), _cluster_sums(right, left)], ignore_index=True)


def _cluster_sums(a: pd.DataFrame, b: pd.DataFrame, step: int = 256) -> pd.DataFrame:
    """Sum of distances from each row of ``a`` to each cluster of ``b``."""
    x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
    labels, codes = np.unique(b["cluster"].to_numpy(), return_inverse=True)
    member = np.zeros((len(b), len(labels)))
    member[np.arange(len(b)), codes] = 1.0
    sums = np.concatenate(list(_distance_sums(x, y, member, step, a is b)))
    return pd.DataFrame(
        {
            "key": np.repeat(a["key"].to_numpy(), len(labels)),
            "cluster": np.repeat(a["cluster"].to_numpy(), len(labels)),
            "other": np.tile(labels, len(a)),
            "total": sums.ravel(),
        }
    )


def _distance_sums(
    x: np.ndarray, y: np.ndarray, member: np.ndarray, step: int, same: bool
) -> Iterator[np.ndarray]:
    """Distances from inner products, ``step`` rows at a time; a row is at 0 from itself."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = np.square(x).sum(axis=1), np.square(y).sum(axis=1)
    for at in range(0, len(x), step):
        far = xx[at : at + step, None] + yy[None, :] - 2.0 * (x[at : at + step] @ y.T)
        np.maximum(far, 0.0, out=far)
        if same:
            here = np.arange(len(far))
            far[here, at + here] = 0.0
        yield np.sqrt(far, out=far) @ member
