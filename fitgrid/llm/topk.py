"""Exact highest inner products by the threshold algorithm of Fagin, Lotem and Naor.

Candidates are hashed into shards of bounded size. A task keeps, for each shard, one list of the
shard's vectors per dimension, sorted by that component, and walks all lists of a query side by
side: down where the query's component is positive, up where it is negative. Each vector met is
scored whole. The components at the places reached bound the score of every vector not met yet;
a query leaves the shard once that bound lies below its kth score.

Vectors are shuffled once. A shard's vectors come first in its task, the queries stream after
them in Arrow batches, so memory holds one shard and one batch. Every query first visits the shard
that its own hash names; the kth score found there is a lower bound with which it goes on to all
others, so that later shards stop earlier and return only what can still be among the k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

SHARD_VALUES = 1 << 20
FIRST_DEPTH = 64
DEEPER = 2
EXACT = 2.0**53
LARGEST = 2.0**63


class SortedLists:
    """Vectors of one length with their per-dimension order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        # ids ascend, so that the first of equal scores is the smallest id
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.order = np.argsort(self.points, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(self.points, self.order.T, axis=0).T
        self.largest = float(np.abs(self.points).max(initial=0))
        self.floats = None

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; through doubles where every sum of products is a whole number below 2^53."""
        size = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query))
        if size < EXACT:
            if self.floats is None:
                self.floats = self.points.astype(np.float64)
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        if size >= LARGEST:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        return self.points[rows].astype(np.int64) @ query.astype(np.int64)

    def top(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first; those below ``least`` may be left out."""
        n = len(self.ids)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen, done = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        best, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        depth, reach = 0, min(n, FIRST_DEPTH)
        while True:
            seen[self.order[down, n - reach : n - depth]] = True
            seen[self.order[up, depth:reach]] = True
            if reach == n:
                seen[:] = True
            fresh = np.flatnonzero(seen & ~done)
            done |= seen
            fresh = fresh[self.ids[fresh] != own]
            found = self.scores(fresh, query)
            floor = least if len(best) < k else int(score[-1])
            if floor is not None:
                fresh, found = fresh[found >= floor], found[found >= floor]
            best, score = np.concatenate([best, fresh]), np.concatenate([score, found])
            pick = np.lexsort((best, -score))[:k]
            best, score = best[pick], score[pick]
            if reach == n:
                return self.ids[best], score
            bound = self._bound(query, down, up, reach)
            # an equal score of a vector not met could have the smaller id: stop only below
            if (least is not None and bound < least) or (len(best) == k and bound < score[-1]):
                return self.ids[best], score
            depth, reach = reach, min(n, reach * DEEPER)

    def _bound(self, query: np.ndarray, down: np.ndarray, up: np.ndarray, reach: int) -> int:
        n = len(self.ids)
        ends = [(query[down], self.sorted[down, n - reach]), (query[up], self.sorted[up, reach - 1])]
        return sum(int(a) * int(b) for part in ends for a, b in zip(*part))


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each length of list in a column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _visit(k: int):
    """Task over (shard, kind, id, v, least), sorted: kind 0 are a shard's vectors, kind 1 its queries."""

    def run(batches):
        at, parts, lists = None, {}, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                if stop == start:
                    continue
                piece = batch.slice(start, stop - start)
                if shards[start] != at:
                    at, parts, lists = shards[start], {}, None
                ids = piece.column("id").to_numpy()
                if kinds[start] == 0:
                    for rows, points in _by_size(piece.column("v")):
                        parts.setdefault(points.shape[1], []).append((ids[rows], points))
                    continue
                if lists is None:
                    lists = {s: SortedLists(*map(np.concatenate, zip(*p))) for s, p in parts.items()}
                    parts = {}
                least = piece.column("least").to_pylist()
                found = [(np.empty(0, np.int64),) * 3]
                for rows, queries in _by_size(piece.column("v")):
                    there = lists.get(queries.shape[1])
                    for row, query in zip(rows, queries) if there else ():
                        best, score = there.top(query, int(ids[row]), k, least[row])
                        found.append((np.full(len(best), ids[row]), best, score))
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def _search(points: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """What the shards return for the queries sent to them."""
    both = points.select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("bigint").alias("least")).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "id", "v", "least")
    )
    return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_visit(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def whole_numbers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component; null for vectors that take no part."""
    numbers = vector.cast("array<double>")
    good = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(numbers, lambda x: F.floor(F.lit(scale) * x)))


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 1024.0,
    shard_values: int = SHARD_VALUES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest inner product for every query.

    Components become ``floor(scale * x)`` first and scores are exact. Ties go to the smaller id; fewer
    than k candidates give fewer rows. A query's own id is no candidate. Vectors are compared with those
    of their own length. Null vectors, vectors with null or non-finite components and rows without an id
    take no part. A row that is repeated counts once; an id with several vectors offers each of them as a
    candidate and asks with the least. Other columns, of whatever name, are not read. Empty tables give no
    rows. Inner products beyond 64 bits raise an error.
    """

    def numbered(df: DataFrame) -> DataFrame:
        out = df.select(F.col(key).cast("bigint").alias("id"), whole_numbers(F.col(vector), scale).alias("v"))
        return out.filter(F.col("id").isNotNull() & F.col("v").isNotNull())

    points = numbered(vectors).distinct()
    asked = numbered(queries).groupBy("id").agg(F.min("v").alias("v"))
    points = materialise(points.withColumn("hash", F.xxhash64("id", "v")), "vectors")
    values = points.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    shards = max(1, math.ceil(values / shard_values))
    shard = F.pmod("hash", F.lit(shards)).cast("int").alias("shard")
    points = points.select(shard, "id", "v")
    none = F.lit(None).cast("bigint").alias("least")
    asked = asked.withColumn("hash", F.xxhash64("id", "v")).select(shard, "id", "v")
    first = _best(_search(points, asked.select("shard", "id", "v", none), k, shards), k)
    if shards == 1:
        return first.select("query_id", "rank", "vec_id", "score")
    first = materialise(first, "first-shard")
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard")))
    rest = asked.join(least, "id", "left").select(others.alias("shard"), "id", "v", "least")
    found = _search(points, rest, k, shards).unionByName(first.drop("rank"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
