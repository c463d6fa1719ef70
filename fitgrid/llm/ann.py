"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are hashed into shards of bounded size; equal vectors are one node that lists its
least ids. A task builds the graph of its shard: each node has a level drawn from a hash
of its vector, and on every level up to it at most ``links`` neighbours (twice as many on
the lowest), kept as flat integer arrays of fixed width. Nodes are inserted in blocks: a block
searches the graph so far, all its nodes at once as rows of numpy matrices, then its
nodes are linked to what they found and to each other, by the rule that a neighbour
counts only if it is closer to the node than to the neighbours already chosen. Graphs are
written to the shared folder as rows. A search takes blocks of queries to every shard,
descends the levels and keeps the ``breadth`` best nodes met; shard results are then merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

SHARD_ROWS = 8_192
LINKS = 16
BUILD_BREADTH = 100
BREADTH = 160
INSERT = 128
QUERY_BLOCK = 4_096
AT_ONCE = 256
LEVELS = 5


class Graph:
    """A layered graph over the rows of ``points``; ``near[l]`` is (nodes, width), -1 where empty."""

    def __init__(self, points: np.ndarray, levels: np.ndarray, links: int = LINKS):
        self.points = points
        self.levels = levels
        self.width = [2 * links] + [links] * int(levels.max(initial=0))
        self.near = [np.full((len(points), w), -1, dtype=np.int32) for w in self.width]
        self.entry = -1

    def build(self, breadth: int = BUILD_BREADTH, step: int = INSERT) -> Graph:
        n = len(self.points)
        at, size = 0, 1
        while at < n:  # the first blocks are small, so early nodes find each other
            block = np.arange(at, min(at + size, n))
            self._insert(block, breadth)
            at += len(block)
            size = min(step, max(1, at // 2))
        return self

    def _insert(self, block: np.ndarray, breadth: int) -> None:
        top = int(self.levels[block].max())
        among = self._distance(self.points[block], self.points[block]) if len(block) > 1 else np.zeros((1, 1))
        start = np.full(len(block), self.entry, dtype=np.int64)
        known = int(self.levels[self.entry]) if self.entry >= 0 else -1
        for level in range(max(top, known), -1, -1):
            mine = np.flatnonzero(self.levels[block] >= level)
            found = np.full((len(block), 1), -1, dtype=np.int64)
            if level <= known:
                found, _ = self.beam(self.points[block], start, level, breadth if len(mine) else 1)
                start = np.where(found[:, 0] >= 0, found[:, 0], start)
            if not len(mine):
                continue
            peers = np.broadcast_to(block[mine], (len(mine), len(mine))).copy()
            far = among[np.ix_(mine, mine)].copy()
            np.fill_diagonal(far, np.inf)
            few = min(breadth, len(mine))
            pick = np.argsort(far, axis=1, kind="stable")[:, :few]
            peers = np.take_along_axis(peers, pick, axis=1)
            peers[np.take_along_axis(far, pick, axis=1) == np.inf] = -1
            self._link(block[mine], np.concatenate([found[mine], peers], axis=1), level)
        if top > known:
            self.entry = int(block[np.argmax(self.levels[block])])

    def _link(self, nodes: np.ndarray, candidates: np.ndarray, level: int) -> None:
        near, width = self.near[level], self.width[level]
        chosen = self._choose(nodes, candidates, max(1, width // 2))
        near[nodes, : chosen.shape[1]] = chosen
        # the other direction: each chosen neighbour takes the node in and keeps its best
        row, col = np.nonzero(chosen >= 0)
        target, source = chosen[row, col], nodes[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        unique, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(unique), int(count.max(initial=0))), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(unique)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        have = near[unique]
        extra[(extra[:, :, None] == have[:, None, :]).any(axis=2)] = -1  # linked already
        merged = np.concatenate([have, extra], axis=1)
        full = (merged >= 0).sum(axis=1) > width
        loose = np.flatnonzero(~full)
        if len(loose):
            packed = np.take_along_axis(merged[loose], np.argsort(merged[loose] < 0, axis=1, kind="stable"), axis=1)
            near[unique[loose]] = packed[:, :width]
        tight = np.flatnonzero(full)
        if len(tight):
            kept = self._choose(unique[tight], merged[tight], width)
            near[unique[tight]] = -1
            near[unique[tight], : kept.shape[1]] = kept

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates, nearest first; those nearer to a chosen one only fill up."""
        valid = candidates >= 0
        there = np.where(valid, candidates, 0)
        gap = self.points[there] - self.points[nodes][:, None, :]
        far = np.where(valid, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, : 4 * most]
        there, far = np.take_along_axis(there, order, axis=1), np.take_along_axis(far, order, axis=1)
        points = self.points[there]
        square = np.einsum("ijk,ijk->ij", points, points)
        between = square[:, :, None] + square[:, None, :] - 2.0 * (points @ points.transpose(0, 2, 1))
        usable = np.isfinite(far)
        covered = np.zeros(far.shape, dtype=bool)
        chosen = np.zeros(far.shape, dtype=bool)
        for j in range(far.shape[1]):
            take = usable[:, j] & ~covered[:, j] & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            covered |= take[:, None] & (between[:, j, :] < far)
        # then the nearest of the others
        rank = np.where(chosen, 0, np.where(usable, 1, 2))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(usable, there, -1), first, axis=1)
        return out

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)

    def beam(self, queries: np.ndarray, start: np.ndarray, level: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``breadth`` best nodes each query meets on a level, nearest first."""
        near, n = self.near[level], len(queries)
        rows = np.arange(n)
        met = np.zeros((n, len(self.points) + 1), dtype=bool)
        met[:, -1] = True  # stands for "no neighbour"
        met[rows, start] = True
        gap = self.points[start] - queries
        best = np.full((n, breadth), -1, dtype=np.int64)
        far = np.full((n, breadth), np.inf)
        best[:, 0], far[:, 0] = start, np.einsum("ij,ij->i", gap, gap)
        done = np.zeros((n, breadth), dtype=bool)
        while True:
            waiting = np.where(done | (best < 0), np.inf, far)
            at = waiting.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(waiting[rows, at]))
            if not len(live):
                return best, far
            done[live, at[live]] = True
            fresh = near[best[live, at[live]]].astype(np.int64)
            seen = met[live[:, None], fresh]
            met[live[:, None], fresh] = True
            there = np.where(seen, 0, fresh)
            gap = self.points[there] - queries[live][:, None, :]
            distance = np.where(seen, np.inf, np.einsum("ijk,ijk->ij", gap, gap))
            useful = (distance < far[live, -1:]).any(axis=1)
            live, there, distance = live[useful], there[useful], distance[useful]
            if not len(live):
                continue
            all_far = np.concatenate([far[live], distance], axis=1)
            all_best = np.concatenate([best[live], np.where(np.isfinite(distance), there, -1)], axis=1)
            all_done = np.concatenate([done[live], np.zeros(there.shape, dtype=bool)], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :breadth]
            far[live] = np.take_along_axis(all_far, order, axis=1)
            best[live] = np.take_along_axis(all_best, order, axis=1)
            done[live] = np.take_along_axis(all_done, order, axis=1)

    def search(self, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(queries), self.entry, dtype=np.int64)
        for level in range(len(self.near) - 1, 0, -1):
            found, _ = self.beam(queries, start, level, 1)
            start = found[:, 0]
        return self.beam(queries, start, 0, breadth)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``_id, _vector (array<double>)`` of rows with an id and a finite vector that is not zero."""
    rows = vectors.select(F.col(key).cast("bigint").alias("_id"), F.col(column).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    there = F.coalesce(finite & F.exists("_vector", lambda v: v != 0.0), F.lit(False))
    return rows.filter(F.col("_id").isNotNull() & there)


def nodes(rows: DataFrame, copies: int) -> DataFrame:
    """``_vector, _ids``: each different vector once with its least ``copies`` ids."""
    # ids are numbered in salted groups first, so a vector that many rows share is no hot spot
    salt = F.pmod(F.xxhash64("_id"), F.lit(32))
    salted = rows.distinct().withColumn("_salt", salt).withColumn("_same", F.xxhash64("_vector"))
    inner = Window.partitionBy("_same", "_vector", "_salt").orderBy("_id")
    few = salted.withColumn("_n", F.row_number().over(inner)).filter(F.col("_n") <= copies)
    return few.groupBy("_same", "_vector").agg(F.slice(F.sort_array(F.collect_list("_id")), 1, copies).alias("_ids")).drop("_same")


def build(rows: DataFrame, copies: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, breadth: int = BUILD_BREADTH) -> tuple[DataFrame, dict[int, int]]:
    """The graphs as a written table of nodes, and the number of shards for each vector length.

    ``size, shard, node, level, near, point, ids``; ``near`` holds the neighbours on all
    levels one after the other, twice ``links`` on the lowest, -1 where empty.
    """
    different = materialise(nodes(rows, copies).withColumn("size", F.size("_vector")), "vectors")
    counts = {r[0]: r[1] for r in different.groupBy("size").agg(F.count(F.lit(1))).collect()}  # lengths of vectors: few
    shards = {n: math.ceil(c / shard_rows) for n, c in counts.items()}
    if not shards:
        return different.sparkSession.createDataFrame([], NODE), {}
    number = F.create_map(*[F.lit(v) for kv in shards.items() for v in kv])[F.col("size")]
    placed = different.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "_vector"), number).cast("int"))
    # a node is on level l with a chance of links^-l
    place = (F.pmod(F.xxhash64(F.lit("level"), "_vector"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    level = F.least(F.floor(-F.log(place) / math.log(links)).cast("int"), F.lit(LEVELS))
    placed = placed.select("size", "shard", level.alias("level"), F.col("_vector").alias("point"), F.col("_ids").alias("ids"))

    def graph(table: pa.Table) -> pa.Table:
        points = _matrix(table.column("point"))
        order = np.lexsort(points.T[::-1])  # whatever order rows arrive in
        table = table.take(pa.array(order))
        points = np.ascontiguousarray(points[order])
        levels = table.column("level").to_numpy()
        made = Graph(points, levels, links).build(breadth)
        flat = np.concatenate(made.near, axis=1)
        width = flat.shape[1]
        ends = pa.array(np.arange(0, (len(flat) + 1) * width, width, dtype=np.int32))
        near = pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), pa.int32()))
        node = pa.array(np.arange(len(flat), dtype=np.int32))
        return pa.table([table["size"], table["shard"], node, table["level"], near, table["point"], table["ids"]], names=NODE_NAMES)

    built = placed.groupBy("size", "shard").applyInArrow(graph, NODE)
    return materialise(built, "graphs"), shards


NODE_NAMES = ["size", "shard", "node", "level", "near", "point", "ids"]
NODE = "size int, shard int, node int, level int, near array<int>, point array<double>, ids array<bigint>"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(graphs: DataFrame, shards: dict[int, int], queries: DataFrame, k: int, links: int = LINKS, breadth: int = BREADTH) -> DataFrame:
    """``_vector, _id, _far``: the nearest ids each shard finds for each different query vector.

    ``queries`` has ``_vector``. Blocks of queries meet every shard of their length once.
    """
    spark = graphs.sparkSession
    asked = queries.select("_vector").distinct().withColumn("size", F.size("_vector"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "_vector"), F.lit(blocks)).cast("int"))
    number = F.create_map(*[F.lit(v) for kv in shards.items() for v in kv])[F.col("size")] if shards else F.lit(0)
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(number, F.lit(0)) - 1))) if shards else asked.withColumn("shard", F.lit(0)).limit(0)
    met = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(part: pa.Table, block: pa.Table) -> pa.Table:
        out = pa.table([pa.array([], pa.list_(pa.float64())), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["_vector", "_id", "_far"])
        if not part.num_rows or not block.num_rows:
            return out
        part = part.sort_by("node")
        graph = Graph(_matrix(part["point"]), part["level"].to_numpy(), links)
        flat = _matrix(part["near"])
        graph.near = np.split(flat, np.cumsum(graph.width)[:-1], axis=1)
        graph.near = [np.ascontiguousarray(x) for x in graph.near]
        graph.entry = int(np.argmax(graph.levels))
        asked, ids = _matrix(block["_vector"]), part["ids"].to_pylist()
        rows, keys, far = [], [], []
        for at in range(0, len(asked), AT_ONCE):
            query = asked[at : at + AT_ONCE]
            found, _ = graph.search(query, max(breadth, k))
            for i in range(len(query)):
                there = found[i][found[i] >= 0]
                exact = np.sqrt(np.square(graph.points[there] - query[i]).sum(axis=1))
                best = [(d, key) for d, node in zip(exact.tolist(), there.tolist()) for key in ids[node]]
                for d, key in sorted(best)[:k]:
                    rows.append(at + i)
                    keys.append(key)
                    far.append(d)
        vectors = block["_vector"].combine_chunks().take(pa.array(rows, pa.int64()))
        return pa.table([vectors, pa.array(keys, pa.int64()), pa.array(far)], names=["_vector", "_id", "_far"])

    left, right = met.groupBy("size", "shard", "block"), sent.groupBy("size", "shard", "block")
    return left.cogroup(right).applyInArrow(find, "_vector array<double>, _id bigint, _far double")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    links: int = LINKS,
    breadth: int = BREADTH,
) -> DataFrame:
    """``query_id, rank, <key>, score``: the ``k`` nearest rows found for each row of ``queries``.

    Nearness is Euclidean distance in double precision, ties go to the lesser id; a row
    with the query's own id is no candidate. Rows without id, and vectors that are null, zero or hold
    null or non-finite components, take no part on either side. A query meets vectors of its own
    length. Rows that agree in id and vector count once. Ids are ``bigint``.
    """
    rows = usable(vectors, key, column)
    asked = materialise(usable(queries, key, column).distinct(), "queries")
    # an id with several vectors takes as many places among the nearest of its own queries
    same = rows.join(asked.select("_id").distinct(), "_id", "left_semi").groupBy("_id").agg(F.count_distinct("_vector").alias("n"))
    places = k + (same.agg(F.max("n")).first()[0] or 1)
    graphs, shards = build(rows, places, shard_rows, links)
    found = search(graphs, shards, asked, places, links, breadth)
    least = Window.partitionBy("_vector").orderBy("_far", "_id")
    merged = found.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= places)
    listed = merged.groupBy("_vector").agg(F.sort_array(F.collect_list(F.struct("_far", "_id"))).alias("_best"))
    own = F.filter("_best", lambda b: b["_id"] != F.col("query_id"))
    joined = asked.select(F.col("_id").alias("query_id"), "_vector").join(listed, "_vector")
    ranked = joined.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("_at", "_b"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_b._id").alias(key), F.col("_b._far").alias("score"))
