"""k-means: several starts in the same passes, and Lloyd steps from given centres."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sums import partition_sums, rows_as_matrix
from ..plans.vectors import complete_vectors

MAX_CENTRES = 10_000
# The draw's modulus, a prime, and the hexadecimal digits of each half of the key's hash.
PRIME = (1 << 31) - 1
HALF = 15


NEAREST_CELLS = 1 << 22
# Up to so many centres are drawn one after the other, a pass each; more are drawn in rounds.
ONE_BY_ONE = 32
ROUNDS = 5
OVERSAMPLING = 2.0


def nearest_centres(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, the lowest on ties, and the squared distance to it.

    Inner products narrow each row down to the centres that rounding could make nearest;
    their exact distances decide.
    """
    best = np.zeros(len(points), dtype=np.int32)
    step = max(1, NEAREST_CELLS // max(1, len(centres)))
    square = np.square(centres).sum(axis=1)
    for at in range(0, len(points), step):
        part = points[at : at + step]
        size = np.square(part).sum(axis=1)
        rough = square[None, :] - 2.0 * (part @ centres.T)
        slack = 1e-9 * (size + square.max(initial=0.0))
        close = rough <= (rough.min(axis=1) + slack)[:, None]
        best[at : at + step] = close.argmax(axis=1)
        tied = np.flatnonzero(close.sum(axis=1) > 1)
        least = np.full(len(tied), np.inf)
        for c in np.flatnonzero(close[tied].any(axis=0)):
            far = np.where(close[tied, c], np.square(part[tied] - centres[c]).sum(axis=1), np.inf)
            closer = far < least
            best[at + tied[closer]], least[closer] = c, far[closer]
    gap = points - centres[best]
    return best, np.einsum("ij,ij->i", gap, gap)


@dataclass(frozen=True)
class Centres:
    """Cluster centres; at most ``MAX_CENTRES`` of them, so they travel with the task."""

    points: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, points: Sequence[Sequence[float]]) -> Centres:
        if len(points) > MAX_CENTRES:
            raise ValueError(f"more than {MAX_CENTRES} centres")
        return cls(tuple(tuple(float(v) for v in p) for p in points))

    def frame(self, spark) -> DataFrame:
        rows = [(i, j, v) for i, p in enumerate(self.points) for j, v in enumerate(p)]
        return spark.createDataFrame(rows, "cluster int, pos int, value double")

    def nearest(self, col: Column | str) -> Column:
        """``struct(cluster, cost)`` of the nearest centre, the lowest number on ties."""
        matrix = np.array(self.points)

        @F.arrow_udf("cluster int, cost double")
        def nearest(x: pa.Array) -> pa.Array:
            points = rows_as_matrix(x) if len(x) else np.empty((0, matrix.shape[1]))
            best, cost = nearest_centres(points, matrix)
            return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(cost)], ["cluster", "cost"])

        return nearest(col)


def assign_cluster(df: DataFrame, col: str, centres: Centres, out: str = "cluster") -> DataFrame:
    """Set the nearest centre's number and the squared distance ``cost``."""
    kept = [c for c in df.columns if c not in (out, "cost")]
    return df.withColumn("_near", centres.nearest(F.col(col).cast("array<double>"))).select(
        *kept, F.col("_near.cluster").alias(out), F.col("_near.cost").alias("cost")
    )


def lloyd(df: DataFrame, col: str, centres: Centres, n_iter: int) -> Centres:
    """``n_iter`` rounds of assign and average; an empty cluster keeps its centre.

    Each round is one pass; a task adds up its rows per cluster, so a cluster
    with most of the rows costs no more than a small one. Vectors have to be complete.
    """
    data = df.select(F.col(col).cast("array<double>").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        complete_vectors(data)
        partitions = data.rdd.getNumPartitions()
        for _ in range(n_iter):
            old = np.array(centres.points)
            sums = partition_sums(data, _assigned_sums(old), partitions).reshape(len(old), -1)
            size = sums[:, :1]
            centres = Centres.of(np.where(size > 0, sums[:, 1:] / np.maximum(size, 1.0), old))
    finally:
        data.unpersist()
    return centres


def _assigned_sums(centres: np.ndarray):
    """Rows and coordinate sums per nearest centre of a batch."""

    def block(batch) -> np.ndarray:
        points = rows_as_matrix(batch.column("x"))
        best, _ = nearest_centres(points, centres)
        out = np.zeros((len(centres), 1 + points.shape[1]))
        out[:, 0] = np.bincount(best, minlength=len(centres))
        for j in range(points.shape[1]):
            out[:, 1 + j] = np.bincount(best, weights=points[:, j], minlength=len(centres))
        return out

    return block


@dataclass(frozen=True)
class BestOf:
    """Centres of the cheapest start, and the cost of every start."""

    centres: Centres
    costs: dict[int, float]
    seed: int

    @property
    def cost(self) -> float:
        return self.costs[self.seed]


def draw_factors(seed: int, turn: int) -> tuple[int, int]:
    """Two multipliers that turn the halves of a key's hash into the draw of one turn of a start."""
    digest = hashlib.md5(f"{seed}:{turn}".encode()).hexdigest()
    return tuple(int(digest[a : a + HALF], 16) % (PRIME - 1) + 1 for a in (0, HALF))


def _key_halves(key: Column) -> list[Column]:
    digest = F.md5(key.cast("string"))
    return [
        F.pmod(F.conv(F.substring(digest, 1 + a, HALF), 16, 10).cast("bigint"), F.lit(PRIME)).alias(f"h{i}")
        for i, a in enumerate((0, HALF))
    ]


def _race(starts: np.ndarray, seeds: Sequence[int], turn: int):
    """Each start's winner of a weighted race among the rows of a partition.

    A row's time is its exponential draw over its squared distance to the centres so far;
    the least time of all rows is a draw in proportion to the squared distance.
    """
    factors = [draw_factors(seed, turn) for seed in seeds]

    def run(batches):
        best: list[tuple | None] = [None] * len(factors)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = rows_as_matrix(batch.column("x"))
            h0, h1 = (batch.column(c).to_numpy() for c in ("h0", "h1"))
            for s, (f0, f1) in enumerate(factors):
                share = (h0 * f0 % PRIME + (h1 * f1 % PRIME + 0.5) / PRIME) / PRIME
                weight = nearest_centres(points, starts[s])[1] if turn else np.ones(len(points))
                time = np.full(len(points), np.inf)
                np.divide(-np.log(share), weight, out=time, where=weight > 0)
                # rows of equal time: the least vector, so that the result does not hang on their order
                i = int(np.lexsort((*points.T[::-1], time))[0]) if (time == time.min()).sum() > 1 else int(time.argmin())
                found = (float(time[i]), points[i].tolist())
                if best[s] is None or found < best[s]:
                    best[s] = found
        rows = [(s, *b) for s, b in enumerate(best) if b is not None]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                names=["start", "time", "x"],
            )

    return run


def spread_starts(data: DataFrame, k: int, seeds: Sequence[int]) -> np.ndarray:
    """``k`` starting centres for each seed, drawn among all rows in proportion to their squared distance.

    ``data`` has ``x`` and the key's halves ``h0, h1``. One pass finds the next centre of all
    starts. Where no row is away from a start's centres, its first centre is repeated.
    """
    starts = np.empty((len(seeds), 0, 0))
    for turn in range(k):
        rows = data.mapInArrow(_race(starts, seeds, turn), "start int, time double, x array<double>")
        first = F.min(F.struct("time", "x")).alias("first")
        won = {r["start"]: r["first"] for r in rows.groupBy("start").agg(first).collect()}
        if not won:
            raise ValueError("there are no rows")
        fresh = [won[s]["x"] if math.isfinite(won[s]["time"]) or not turn else starts[s, 0].tolist() for s in range(len(seeds))]
        added = np.array(fresh, dtype=float)[:, None, :]
        starts = added if not turn else np.concatenate([starts, added], axis=1)
    return starts


def _oversampled(candidates: list[np.ndarray], shares: np.ndarray, seeds: Sequence[int], turn: int):
    """Rows of a partition that a round takes: each by itself, with a chance in proportion to its cost."""
    factors = [draw_factors(seed, turn) for seed in seeds]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = rows_as_matrix(batch.column("x"))
            h0, h1 = (batch.column(c).to_numpy() for c in ("h0", "h1"))
            for s, (f0, f1) in enumerate(factors):
                drawn = (h0 * f0 % PRIME + (h1 * f1 % PRIME + 0.5) / PRIME) / PRIME
                some = np.flatnonzero(drawn < shares[s] * nearest_centres(points, candidates[s])[1])
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(points[some].tolist(), pa.list_(pa.float64()))], ["start", "x"])

    return run


def oversampled_candidates(
    data: DataFrame, k: int, seeds: Sequence[int], rounds: int = ROUNDS, oversampling: float = OVERSAMPLING
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each seed some ``rounds * oversampling * k`` candidate centres and the rows nearest to each.

    After one first row a round takes every row with a chance of ``oversampling * k`` times its part of
    the cost, all rows at once (Bahmani and others, 2012), so there are two passes a round however large ``k`` is.
    """
    partitions = data.rdd.getNumPartitions()
    candidates = [c.copy() for c in spread_starts(data, 1, seeds)]
    for turn in range(1, rounds + 1):
        held = [c.copy() for c in candidates]

        def cost(batch, held=held):
            points = rows_as_matrix(batch.column("x"))
            return np.array([nearest_centres(points, c)[1].sum() for c in held])

        costs = partition_sums(data, cost, partitions)
        shares = np.divide(oversampling * k, costs, out=np.zeros(len(costs)), where=costs > 0)
        taken = data.mapInArrow(_oversampled(held, shares, seeds, turn), "start int, x array<double>").collect()
        for s in range(len(seeds)):
            fresh = sorted(r["x"] for r in taken if r["start"] == s)
            if fresh:
                candidates[s] = np.concatenate([candidates[s], np.array(fresh)])

    def members(batch):
        points = rows_as_matrix(batch.column("x"))
        return np.concatenate([np.bincount(nearest_centres(points, c)[0], minlength=len(c)).astype(float) for c in candidates])

    sizes = np.split(partition_sums(data, members, partitions), np.cumsum([len(c) for c in candidates])[:-1])
    return list(zip(candidates, sizes))


def reduced(candidates: np.ndarray, sizes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted candidates, drawn in proportion to rows times squared distance to those before."""
    draw, far, chosen = np.random.default_rng(seed), np.ones(len(candidates)), []
    for turn in range(k):
        chance = sizes * far
        if not chance.sum():
            chosen.append(chosen[0])
            continue
        chosen.append(int(draw.choice(len(candidates), p=chance / chance.sum())))
        gap = np.square(candidates - candidates[chosen[-1]]).sum(axis=1)
        far = gap if not turn else np.minimum(far, gap)
    return candidates[chosen]


def oversampled_starts(data: DataFrame, k: int, seeds: Sequence[int], rounds: int = ROUNDS) -> np.ndarray:
    """``k`` starting centres for each seed, in a number of passes that does not grow with ``k``."""
    found = oversampled_candidates(data, k, seeds, rounds)
    return np.stack([reduced(c, n, k, seed) for (c, n), seed in zip(found, seeds)])


def _spread(points: np.ndarray) -> np.ndarray:
    """Rows, sums and sums of squares."""
    return np.stack([np.full(points.shape[1], len(points), dtype=float), points.sum(axis=0), np.square(points).sum(axis=0)])


def _costs_and_sums(starts: np.ndarray):
    """For each start: its cost on a batch, then rows and coordinate sums per centre."""

    def block(batch) -> np.ndarray:
        points = rows_as_matrix(batch.column("x"))
        k, d = starts.shape[1:]
        out = np.zeros((len(starts), 1 + k * (1 + d)))
        for s, centres in enumerate(starts):
            best, cost = nearest_centres(points, centres)
            sums = out[s, 1:].reshape(k, 1 + d)
            sums[:, 0] = np.bincount(best, minlength=k)
            for j in range(d):
                sums[:, 1 + j] = np.bincount(best, weights=points[:, j], minlength=k)
            out[s, 0] = cost.sum()
        return out

    return block


def fit_kmeans_best_of(
    df: DataFrame,
    col: str,
    k: int = 8,
    seeds: Sequence[int] = tuple(range(10)),
    max_iter: int = 100,
    tol: float = 1e-4,
    key: str | None = None,
) -> BestOf:
    """Best of several starts by cost over all rows; the lowest seed on ties.

    All starts advance in the same passes, so ten starts read the data as often
    as one, and every row takes part in all of them, the drawing of the starts
    included; beyond ``ONE_BY_ONE`` centres that takes ``ROUNDS`` rounds, whatever ``k``. ``key`` names the rows for the draws; without one they are named by
    their vector, and equal vectors are then drawn as one. Vectors have to be complete. A start is done when its centres' squared moves
    add up to at most ``tol`` times the mean variance of a feature.
    """
    name = F.col(key) if key else F.to_json(F.array(F.col(col).cast("array<double>")))
    data = df.select(F.col(col).cast("array<double>").alias("x"), *_key_halves(name)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        complete_vectors(data)
        partitions = data.rdd.getNumPartitions()
        starts = (spread_starts if k <= ONE_BY_ONE else oversampled_starts)(data, k, list(seeds))
        middle = starts[0, 0]
        rows, total, squares = partition_sums(data, lambda b: _spread(rows_as_matrix(b.column("x")) - middle), partitions).reshape(3, -1)
        still = tol * float((squares / rows - np.square(total / rows)).mean())
        moving = np.ones(len(starts), dtype=bool)
        costs = np.zeros(len(starts))
        for turn in range(max_iter + 1):
            live = np.flatnonzero(moving)
            sums = partition_sums(data, _costs_and_sums(starts[live]), partitions).reshape(len(live), -1)
            costs[live] = sums[:, 0]
            if turn == max_iter:
                break
            parts = sums[:, 1:].reshape(len(live), k, -1)
            size = parts[:, :, :1]
            moved = np.where(size > 0, parts[:, :, 1:] / np.maximum(size, 1.0), starts[live])
            moving[live] = np.square(moved - starts[live]).sum(axis=(1, 2)) > still
            # a start that stands still keeps the centres its cost belongs to
            keep = moving[live]
            starts[live[keep]] = moved[keep]
            if not moving.any():
                break
    finally:
        data.unpersist()
    by_seed = {seed: float(c) for seed, c in zip(seeds, costs)}
    best = min(range(len(costs)), key=lambda i: (costs[i], i))
    return BestOf(Centres.of(starts[best].tolist()), by_seed, list(seeds)[best])
