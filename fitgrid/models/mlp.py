"""Multilayer perceptron: ReLU units, softmax classes, minibatches and Adam.

Rows are dealt into minibatches by the hash of their key, once; the order of the batches changes with the
epoch. A step adds up one gradient block per task over the rows of its batch, which the cache finds
without a scan, since each partition is sorted by batch; the optimiser's state is as small as the weights
and stays on the driver. A table whose rows fit a task takes the same steps there, without a job for each.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import argmax
from ..plans.sums import partition_sums, rows_as_matrix
from ..plans.vectors import complete_vectors
from .kmeans import _key_halves
from .svm import as_array

BATCH_ROWS = 200
IN_TASK_VALUES = 1 << 20
MOST_STEPS = 32
PATIENCE = 10
# Adam's defaults and the penalty of the weights.
RATE, FADE, FADE_SQUARES, TINY = 1e-3, 0.9, 0.999, 1e-8
PENALTY = 1e-4


def start(layers: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases drawn evenly, in a range that keeps the size of signals and gradients alike."""
    draw, out = np.random.default_rng(seed), []
    for a, b in zip(layers, layers[1:]):
        reach = math.sqrt(6.0 / (a + b))
        out.append((draw.uniform(-reach, reach, (a, b)), draw.uniform(-reach, reach, b)))
    return out


def batch_order(seed: int, epoch: int, steps: int) -> list[int]:
    return sorted(range(steps), key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())


def pack(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([a.ravel() for pair in parts for a in pair])


def unpack(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        weights, at = flat[at : at + a * b].reshape(a, b), at + a * b
        out.append((weights, flat[at : at + b]))
        at += b
    return out


def signals(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What every layer puts out, the input first and class probabilities last."""
    out = [x]
    for depth, (weights, biases) in enumerate(net, 1):
        z = out[-1] @ weights + biases
        if depth < len(net):
            out.append(np.maximum(z, 0.0))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
    return out


def gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, layers: list[int]) -> np.ndarray:
    """Rows, summed loss and summed slopes, without the penalty."""
    net = unpack(flat, layers)
    out = signals(x, net)
    rows = np.arange(len(y))
    shares = out[-1]
    loss = -np.log(np.maximum(shares[rows, y], np.finfo(float).tiny)).sum()
    slope = shares.copy()
    slope[rows, y] -= 1.0
    parts = []
    for depth in range(len(net) - 1, -1, -1):
        parts.insert(0, (out[depth].T @ slope, slope.sum(axis=0)))
        if depth:
            slope = (slope @ net[depth][0].T) * (out[depth] > 0)
    return np.concatenate([[len(y), loss], pack(parts)])


@dataclass
class Training:
    """Weights and the optimiser's state."""

    layers: list[int]
    seed: int
    tol: float
    flat: np.ndarray = field(init=False)
    losses: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.flat = pack(start(self.layers, self.seed))
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.penalised = pack([(np.ones((a, b)), np.zeros(b)) for a, b in zip(self.layers, self.layers[1:])])
        self.steps, self.idle, self.best = 0, 0, math.inf
        self.rows, self.total = 0.0, 0.0

    def step(self, sums: np.ndarray) -> None:
        rows, loss = sums[:2]
        if not rows:
            return
        weights = self.flat * self.penalised
        slope = (sums[2:] + PENALTY * weights) / rows
        self.rows += rows
        self.total += loss + 0.5 * PENALTY * float(weights @ weights)
        self.steps += 1
        self.mean = FADE * self.mean + (1 - FADE) * slope
        self.square = FADE_SQUARES * self.square + (1 - FADE_SQUARES) * np.square(slope)
        rate = RATE * math.sqrt(1 - FADE_SQUARES**self.steps) / (1 - FADE**self.steps)
        self.flat = self.flat - rate * self.mean / (np.sqrt(self.square) + TINY)

    def epoch_ends(self) -> bool:
        """Whether the loss has stopped falling by ``tol`` for a while."""
        loss = self.total / max(self.rows, 1.0)
        self.rows, self.total = 0.0, 0.0
        self.losses.append(loss)
        self.idle = self.idle + 1 if loss > self.best - self.tol else 0
        self.best = min(self.best, loss)
        return self.idle > PATIENCE


class Perceptron(Estimator):
    """Layers of ReLU units and one softmax unit per class, codes 0..classes-1.

    An epoch has one step per ``batch_rows`` rows, at most ``most_steps`` where the steps are jobs (then
    batches are larger), or ``steps``. Training ends after ``max_iter`` epochs or once the loss has not
    fallen by ``tol`` for more than ten. Without ``key`` rows are named by their vector. Rows without label
    are not used; vectors have to be complete.
    """

    def __init__(
        self, classes=2, hidden=(100, 50), features="features", label="label", max_iter=500, tol=1e-4, seed=42, key=None,
        batch_rows=BATCH_ROWS, steps=None, in_task_values=IN_TASK_VALUES, most_steps=MOST_STEPS,
    ):
        super().__init__()
        self.classes, self.hidden, self.features, self.label = classes, tuple(hidden), features, label
        self.max_iter, self.tol, self.seed, self.key = max_iter, tol, seed, key
        self.batch_rows, self.steps, self.in_task_values, self.most_steps = batch_rows, steps, in_task_values, most_steps

    def _fit(self, df: DataFrame) -> PerceptronModel:
        x = as_array(df, self.features)
        name = F.col(self.key) if self.key else F.to_json(F.array(x))
        rows = df.filter(F.col(self.label).isNotNull()).select(x.alias("x"), F.col(self.label).cast("int").alias("y"), *_key_halves(name))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            count, width = complete_vectors(rows)
            steps = self.steps or math.ceil(count / self.batch_rows)
            training = Training([width, *self.hidden, self.classes], self.seed, self.tol)
            if count * width <= self.in_task_values:
                self._in_task(rows, training, steps)
            else:
                self._in_jobs(rows, training, self.steps or min(steps, self.most_steps))
        finally:
            rows.unpersist()
        return PerceptronModel(training.layers, training.flat, training.losses, self.features)

    def _in_task(self, rows: DataFrame, training: Training, steps: int) -> None:
        """The whole table is a few megabytes at most: all steps run in one task."""
        epochs = self.max_iter

        def run(batches):
            table = pa.Table.from_batches([b for b in batches if b.num_rows])
            points = rows_as_matrix(table.column("x"))
            y, h0, h1 = (table.column(c).to_numpy() for c in ("y", "h0", "h1"))
            order = np.lexsort((*points.T, y, h1, h0))  # sums do not hang on the order of arrival
            points, y, part = points[order], y[order], (h0 % steps)[order]
            parts = [np.flatnonzero(part == b) for b in range(steps)]
            for epoch in range(epochs):
                for b in batch_order(training.seed, epoch, steps):
                    training.step(gradient(points[parts[b]], y[parts[b]], training.flat, training.layers))
                if training.epoch_ends():
                    break
            lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (training.flat, np.array(training.losses))]
            yield pa.RecordBatch.from_arrays(lists, ["flat", "losses"])

        found = rows.coalesce(1).mapInArrow(run, "flat array<double>, losses array<double>").first()
        training.flat, training.losses = np.array(found["flat"]), list(found["losses"])

    def _in_jobs(self, rows: DataFrame, training: Training, steps: int) -> None:
        parts = rows.rdd.getNumPartitions()
        dealt = rows.select("x", "y", F.pmod("h0", F.lit(steps)).alias("batch")).sortWithinPartitions("batch").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for epoch in range(self.max_iter):
                for b in batch_order(training.seed, epoch, steps):
                    flat, layers = training.flat, training.layers
                    some = dealt.filter(F.col("batch") == b).select("x", "y")

                    def block(batch, flat=flat, layers=layers):
                        return gradient(rows_as_matrix(batch.column("x")), batch.column("y").to_numpy(), flat, layers)

                    sums = partition_sums(some, block, parts)
                    training.step(sums if np.ndim(sums) else np.zeros(2 + len(flat)))
                if training.epoch_ends():
                    break
        finally:
            dealt.unpersist()


class PerceptronModel(Model):
    """Adds ``probability`` and ``prediction``, the first of the largest."""

    def __init__(self, layers: list[int], flat: np.ndarray, losses: list[float], features="features", prediction="prediction"):
        super().__init__()
        self.layers, self.flat, self.losses = layers, flat, losses
        self.features, self.prediction = features, prediction

    def weights(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return unpack(self.flat, self.layers)

    def _transform(self, df: DataFrame) -> DataFrame:
        net = self.weights()

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.list_(pa.float64()))
            shares = signals(rows_as_matrix(x), net)[-1]
            ends = np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, shares.ravel())

        scored = df.withColumn("probability", score(as_array(df, self.features)))
        return scored.withColumn(self.prediction, argmax(F.col("probability")).cast("double"))
