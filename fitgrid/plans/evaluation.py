"""Hold-out evaluation of registered models, once or over several seeds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..models.classify import REGISTRY, ModelSpec
from ..operators.features import FLAT, Scaler, drop_warmup
from ..operators.split import counted, random_tests
from ..operators.stats import sample_stats

ROWS_PER_TASK = 20_000
PARALLEL_FITS = 4
AT_ONCE = 200


def right_sized(df: DataFrame, key: str, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Partitions for training: every fit runs many short jobs over them.

    A small table gets as many as its rows can use, at most one per core; a
    large one keeps the partitions it has.
    """
    have = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    useful = max(1, math.ceil(rows / rows_per_task))
    wanted = min(useful, max(have, cores))
    return df if wanted == have else df.repartition(wanted, key)


def in_parallel(fit: Callable, items: Iterable) -> list:
    """Independent fits share the cluster, a few at a time."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(fit, items))


@dataclass(frozen=True)
class HoldOut:
    """Cached vectors of both parts, with the scaler fitted on the train part."""

    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    width: int
    classes: int
    scaler: Scaler


@contextmanager
def hold_outs(
    df: DataFrame, key: str, features: Sequence[str], label: str, test_size: float = 0.2, seeds: Sequence[int] = (42,)
) -> Iterator[list[HoldOut]]:
    """One split per seed over one cached table, for the time of the ``with`` block.

    Borders, scalers and sizes of all splits come from the same passes; a split is a comparison with
    literals. ``label`` holds class codes 0..k-1. Columns: key, label, raw, scaled.
    """
    features, seeds = list(features), list(seeds)
    base = df.select(key, *features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = counted(base, [key])
        sized = right_sized(base, key, rows)
        marked = random_tests(sized, key, test_size, seeds, rows)
        found, step = [], max(1, AT_ONCE // (2 * len(features) + 2))
        for at in range(0, len(seeds), step):
            aggs = []
            for i in range(at, min(at + step, len(seeds))):
                train = ~F.col(f"_test{i}")
                aggs += [F.count_if(train).alias(f"n{i}")]
                for j, c in enumerate(features):
                    value = F.when(train, F.col(c).cast("double"))
                    aggs += [F.avg(value).alias(f"m{i}_{j}"), F.stddev_pop(value).alias(f"s{i}_{j}")]
            found.append(marked.agg(F.max(label).alias("top"), *aggs).first().asDict())
        known = {k: v for part in found for k, v in part.items()}
        yield [_held(marked, key, features, label, i, known, rows) for i in range(len(seeds))]
    finally:
        base.unpersist()


def _held(marked: DataFrame, key: str, features: list[str], label: str, i: int, known: dict, rows: int) -> HoldOut:
    # a deviation that is nothing but rounding counts as 1, as in the scaler's own fit
    spreads = [known[f"s{i}_{j}"] for j in range(len(features))]
    scaler = Scaler({c: (known[f"m{i}_{j}"], 1.0 if spreads[j] < FLAT else spreads[j]) for j, c in enumerate(features)})
    raw_vector = VectorAssembler(inputCols=features, outputCol="raw")
    scaled_vector = VectorAssembler(inputCols=[f"{c}_z" for c in features], outputCol="scaled")
    both = scaled_vector.transform(raw_vector.transform(scaler.transform(marked, features, "_z")))
    parts = [
        both.filter(test).select(key, F.col(label).cast("double").alias("label"), "raw", "scaled") for test in (~F.col(f"_test{i}"), F.col(f"_test{i}"))
    ]
    n_train = known[f"n{i}"]
    return HoldOut(*parts, n_train, rows - n_train, len(features), int(known["top"]) + 1, scaler)


@contextmanager
def hold_out(
    df: DataFrame, key: str, features: Sequence[str], label: str, test_size: float = 0.2, seed: int = 42
) -> Iterator[HoldOut]:
    """Split, scale and cache for the time of the ``with`` block."""
    with hold_outs(df, key, features, label, test_size, [seed]) as found:
        yield found[0]


def fit_spec(data: HoldOut, spec: ModelSpec, seed: int = 42):
    estimator = spec.build(data.width, data.classes, seed, spec.features, "label")
    return estimator.fit(data.train)


def quality(predicted: DataFrame) -> tuple[int, float, float]:
    """Correct rows, accuracy and balanced accuracy; one row per class is added up in Spark."""
    hit = (F.col("label") == F.col("prediction")).cast("int")
    per_class = predicted.groupBy("label").agg(F.sum(hit).alias("right"), F.count(F.lit(1)).alias("n"))
    right, total, recall = per_class.agg(F.sum("right"), F.sum("n"), F.avg(F.col("right") / F.col("n"))).first()
    if not total:
        raise ValueError("there is no row to judge")
    return int(right), right / total, float(recall)


def score_spec(data: HoldOut, spec: ModelSpec, seed: int = 42) -> tuple:
    right, share, balanced = quality(fit_spec(data, spec, seed).transform(data.test))
    return spec.name, spec.features, data.n_train, data.n_test, right, share, balanced


MATRIX = (
    "algorithm string, feature_set string, n_train bigint, n_test bigint, correct bigint, "
    "accuracy double, balanced_accuracy double"
)


def model_matrix(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    models: Mapping[str, ModelSpec] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """One row per model: hold-out quality on the same split and scaling."""
    models = models or REGISTRY
    with hold_out(df, key, features, label, test_size, seed) as data:
        rows = in_parallel(lambda spec: score_spec(data, spec, seed), models.values())
    return df.sparkSession.createDataFrame(rows, MATRIX)


def run_results(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    spec: ModelSpec,
    seeds: Sequence[int],
    test_size: float = 0.2,
) -> DataFrame:
    """One row per seed, numbered by ``run``; split and model both use the seed.

    The splits of all seeds are found together; the models are then fitted from the same cached table.
    """
    seeds = list(seeds)
    with hold_outs(df, key, features, label, test_size, seeds) as data:
        rows = in_parallel(lambda i: (i, seeds[i], *score_spec(data[i], spec, seeds[i])), range(len(seeds)))
    return df.sparkSession.createDataFrame(rows, f"run int, seed int, {MATRIX}")


def repeated_runs(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    spec: ModelSpec,
    seeds: Sequence[int],
    warmup: int = 0,
    test_size: float = 0.2,
) -> DataFrame:
    """Accuracy statistics per model over the runs after the warmup."""
    runs = run_results(df, key, features, label, spec, seeds, test_size)
    return sample_stats(drop_warmup(runs, "run", warmup), ["algorithm"], "accuracy")
