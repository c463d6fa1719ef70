"""Whole benchmark runs: a table in, result records, statistics and a report out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import to_double
from ..models.classify import REGISTRY, ModelSpec, linear_svc
from ..models.kmeans import assign_cluster, fit_kmeans_best_of
from ..models.linear import fit_ols
from ..operators.encode import encode_first_seen, encode_target
from ..operators.metrics import r2
from ..operators.silhouette import silhouette_exact, silhouette_squared
from ..operators.split import random_split
from ..operators.stats import append_results, dataset_profile
from ..sources.schemas import BENCHMARK_RESULTS, RESULT
from .evaluation import hold_out, quality
from .report import analyse, report_document


def timed(work: Callable):
    start = time.perf_counter()
    return work(), time.perf_counter() - start


def numeric_table(
    df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], target: str
) -> tuple[DataFrame, list[str]]:
    """``key``, numeric features first, category codes after, and ``label`` as a class code.

    Numbers are parsed leniently; codes follow first appearance in ``key`` order.
    """
    parsed = df.select(key, *[to_double(c).alias(c) for c in numeric], *categorical, target)
    coded = encode_target(parsed, target, key)
    if categorical:
        coded = encode_first_seen(coded, categorical, key)
    features = [*numeric, *[f"{c}_code" for c in categorical]]
    return coded.select(key, *[F.col(f).cast("double").alias(f) for f in features], "label"), features


def result_records(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str = "label",
    models: Mapping[str, ModelSpec] | None = None,
    runs: int = 5,
    warmup: int = 2,
    test_size: float = 0.2,
    seed: int = 42,
    library: str = "fitgrid",
) -> DataFrame:
    """One record per model and measured run; warmup runs are made and dropped.

    Models are fitted one after the other so that their times do not mix.
    """
    records = []
    with hold_out(df, key, features, label, test_size, seed) as data:
        for run in range(warmup + runs):
            for spec in (models or REGISTRY).values():
                estimator = spec.build(data.width, data.classes, seed, spec.features, "label")
                model, train = timed(lambda e=estimator: e.fit(data.train))
                (_, share, _), inference = timed(lambda m=model: quality(m.transform(data.test)))
                if run >= warmup:
                    records.append((library, spec.name, train, inference, share, None))
    return df.sparkSession.createDataFrame(records, RESULT)


def benchmark_report(profile: DataFrame, name: str, *results: DataFrame) -> DataFrame:
    """Ordered report lines for result records of one or several libraries."""
    _, stats = analyse(append_results(*results))
    return report_document(profile, stats, name)


def run_benchmark(
    df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], target: str, name: str, **options
) -> DataFrame:
    """From a labelled table to its report."""
    table, features = numeric_table(df, key, numeric, categorical, target)
    profile = dataset_profile(df.drop(key), target)
    return benchmark_report(profile, name, result_records(table, key, features, **options))


def _summary(df: DataFrame, **fields) -> DataFrame:
    row = tuple(fields.get(f.name) for f in BENCHMARK_RESULTS)
    return df.sparkSession.createDataFrame([row], BENCHMARK_RESULTS)


def run_regression(
    df: DataFrame, key: str, features: Sequence[str], target: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Least squares on a seeded split: times, throughput and R² of the test part."""
    split = random_split(df.select(key, *features, target), key, test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
        n_train, n_test = train.count(), test.count()
        model, fit_time = timed(lambda: fit_ols(train, features, target))
        score, test_time = timed(lambda: r2(model.transform(test), target, "prediction").first()[0])
    finally:
        split.unpersist()
    return _summary(
        df,
        total_training_time_seconds=fit_time,
        training_throughput_samples_per_sec=n_train / fit_time,
        inference_throughput_samples_per_sec=n_test / test_time,
        model_accuracy=score,
        metric_type="r2_score",
        training_samples=n_train,
        test_samples=n_test,
        features=len(features),
    )


def run_svm(
    df: DataFrame, key: str, features: Sequence[str], label: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Linear machine on raw features for any number of classes: times and accuracy."""
    with hold_out(df, key, features, label, test_size, seed) as data:
        model, fit_time = timed(lambda: linear_svc("raw", "label", data.classes).fit(data.train))
        (_, share, _), test_time = timed(lambda: quality(model.transform(data.test)))
        return _summary(
            df,
            total_training_time_seconds=fit_time,
            training_throughput_samples_per_sec=data.n_train / fit_time,
            inference_throughput_samples_per_sec=data.n_test / test_time,
            model_accuracy=share,
            metric_type="accuracy",
            training_samples=data.n_train,
            test_samples=data.n_test,
            features=data.width,
            classes=data.classes,
        )


def run_kmeans(
    df: DataFrame, key: str, col: str, k: int = 8, starts: int = 10, exact: bool = False
) -> DataFrame:
    """Best of several k-means starts: times and mean silhouette.

    ``exact`` takes the Euclidean silhouette over all pairs, which is quadratic;
    otherwise the squared form, which is linear in the rows.
    """
    points = df.select(key, F.col(col).cast("array<double>").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, width = points.count(), len(points.select("x").first()[0])
        best, fit_time = timed(lambda: fit_kmeans_best_of(points, "x", k, range(starts), key=key))
        assigned = assign_cluster(points, "x", best.centres)
        _, test_time = timed(lambda: assigned.groupBy("cluster").count().collect())
        if exact:
            score = silhouette_exact(assigned, key, "x", "cluster").agg(F.avg("silhouette")).first()[0]
        else:
            score = silhouette_squared(assigned, "x", "cluster").first()[0]
    finally:
        points.unpersist()
    return _summary(
        df,
        total_training_time_seconds=fit_time,
        training_throughput_samples_per_sec=rows / fit_time,
        inference_throughput_samples_per_sec=rows / test_time,
        model_accuracy=score,
        metric_type="silhouette_score",
        training_samples=rows,
        features=width,
        clusters=k,
    )
