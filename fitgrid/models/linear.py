"""Least squares from moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sums import partition_sums, rows_as_matrix

MAX_MOMENT_FEATURES = 40


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def expression(self) -> Column:
        """The prediction as one generated-code expression."""
        score = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            score = score + F.lit(weight) * F.col(name).cast("double")
        return score

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression())


def fit_ols(df: DataFrame, features: Sequence[str], label: str, most_expressions: int = MAX_MOMENT_FEATURES) -> LinearModel:
    """Ordinary least squares with intercept, over the rows that have all values.

    Only the centred second moments reach the driver, whatever the width; dependent features
    share their weight (the shortest solution). ``most_expressions`` decides how the moments
    are added up, as generated expressions or as matrices of batches, and nothing else.
    """
    features = list(features)
    d = len(features)
    whole = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])])
    whole = whole.filter(F.forall(F.array(*whole.columns), lambda v: v.isNotNull()))
    if d > most_expressions:
        mean = np.array(whole.agg(*[F.avg(c) for c in whole.columns]).first(), dtype=float)
        cov = _block_moments(whole, mean)[:d]
    else:
        mean, cov = _expression_moments(whole)
    if np.isnan(mean).any():
        raise ValueError("there is no row that has all values")
    weights = np.linalg.lstsq(cov[:, :d], cov[:, d], rcond=None)[0]
    intercept = mean[d] - float(weights @ mean[:d])
    return LinearModel(tuple(features), tuple(float(w) for w in weights), float(intercept))


def _expression_moments(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means, and covariances of the features with each other and the label, in one aggregate."""
    cols = [F.col(c) for c in whole.columns]
    d = len(cols) - 1
    pairs = [(i, j) for i in range(d) for j in range(i, d + 1)]
    row = whole.agg(*[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    cov = np.full((d, d + 1), np.nan)
    for (i, j), value in zip(pairs, row[d + 1 :]):
        cov[i, j] = np.nan if value is None else value
        if j < d:
            cov[j, i] = cov[i, j]
    return np.array(row[: d + 1], dtype=float), cov


def _block_moments(whole: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sums of products of the centred columns."""
    rows = whole.select(F.array(*whole.columns).alias("x"))

    def block(batch) -> np.ndarray:
        points = rows_as_matrix(batch.column("x")) - mean
        return points.T @ points

    return partition_sums(rows, block, rows.rdd.getNumPartitions()).reshape(len(mean), -1)


def ols_1d(df: DataFrame, feature: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R² of one feature, overall or per group."""
    y, x = F.col(label).cast("double"), F.col(feature).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
