"""Classifiers with the settings each task asks for."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.sql import Column, functions as F

from .kernel import RandomFourierFeatures
from .mlp import Perceptron
from .svm import LinearMachine
from .trees import Forest

PARALLEL_FITS = 4


def linear_svc(
    features: str = "features", label: str = "label", classes: int = 2, cost: float = 1.0, vote: str = "margin"
) -> Estimator:
    """Linear machine with squared hinge loss; beyond two classes one per class, or per pair with ``vote="pairs"``."""
    return LinearMachine(features, label, classes, cost, vote=vote)


def linear_svc_hinge(
    features: str = "features", label: str = "label", max_iter: int = 100, reg: float = 0.01, parallelism: int = PARALLEL_FITS
) -> Estimator:
    """Plain hinge loss, one machine per class, for very wide or sparse vectors.

    Gradient steps need no second moments, but hundreds of passes.
    """
    binary = LinearSVC(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=reg, tol=1e-3, standardization=False)
    return OneVsRest(classifier=binary, featuresCol=features, labelCol=label, parallelism=parallelism)


def rbf_svm(
    features: str = "features",
    label: str = "label",
    gamma: float = 0.5,
    n_features: int = 200,
    seed: int = 42,
    classes: int = 2,
    cost: float = 1.0,
    vote: str = "margin",
) -> Estimator:
    """Gaussian-kernel machine: random Fourier features and a linear machine."""
    mapped = f"{features}_rbf"
    stage = RandomFourierFeatures(features, mapped, gamma, n_features, seed)
    return Pipeline(stages=[stage, linear_svc(mapped, label, classes, cost, vote)])


def decision_tree(
    features: str = "features", label: str = "label", max_depth: int | None = None, seed: int = 42, classes: int = 2
) -> Estimator:
    """Gini tree with exact cuts; ``max_depth=None`` grows until nodes are pure or all alike."""
    return Forest(features, label, classes, max_depth=max_depth, seed=seed)


def random_forest(
    features: str = "features",
    label: str = "label",
    trees: int = 100,
    max_depth: int | None = None,
    seed: int = 42,
    classes: int = 2,
    width: int | None = None,
    key: str | None = None,
) -> Estimator:
    """Trees on rows drawn by hash; each node tries the square root of the features."""
    tried = max(1, math.isqrt(width)) if width else None
    return Forest(features, label, classes, trees, tried, max_depth, seed, bootstrap=True, key=key)


def mlp(
    classes: int,
    features: str = "features",
    label: str = "label",
    hidden: tuple[int, ...] = (100, 50),
    max_iter: int = 500,
    tol: float = 1e-4,
    seed: int = 42,
) -> Estimator:
    """Perceptron with two hidden layers; stops once the loss no longer falls by ``tol``."""
    return Perceptron(classes, hidden, features, label, max_iter, tol, seed)


def mlp_forward(inputs: Sequence[Column], layers: Sequence[tuple], activation: str = "relu") -> list[Column]:
    """Class probabilities of a perceptron with given ``(weights, biases)`` per layer, as generated code.

    ``weights[i][j]`` leads from input i to unit j; hidden units are ``relu`` or ``sigmoid``, the last layer softmax.
    """
    values = list(inputs)
    for depth, (weights, biases) in enumerate(layers):
        sums = []
        for j, bias in enumerate(biases):
            total = F.lit(float(bias))
            for i, value in enumerate(values):
                total = total + F.lit(float(weights[i][j])) * value
            sums.append(total)
        if depth + 1 == len(layers):
            most = F.greatest(*sums) if len(sums) > 1 else sums[0]
            shifted = [F.exp(s - most) for s in sums]
            whole = sum(shifted[1:], shifted[0])
            return [s / whole for s in shifted]
        values = [F.greatest(s, F.lit(0.0)) if activation == "relu" else 1.0 / (1.0 + F.exp(-s)) for s in sums]
    return values


@dataclass(frozen=True)
class ModelSpec:
    """A named way to train: which features it sees and how its estimator is built."""

    name: str
    features: str
    build: Callable[[int, int, int, str, str], Estimator]


# The five models of the standard comparison. ``build`` gets the feature count,
# the class count, the seed and the column names.
REGISTRY = {
    s.name: s
    for s in (
        ModelSpec(
            "SVC",
            "scaled",
            lambda d, k, seed, x, y: rbf_svm(x, y, gamma=1.0 / d, seed=seed, classes=k),
        ),
        ModelSpec(
            "LinearSVC",
            "scaled",
            lambda d, k, seed, x, y: linear_svc(x, y, k),
        ),
        ModelSpec("DecisionTreeClassifier", "raw", lambda d, k, seed, x, y: decision_tree(x, y, seed=seed, classes=k)),
        ModelSpec("RandomForestClassifier", "raw", lambda d, k, seed, x, y: random_forest(x, y, seed=seed, classes=k, width=d)),
        ModelSpec("MLPClassifier", "scaled", lambda d, k, seed, x, y: mlp(k, x, y, seed=seed)),
    )
}
