from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from fitgrid.models import trees
from fitgrid.models.kmeans import HALF, PRIME
from fitgrid.models.trees import Forest, draws, feature_order, middle, root_name
from fitgrid.plans.vectors import complete_vectors

SMALL = {"subtree_values": 200, "inside_rows": 20, "bins": 6}


def slow_tree(x, y, w, name, depth, tried, most):
    """All nodes below one, by exact fractions over all features and cuts."""
    total = {int(k): float(w[y == k].sum()) for k in np.unique(y)}
    here = (name, depth, tuple(sorted(total.items())))
    if len(total) < 2 or depth == most:
        return [(*here, None, None)]
    met = 0
    order = range(x.shape[1]) if tried >= x.shape[1] else feature_order(name, x.shape[1])
    found = []
    for f in order:
        values = np.unique(x[:, f])
        if len(values) < 2 or met == tried:
            continue
        met += 1
        for a, b in zip(values, values[1:]):
            score = Fraction(0)
            for side in (x[:, f] <= a, x[:, f] > a):
                n = int(w[side].sum())
                score += n - Fraction(sum(int(w[side & (y == k)].sum()) ** 2 for k in total), n)
            found.append((score, f, a, middle(a, b)))
    if not found:
        return [(*here, None, None)]
    best = min(found)
    left = x[:, best[1]] <= best[3]
    out = [(*here, best[1], best[3])]
    for side, mark in ((left, "L"), (~left, "R")):
        out += slow_tree(x[side], y[side], w[side], hashlib.md5((name + mark).encode()).hexdigest(), depth + 1, tried, most)
    return out


def nodes(model, tree):
    return sorted(
        (
            (r["name"], r["depth"], tuple(zip(r["cls"], r["n"])), r["feature"], r["border"])
            for r in model.nodes().filter(f"tree = {tree}").collect()
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(160, 3)), 1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(int) + (draw.random(160) < 0.1)) % 3
    rows = [(i, [float(v) for v in a], int(c)) for i, (a, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(3).cache()


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("depth", [None, 2])
def test_tree_equals_all_cuts(points, sizes, depth):
    x, y, df = points
    model = Forest(classes=3, max_depth=depth, **sizes).fit(df)
    want = slow_tree(x, y, np.ones(len(y)), root_name(42, 0), 0, 3, depth)
    assert nodes(model, 0) == sorted(want, key=repr)
    if depth is None:
        assert all(r["prediction"] == r["label"] for r in model.transform(df).collect()) == (len(np.unique(x, axis=0)) == len(x))


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_forest_equals_all_cuts_of_drawn_rows(points, sizes):
    x, y, df = points
    model = Forest(classes=3, trees=2, tried=1, max_depth=4, seed=5, bootstrap=True, key="id", **sizes).fit(df)
    digest = [hashlib.md5(str(i).encode()).hexdigest() for i in range(len(y))]
    h0, h1 = (np.array([int(d[a : a + HALF], 16) % PRIME for d in digest]) for a in (0, HALF))
    for tree in range(2):
        w = draws(h0, h1, 5, tree)
        some = w > 0
        assert 0.5 < some.mean() < 0.75 and abs(w.mean() - 1) < 0.25
        assert nodes(model, tree) == sorted(slow_tree(x[some], y[some], w[some], root_name(5, tree), 0, 1, 4), key=repr)


def test_large_models_score_alike(points):
    _, _, df = points
    model = Forest(classes=3, trees=3, tried=2, seed=5, bootstrap=True, key="id", **SMALL).fit(df)
    one = model.transform(df).orderBy("id").collect()
    model.model_nodes = 5
    old, trees.ROWS_PER_COPY = trees.ROWS_PER_COPY, 10
    try:
        assert model.transform(df).orderBy("id").collect() == one
    finally:
        trees.ROWS_PER_COPY = old


@pytest.mark.parametrize("sizes", [{}, {"subtree_values": 12, "inside_rows": 4, "bins": 4}])
def test_forty_levels_of_a_staircase(spark, sizes):
    """Classes alternate along steps that double in size, so every cut takes one step off the end."""
    steps = 41 if not sizes else 14
    rows = [([float(i)], i % 2, 2.0**i) for i in range(steps)]
    df = spark.createDataFrame([(x, y) for x, y, w in rows for _ in range(min(int(w), 1 << 8))], "features array<double>, label int").coalesce(2)
    model = Forest(**sizes).fit(df)
    assert model.size() == 2 * steps - 1
    assert all(r["prediction"] == r["label"] for r in model.transform(df).collect())


def test_depth_has_no_limit(spark):
    """Classes alternate along one feature: every cut takes single rows off an end."""
    chain = [([float(i), 0.0], i % 2) for i in range(90)]
    df = spark.createDataFrame(chain, "features array<double>, label int")
    model = Forest().fit(df)
    assert model.size() == 179 and model.nodes().agg({"depth": "max"}).first()[0] >= 40


def test_nothing_to_cut(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0)] * 3 + [([1.0, 2.0], 1)], "features array<double>, label int")
    assert Forest().fit(df).size() == 1 and Forest(**SMALL | {"subtree_values": 2}).fit(df).size() == 1
    assert {r["prediction"] for r in Forest().fit(df).transform(df).collect()} == {0.0}


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0]])
def test_incomplete_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([([1.0, 2.0], 0), (bad, 1)], "x array<double>, label int")
    with pytest.raises(ValueError, match="vectors"):
        complete_vectors(df)
    with pytest.raises(ValueError, match="vectors"):
        Forest("x").fit(df)
    with pytest.raises(ValueError, match="no rows"):
        complete_vectors(df.limit(0))
