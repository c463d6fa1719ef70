from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.models import kernel, kmeans, mlp, svm
from fitgrid.models.classify import mlp_forward
from fitgrid.models.kmeans import Centres, fit_kmeans_best_of, lloyd
from fitgrid.models.svm import LinearMachine, machines, sides
from fitgrid.operators.silhouette import silhouette_exact, silhouette_squared


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 0.5)
    rows = [(i, a.tolist(), int(c)) for i, (a, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(4).cache()


def test_slopes_are_those_of_the_loss():
    draw = np.random.default_rng(2)
    layers = [3, 5, 4, 3]
    flat, x, y = mlp.pack(mlp.start(layers, 1)), draw.normal(size=(20, 3)), draw.integers(0, 3, 20)
    found = mlp.gradient(x, y, flat, layers)
    assert found[0] == 20
    for i in range(0, len(flat), 7):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert found[2 + i] == pytest.approx((mlp.gradient(x, y, up, layers)[1] - mlp.gradient(x, y, down, layers)[1]) / 2e-6, abs=1e-4)


def test_steps_in_a_task_and_in_jobs_agree(points):
    _, _, df = points
    one, many = (
        mlp.Perceptron(3, (6,), max_iter=3, key="id", steps=3, in_task_values=n).fit(df) for n in (10**6, 0)
    )
    assert np.allclose(one.flat, many.flat, atol=1e-9) and np.allclose(one.losses, many.losses)


def test_perceptron_learns_and_stops(points):
    x, y, df = points
    model = mlp.Perceptron(3, (30, 20), key="id", batch_rows=50, max_iter=300).fit(df)
    scored = model.transform(df).orderBy("id").collect()
    assert np.mean([r["prediction"] == c for r, c in zip(scored, y)]) > 0.9
    assert model.losses[-1] < 0.3 * model.losses[0]
    early = mlp.Perceptron(3, (4,), key="id", tol=10.0, max_iter=300).fit(df)
    assert len(early.losses) == 12
    scored = early.transform(df).orderBy("id").collect()
    pairs = [(w.tolist(), b.tolist()) for w, b in early.weights()]
    shares = mlp_forward([F.get("features", F.lit(j)) for j in range(3)], pairs)
    for r, s in zip(scored, df.orderBy("id").select(F.array(*shares).alias("p")).collect()):
        assert r["probability"] == pytest.approx(s["p"])


def test_machines_see_bounded_slices(points, monkeypatch):
    x, y, df = points
    seen = svm.partition_sums

    def checked(rows, block, partitions, *most):
        def small(batch):
            if batch.num_rows > 10:
                raise AssertionError("more rows than a slice")
            return block(batch)

        return seen(rows, small, partitions, *most)

    whole = [LinearMachine(classes=3, moment_bytes=b).fit(df).weights for b in (1 << 20, 0)]
    monkeypatch.setattr(svm, "SLICE_VALUES", 40)
    monkeypatch.setattr(svm, "partition_sums", checked)
    sliced = [LinearMachine(classes=3, moment_bytes=b).fit(df).weights for b in (1 << 20, 0)]
    assert np.allclose(whole, sliced, atol=1e-6)


def test_fourier_features_need_little_beside_themselves():
    points = np.random.default_rng(3).normal(size=(20_000, 8))
    weights, phases = kernel.rbf_weights(8, 200, 0.5, 1)
    tracemalloc.start()
    found = kernel.fourier(points, weights, phases)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * found.nbytes
    assert np.allclose(found, np.sqrt(2.0 / 200) * np.cos(points @ weights + phases), atol=1e-12)


def test_pairs_against_each_machine_alone(points):
    x, y, df = points
    model = LinearMachine(classes=3, vote="pairs").fit(df)
    assert model.weights.shape == (3, 4)
    votes = np.zeros((len(x), 3))
    for w, (a, b) in zip(model.weights, machines(3, "pairs")):
        some = df.filter(F.col("label").isin(a, b)).withColumn("label", (F.col("label") == a).cast("int"))
        alone = LinearMachine(classes=2).fit(some).weights[0]
        assert np.allclose(w, alone, atol=1e-6)
        f = x @ w[:-1] + w[-1]
        votes[np.arange(len(x)), np.where(f > 0, a, b)] += 1
    got = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    assert got == votes.argmax(axis=1).tolist()
    with pytest.raises(ValueError, match="pairs"):
        model.with_vote("margin")
    assert sides(np.array([0, 1, 2]), (1, 2)).tolist() == [0.0, 1.0, -1.0]


def test_conjugate_gradients_reach_the_same_minimum(points):
    _, _, df = points
    for vote in ("margin", "pairs"):
        narrow, wide = (LinearMachine(classes=3, vote=vote, cost=2.0, moment_bytes=n, tol=1e-8).fit(df) for n in (10**9, 0))
        assert np.allclose(narrow.weights, wide.weights, atol=1e-5)


def test_five_thousand_features(spark):
    """Ten classes of wide vectors: a pass returns classes times width numbers, not their square."""
    rows = spark.range(200).select(
        F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda j: F.when(F.pmod(j, F.lit(10)) == F.pmod("id", F.lit(10)), 1.0).otherwise(0.0)).alias("features"),
        F.pmod("id", F.lit(10)).cast("int").alias("label"),
    )
    model = LinearMachine(classes=10).fit(rows)
    assert model.weights.shape == (10, 5001)
    assert model.transform(rows).filter("label != prediction").count() == 0


@pytest.mark.parametrize("bad", [None, [1.0, None], [float("nan"), 1.0], [1.0, float("-inf")]])
def test_incomplete_vectors_are_refused_everywhere(spark, bad):
    rows = [(i, [float(i), 1.0], i % 2) for i in range(6)] + [(9, bad, 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, c int")
    for run in (
        lambda: fit_kmeans_best_of(df, "x", 2),
        lambda: lloyd(df, "x", Centres.of([[0.0, 0.0], [1.0, 1.0]]), 1),
        lambda: LinearMachine("x", "c").fit(df),
        lambda: mlp.Perceptron(2, (2,), "x", "c").fit(df),
        lambda: silhouette_exact(df, "id", "x", "c"),
        lambda: silhouette_squared(df, "x", "c"),
    ):
        with pytest.raises(ValueError, match="1 of 7 vectors"):
            run()


def test_oversampled_starts_find_far_groups(spark, monkeypatch):
    draw = np.random.default_rng(0)
    middles = draw.normal(size=(40, 5)) * 20
    x = np.concatenate([m + draw.normal(size=(30, 5)) for m in middles] + [np.full((2, 5), 500.0)])
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, x array<double>")
    passes = []
    plain = kmeans.partition_sums
    monkeypatch.setattr(kmeans, "partition_sums", lambda *a: passes.append(1) or plain(*a))
    many = fit_kmeans_best_of(df, "x", 41, seeds=(0, 1), key="id", max_iter=20)
    assert any(np.allclose(p, 500.0) for p in many.centres.points)
    assert len(passes) <= 5 + 1 + 1 + 21
    monkeypatch.setattr(kmeans, "ONE_BY_ONE", 100)
    few = fit_kmeans_best_of(df, "x", 41, seeds=(0, 1), key="id", max_iter=20)
    assert many.cost < 2 * few.cost


def test_oversampling_with_few_different_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 3)]) for i in range(30)], "id long, x array<double>")
    best = fit_kmeans_best_of(df, "x", 40, seeds=(0,), key="id")
    assert best.cost == 0.0 and len(best.centres.points) == 40


def test_candidates_reduce_to_their_weights():
    candidates = np.array([[0.0], [10.0], [10.1], [50.0]])
    picked = [kmeans.reduced(candidates, np.array([100.0, 60.0, 50.0, 40.0]), 3, seed).ravel() for seed in range(20)]
    assert sum({0.0, 50.0} <= set(p) for p in picked) >= 18
