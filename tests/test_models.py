from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.catalog.documents import LANGUAGE_FEATURES, QUALITY_FEATURES, language_table, quality_table
from fitgrid.models.classify import REGISTRY, linear_svc, linear_svc_hinge
from fitgrid.models.gini import gini_root_split
from fitgrid.models.kernel import rbf_features, rbf_kernel
from fitgrid.models.kmeans import Centres, assign_cluster, fit_kmeans_best_of, lloyd, nearest_centres
from fitgrid.models.linear import LinearModel, fit_ols
from fitgrid.models.svm import LinearMachine
from fitgrid.plans import evaluation
from fitgrid.plans.sums import partition_sums, rows_as_matrix
from fitgrid.sources.blobs import make_blobs


def test_ols_recovers_the_line(spark):
    df = spark.range(500).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")
    ).withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 7)
    model = fit_ols(df, ["a", "b"], "y")
    assert model.coefficients == pytest.approx((3, -2)) and model.intercept == pytest.approx(7)
    assert model.transform(df).filter(F.abs(F.col("prediction") - F.col("y")) > 1e-9).count() == 0


def test_wide_ols_uses_the_same_answer(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 45))
    y = x @ np.arange(45) + 2
    names = [f"x{i}" for i in range(45)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "y"])
    assert fit_ols(df, names, "y").coefficients == pytest.approx(tuple(range(45)), abs=1e-6)


def test_regression_of_characters_on_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "n_chars", F.size(F.split("text", r"\s+")).alias("words")
    )
    model = fit_ols(docs, ["words"], "n_chars")
    from fitgrid.operators.metrics import r2

    assert r2(model.transform(docs), "n_chars", "prediction").first()[0] > 0.8


def svm_objective(w, x, y, cost):
    slack = np.maximum(0, 1 - y * (x @ w))
    return 0.5 * w @ w + cost * (slack**2).sum()


@pytest.mark.parametrize("cost", [0.1, 1.0, 50.0])
def test_linear_machine_reaches_the_minimum(spark, cost):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.7, size=400) > 0.3).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, label double")
    w = LinearMachine(cost=cost).fit(df.repartition(5)).weights[0]
    full, sign = np.hstack([x, np.ones((400, 1))]), 2 * y - 1
    slack = 1 - sign * (full @ w)
    slope = w - 2 * cost * full[slack > 0].T @ (sign * slack)[slack > 0]
    assert np.linalg.norm(slope) < 1e-3
    here = svm_objective(w, full, sign, cost)
    assert all(here <= svm_objective(w + rng.normal(scale=0.05, size=4), full, sign, cost) for _ in range(200))


def test_partition_sums_in_two_levels(spark):
    df = spark.range(1000, numPartitions=40).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    got = partition_sums(df, lambda batch: rows_as_matrix(batch.column("x")).sum(axis=0), 40)
    assert list(got) == [499500.0, 1000.0]


def test_many_classes_and_hard_votes(spark):
    df = make_blobs(spark, 300, 4, 3).select("features", F.col("cluster").cast("double").alias("label"))
    model = linear_svc(classes=4, cost=10.0).fit(df)
    margin = evaluation.quality(model.transform(df))
    hard = evaluation.quality(model.with_vote("hard").transform(df))
    assert margin[1] > 0.9 and hard[1] <= margin[1]
    assert model.weights.shape == (4, 4)


def test_plain_hinge_agrees_on_blobs(spark):
    from pyspark.ml.functions import array_to_vector

    df = make_blobs(spark, 60, 2, 3).select(array_to_vector("features").alias("features"), F.col("cluster").cast("double").alias("label"))
    assert evaluation.quality(linear_svc_hinge(max_iter=10).fit(df.coalesce(1)).transform(df))[1] == 1.0


def test_random_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * 0.7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    errors = []
    for n in (100, 2000):
        z = np.array([r["rbf"] for r in rbf_features(df, "x", 0.5, n).orderBy("id").collect()])
        errors.append(np.abs(z @ z.T - exact).mean())
    assert errors[1] < 0.03 and errors[1] < errors[0]
    landmarks = [(i, r.tolist()) for i, r in enumerate(x[:5])]
    rows = rbf_kernel(df, "x", landmarks, 0.5, ["id"]).collect()
    assert len(rows) == 300
    assert all(r["kernel"] == pytest.approx(exact[r["id"], r["landmark"]]) for r in rows)


def test_kernel_machine_separates_rings(spark):
    rng = np.random.default_rng(4)
    angle, ring = rng.uniform(0, 2 * np.pi, 400), rng.integers(0, 2, 400)
    radius = np.where(ring == 1, 2.5, 0.8) + rng.normal(scale=0.1, size=400)
    rows = [([float(r * np.cos(a)), float(r * np.sin(a))], float(c)) for r, a, c in zip(radius, angle, ring)]
    df = spark.createDataFrame(rows, "scaled array<double>, label double")
    kernel = REGISTRY["SVC"].build(2, 2, 42, "scaled", "label").fit(df).transform(df)
    flat = LinearMachine("scaled").fit(df).transform(df)
    assert evaluation.quality(kernel)[1] > 0.98 and evaluation.quality(flat)[1] < 0.8


def test_nearest_centre_ties_go_to_the_lowest(frame):
    df = frame([(1, [0.0])], "id int, x array<double>")
    row = assign_cluster(df, "x", Centres.of([[1.0], [-1.0]])).first()
    assert (row["cluster"], row["cost"]) == (0, 1.0)


def test_lloyd_matches_numpy_and_keeps_empty_centres(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3))
    start = [*x[:3].tolist(), [99.0, 99.0, 99.0]]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(4)
    got = np.array(lloyd(df, "x", Centres.of(start), 4).points)
    centres = np.array(start)
    for _ in range(4):
        near = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(4)])
    assert got == pytest.approx(centres)


def test_best_of_keeps_the_cheapest_start(spark):
    best = fit_kmeans_best_of(make_blobs(spark, 200, 4, 3), "features", 4, seeds=range(4))
    assert best.cost == min(best.costs.values()) and len(best.costs) == 4
    near = assign_cluster(make_blobs(spark, 200, 4, 3), "features", best.centres)
    assert near.agg(F.sum("cost")).first()[0] == pytest.approx(best.cost)
    assert near.select("cluster").distinct().count() == 4


def test_starts_are_drawn_among_all_rows(spark):
    """Ten rows far away among 60,000 are found by every start."""
    rng = np.random.default_rng(3)
    near = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(60_000, 2)))]
    far = [(60_000 + i, [1e4 + float(a), 1e4]) for i, a in enumerate(rng.normal(size=10))]
    best = fit_kmeans_best_of(spark.createDataFrame(near + far, "id bigint, x array<double>"), "x", 3, key="id")
    assert max(best.costs.values()) < 2e5


def test_a_repeated_point_does_not_fill_the_starts(spark):
    rng = np.random.default_rng(4)
    rows = [[0.0, 0.0]] * 6000
    for centre in (40.0, 80.0, 120.0):
        rows += (rng.normal(size=(3000, 2)) + centre).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, x array<double>")
    best = fit_kmeans_best_of(df, "x", 4, key="id")
    assert best.cost < 20_000


def test_starts_where_all_rows_are_equal(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id bigint, x array<double>")
    assert fit_kmeans_best_of(df, "x", 3, seeds=(0, 1), key="id").cost == 0.0


def test_nearest_centre_is_exact_on_ties_and_large_offsets():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 4, (500, 3)) + 1e6
    centres = np.concatenate([points[:20], points[:5]])
    best, cost = nearest_centres(points, centres)
    far = np.square(points[:, None] - centres[None]).sum(-1)
    assert (best == far.argmin(1)).all() and (cost == far.min(1)).all()


@pytest.mark.parametrize("most", [40, 1])
def test_least_squares_over_complete_rows_on_both_paths(spark, most):
    rows = [(float(i), float(i * i % 17), 3.0 * i + (i * i % 17) + 1.0) for i in range(50)]
    rows += [(None, 5.0, 1e6), (5.0, None, 1e6), (7.0, 1.0, None)]
    model = fit_ols(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", most)
    assert (*model.coefficients, model.intercept) == pytest.approx((3.0, 1.0, 1.0))
    twice = spark.createDataFrame([(float(i), 3.0 * i, 2.0 * i) for i in range(9)], "a double, b double, y double")
    assert fit_ols(twice, ["a", "b"], "y", most).coefficients == pytest.approx((0.2, 0.6))


def test_ten_starts_find_the_blobs(spark):
    points = make_blobs(spark, 800, 8, 6)
    best = fit_kmeans_best_of(points, "features", 8)
    near = assign_cluster(points.withColumnRenamed("cluster", "truth"), "features", best.centres)
    pairs = near.groupBy("truth", "cluster").count().collect()
    assert len(pairs) == 8 and all(r["count"] == 100 for r in pairs)


@pytest.mark.parametrize("rows_per_range", [10, 1_000_000])
def test_gini_split_against_brute_force(spark, rows_per_range):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 60, 500), rng.integers(0, 3, 500)
    y = np.where(x > 37, 2, y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")

    def gini(labels):
        share = np.bincount(labels, minlength=3) / len(labels)
        return 1 - (share**2).sum()

    scores = {
        t: ((x <= t).sum() * gini(y[x <= t]) + (x > t).sum() * gini(y[x > t])) / 500 for t in np.unique(x)[:-1]
    }
    best = min(scores, key=lambda t: (round(scores[t], 12), t))
    row = gini_root_split(df, ["x"], "y", rows_per_range).first()
    assert row["threshold"] == best and row["impurity"] == pytest.approx(scores[best])
    assert row["n_left"] == (x <= best).sum() and row["n_right"] == (x > best).sum()


def test_models_beat_the_majority_on_document_quality(spark):
    docs = quality_table(spark, "/root/testdata/sf0.01")
    rows = {r["algorithm"]: r for r in evaluation.model_matrix(docs, "doc_id", QUALITY_FEATURES, "label").collect()}
    assert set(rows) == set(REGISTRY)
    for name, row in rows.items():
        assert row["balanced_accuracy"] > 0.8, name
        assert (row["n_train"], row["n_test"]) == (319, 80)


def test_languages_are_told_apart(spark):
    data = language_table(spark, "/root/testdata/sf0.01")
    only = {"LinearSVC": REGISTRY["LinearSVC"]}
    row = evaluation.model_matrix(data, "doc_id", LANGUAGE_FEATURES, "label", only).first()
    assert row["balanced_accuracy"] > 0.9 and row["n_test"] == 200


def test_repeated_runs_drop_the_warmup(spark, sf):
    docs = quality_table(spark, sf)
    spec = REGISTRY["LinearSVC"]
    runs = evaluation.run_results(docs, "doc_id", QUALITY_FEATURES, "label", spec, [0, 1, 2])
    assert sorted(r["run"] for r in runs.collect()) == [0, 1, 2]
    row = evaluation.repeated_runs(docs, "doc_id", QUALITY_FEATURES, "label", spec, [0, 1, 2], warmup=1).first()
    assert row["count"] == 2


def test_fixed_model_expression(frame):
    df = frame([(2.0, 3)], "a double, b int")
    assert LinearModel(("a", "b"), (10.0, 1.0), 0.5).transform(df).first()["prediction"] == 23.5
