from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fitgrid.models.classify import REGISTRY
from fitgrid.plans import suite
from fitgrid.sources.blobs import make_blobs


@pytest.fixture(scope="module")
def labelled(spark):
    """A table in the shape of a read CSV: numbers as text, categories, a yes/no target."""
    return spark.range(400).select(
        F.col("id"),
        F.concat((F.col("id") * 7 % 100).cast("string"), F.lit(".5")).alias("age"),
        F.when(F.col("id") % 9 == 0, "n/a").otherwise((F.col("id") % 13).cast("string")).alias("calls"),
        F.element_at(F.array(F.lit("unknown"), F.lit("admin"), F.lit("retired")), (F.col("id") % 3 + 1).cast("int")).alias("job"),
        F.when(F.col("id") * 7 % 100 > 60, "yes").otherwise("no").alias("y"),
    )


def test_numeric_table(labelled):
    table, features = suite.numeric_table(labelled, "id", ["age", "calls"], ["job"], "y")
    rows = {r["id"]: r for r in table.collect()}
    assert features == ["age", "calls", "job_code"] and len(rows) == 400
    assert tuple(rows[0])[1:] == (0.5, 0.0, 0.0, 0) and rows[9]["calls"] == 0.0
    assert (rows[1]["job_code"], rows[2]["job_code"], rows[9]["label"]) == (1.0, 2.0, 1)


def test_records_and_report(labelled):
    models = {n: REGISTRY[n] for n in ("LinearSVC", "DecisionTreeClassifier")}
    table, features = suite.numeric_table(labelled, "id", ["age", "calls"], ["job"], "y")
    records = suite.result_records(table, "id", features, models=models, runs=2, warmup=1)
    rows = records.collect()
    assert len(rows) == 4 and all(r["accuracy"] > 0.9 and r["train_time_sec"] > 0 for r in rows)
    other = labelled.sparkSession.createDataFrame(
        [("other", "SVC", 1.0, 1.0, 0.5, 3.0, 10.0, 20.0)], "library string, model string, train_time_sec double, "
        "inference_time_sec double, accuracy double, memory_usage_mb double, cpu_usage_percent double, peak_memory_mb double",
    )
    profile = suite.dataset_profile(labelled.drop("id"), "y")
    lines = [r["line"] for r in suite.benchmark_report(profile, "calls", records, other).collect()]
    assert "- **Classes**: 2" in lines and "## Tree-Based Models" in lines
    assert any(line.startswith("| other | SVM | 1.000000±nan") and line.endswith("| 10.00 | 20.00 |") for line in lines)
    assert any(line.startswith("| fitgrid | Decision Tree |") and line.endswith("| nan | nan | nan |") for line in lines)


def test_regression_run(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10).withColumn("y", F.col("x") * 2.0 + F.col("id") % 3)
    row = suite.run_regression(df, "id", ["x"], "y").first()
    assert (row["training_samples"], row["test_samples"], row["features"]) == (800, 200, 1)
    assert row["metric_type"] == "r2_score" and row["model_accuracy"] > 0.95 and row["classes"] is None


def test_svm_run(spark):
    points = make_blobs(spark, 400, 3, 4)
    df = points.select("id", *[F.col("features")[j].alias(f"f{j}") for j in range(4)], F.col("cluster").alias("label"))
    row = suite.run_svm(df, "id", [f"f{j}" for j in range(4)], "label").first()
    assert row["classes"] == 3 and row["test_samples"] == 80 and row["model_accuracy"] > 0.9


@pytest.mark.parametrize("exact", [False, True])
def test_kmeans_run(spark, exact):
    row = suite.run_kmeans(make_blobs(spark, 240, 4, 5), "id", "features", k=4, starts=3, exact=exact).first()
    assert (row["training_samples"], row["features"], row["clusters"]) == (240, 5, 4)
    assert row["model_accuracy"] > 0.5
