from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fitgrid.functions.scalars import to_double
from fitgrid.models.linear import LinearModel
from fitgrid.session import materialise, scratch_path, scratch_root
from fitgrid.sources import schemas
from fitgrid.sources.blobs import blob_centres, blobs, make_blobs
from fitgrid.sources.results import flatten_report, read_results, write_result_arrays, write_results
from fitgrid.sources.tables import read_labelled_csv, stream_parquet, write_csv
from fitgrid.streaming import score_stream


def test_iris_style_csv(spark, tmp_path):
    path = tmp_path / "iris.csv"
    path.write_text('"sepal.length","sepal.width","petal.length","petal.width","variety"\n5.1,3.5,1.4,.2,"Setosa"\n6,3,4,1.5,"Versicolor"\n')
    table = read_labelled_csv(spark, str(path), schemas.IRIS)
    assert table.target == "variety" and table.frame.columns[0] == "sepal_length"
    assert [tuple(r) for r in table.frame.collect()] == [(5.1, 3.5, 1.4, 0.2, "Setosa"), (6.0, 3.0, 4.0, 1.5, "Versicolor")]


def test_bank_style_semicolons(spark, tmp_path):
    names = [f.name for f in schemas.BANK]
    values = ["56", '"a;b"', *["unknown"] * 8, "261", "1", "999", "x", "nonexistent", "1.1", "93.9", "-36.4", "4.8", "5191", "no"]
    path = tmp_path / "bank.csv"
    path.write_text(";".join(names) + "\n" + ";".join(values) + "\n")
    table = read_labelled_csv(spark, str(path), schemas.BANK, ";")
    row = table.frame.first()
    assert table.target == "y" and row["job"] == "a;b" and row["marital"] == "unknown"
    numbers = table.frame.select(*[to_double(c) for c in schemas.BANK_NUMERIC]).first()
    assert tuple(numbers) == (56.0, 261.0, 1.0, 999.0, 0.0, 1.1, 93.9, -36.4, 4.8, 5191.0)
    assert len(schemas.BANK_NUMERIC) + len(schemas.BANK_CATEGORICAL) == 20


def test_schema_widths():
    widths = {"IRIS": 5, "BANK": 21, "COVERTYPE": 55, "HOUSING": 9, "DIGITS": 65}
    assert {n: len(getattr(schemas, n)) for n in widths} == widths


def test_csv_round_trip_with_quotes(spark, frame):
    df = frame([(1, 'say "hi"; now', None), (2, "a,b\tc", 1.5)], "k int, s string, v double")
    path = scratch_path(spark, "test-csv")
    write_csv(df, path, ";")
    assert sorted(map(tuple, read_labelled_csv(spark, path, df.schema, ";").frame.collect())) == sorted(map(tuple, df.collect()))


def test_array_documents_hold_every_record_once(spark):
    df = spark.range(250).select(F.col("id").alias("k"), F.col("id").cast("string").alias("s"))
    path = scratch_path(spark, "test-array")
    write_result_arrays(df, path, "k", 40)
    back = read_results(spark, path, lines=False, schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_pretty_report_with_missing_keys(spark, tmp_path):
    for i, extra in enumerate(({"classes": 10}, {"clusters": 8})):
        report = {"language": "python", "algorithm": f"a{i}", "timestamp": 1.5, "system_info": {"cpu_count": 12, "total_memory_mb": 1.0}}
        report["benchmark_results"] = {"model_accuracy": 0.9, "metric_type": "accuracy", **extra}
        (tmp_path / f"{i}.json").write_text(json.dumps(report, indent=4))
    flat = flatten_report(read_results(spark, str(tmp_path), lines=False, schema=schemas.SUITE_REPORT), "benchmark_results")
    rows = {r["algorithm"]: (r["classes"], r["clusters"], r["model_accuracy"]) for r in flat.collect()}
    assert rows == {"a0": (10, None, 0.9), "a1": (None, 8, 0.9)}


def test_result_lines(spark, frame):
    df = frame([("lib", "SVC", 1.0, 2.0, 0.9, -1.27)], schemas.RESULT)
    path = scratch_path(spark, "test-lines")
    write_results(df, path)
    back = read_results(spark, path, schema=schemas.RESULT_WITH_RESOURCES).first()
    assert back["memory_usage_mb"] == -1.27 and back["peak_memory_mb"] is None


def test_blobs_depend_on_the_seed_only(spark):
    one = make_blobs(spark, 500, 5, 3, seed=1)
    two = blobs(spark.range(500).repartition(9), "id", 5, 3, seed=1)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert one.first() != make_blobs(spark, 500, 5, 3, seed=2).first()


def test_blobs_are_normal_around_their_centres(spark):
    centres = blob_centres(2, 3, 42)
    df = make_blobs(spark, 6000, 2, 3)
    for c in range(2):
        stats = df.filter(F.col("cluster") == c).agg(
            *[F.avg(F.col("features")[j]) for j in range(3)], *[F.stddev_pop(F.col("features")[j]) for j in range(3)],
            F.corr(F.col("features")[0], F.col("features")[1]),
        ).first()
        assert list(stats)[:3] == pytest.approx(centres[c], abs=0.08)
        assert list(stats)[3:6] == pytest.approx([1, 1, 1], abs=0.05)
        assert abs(stats[6]) < 0.06


def test_stream_scores_every_row_once(spark, sf):
    path = f"{sf}/lineitem.parquet"
    whole = spark.read.parquet(path)
    model = LinearModel(("l_quantity",), (2.0,), 1.0)
    out, log = scratch_path(spark, "test-scored"), scratch_path(spark, "test-log")
    stream = stream_parquet(spark, path, whole.schema).select("l_orderkey", "l_quantity")
    score_stream(stream, model, out, log).awaitTermination()
    score_stream(stream, model, out, log).awaitTermination()
    back = spark.read.parquet(out)
    want = model.transform(whole.select("l_orderkey", "l_quantity"))
    assert back.exceptAll(want).count() == 0 and back.count() == want.count() == whole.count()


def test_stream_reads_a_folder(spark):
    path = scratch_path(spark, "test-folder")
    spark.range(30).repartition(3).write.parquet(path)
    out, log = scratch_path(spark, "test-scored"), scratch_path(spark, "test-log")
    stream = stream_parquet(spark, path, spark.read.parquet(path).schema)
    score_stream(stream, LinearModel(("id",), (1.0,), 0.0), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 30


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert scratch_root(spark) == shared.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(5).withColumn("v", F.lit("a"))
    back = materialise(df, "test-table")
    assert back.schema.names == df.schema.names and back.count() == 5
