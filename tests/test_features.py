from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fitgrid.operators.encode import encode_first_seen, encode_target, fit_first_seen
from fitgrid.operators.features import (
    assemble,
    class_values,
    drop_warmup,
    feature_set_for,
    fit_scaler,
    keep_members,
    lookup,
    ovr_targets,
    split_xy,
)
from fitgrid.plans import joins


def test_split_xy(frame):
    df = frame([(1, 2.0, "a")], "k int, x double, y string")
    x, y = split_xy(df, key=["k"])
    assert x.columns == ["k", "x"] and y.columns == ["k", "y"]


def test_scaler_is_population_and_guards_constants(frame):
    df = frame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = fit_scaler(df, ["a", "c"]).transform(df).orderBy("a").collect()
    assert out[0]["a"] == pytest.approx(-1.2247448) and out[2]["a"] == pytest.approx(1.2247448)
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]


def test_scaler_uses_train_statistics_only(frame):
    train, test = frame([(0.0,), (2.0,)], "a double"), frame([(5.0,)], "a double")
    assert fit_scaler(train, ["a"]).transform(test).first()[0] == 4.0


def test_first_seen_codes(frame):
    df = frame([(1, "b"), (2, "a"), (3, "b"), (4, "c")], "k int, v string")
    got = {r["k"]: r["v_code"] for r in encode_first_seen(df, ["v"], "k").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


def test_first_seen_follows_the_order_column_not_the_file(frame):
    df = frame([(4, "c"), (3, "b"), (2, "a"), (1, "b")], "k int, v string").repartition(3)
    got = {r["k"]: r["label"] for r in encode_target(df, "v", "k").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 2}


def test_large_dictionary_gives_the_same_codes(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 701)).alias("v"))
    small = encode_first_seen(df, ["v"], "id").orderBy("id").collect()
    large = encode_first_seen(df, ["v"], "id", small_rows=10).orderBy("id").collect()
    assert small == large


def test_dictionary_has_one_code_per_value_and_column(frame):
    df = frame([(1, "x", "x"), (2, "y", None)], "k int, a string, b string")
    rows = {(r["column"], r["value"]): r["code"] for r in fit_first_seen(df, ["a", "b"], "k").collect()}
    assert rows == {("a", "x"): 0, ("a", "y"): 1, ("b", "x"): 0}


def test_assemble_puts_numeric_first(frame):
    df = frame([(7, 1.5, 2)], "code int, x double, n int")
    assert assemble(df, ["x", "n"], ["code"]).first()["features"] == [1.5, 2.0, 7.0]


def test_ovr_targets_has_every_class_for_every_row(frame):
    df = frame([(1, 2), (2, 5), (3, None)], "k int, y int")
    got = {(r["k"], r["cls"]): r["y"] for r in ovr_targets(df, "y", keep=["k"]).collect()}
    assert got == {(1, 2): 1, (1, 5): 0, (2, 2): 0, (2, 5): 1, (3, 2): 0, (3, 5): 0}


def test_class_values_refuses_keys(spark):
    with pytest.raises(ValueError):
        class_values(spark.range(1000), "id", max_classes=20)


def test_lookup_default_and_pass_through(frame):
    df = frame([("SVC",), ("New",)], "model string")
    assert [r[1] for r in lookup(df, "model", {"SVC": "SVM"}, "n").collect()] == ["SVM", "New"]
    assert [r[1] for r in lookup(df, "model", {"SVC": "SVM"}, "n", "Other").collect()] == ["SVM", "Other"]
    table = frame([("SVC", "SVM")], "key string, value string")
    assert sorted(r["n"] for r in lookup(df, "model", table, "n").collect()) == ["New", "SVM"]


def test_membership_and_warmup(frame):
    df = frame([(0, "a"), (1, "b"), (2, "a")], "run int, v string")
    kept = keep_members(df, "v", frame([("a",), ("a",), ("z",)], "m string"))
    assert sorted(r["run"] for r in kept.collect()) == [0, 2]
    assert sorted(r["run"] for r in drop_warmup(df, "run", 1).collect()) == [1, 2]


def test_feature_choice():
    assert feature_set_for("MLPClassifier") == "scaled" and feature_set_for("RandomForestClassifier") == "raw"


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_skewed_lookup_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = left.join(right, "k", how).orderBy("id").collect()
    split = joins.lookup_join(left, right, "k", how, max_rows=10)
    assert split.orderBy("id").collect() == plain
    assert joins.heavy_keys(left, "k", 0.1) == [7]


def test_broadcast_is_measured(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert joins.fits_broadcast(wide) and not joins.fits_broadcast(wide, max_bytes=5000)
    assert not joins.fits_broadcast(wide, max_rows=5)
