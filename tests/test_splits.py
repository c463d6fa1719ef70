from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fitgrid.operators.split import ordered_split, random_split, random_tests
from fitgrid.plans.evaluation import hold_outs
from fitgrid.plans.running import global_rank, running_totals, with_part
from fitgrid.plans.selection import at_or_before, kth_row


@pytest.mark.parametrize("rounding,train", [("floor", 119), ("ceil", 120)])
def test_ordered_sizes(spark, rounding, train):
    df = ordered_split(spark.range(149), ["id"], 0.8, rounding)
    assert df.filter("part = 'train'").count() == train
    assert df.filter("part = 'train'").agg(F.max("id")).first()[0] == train - 1


def test_random_split_is_exact_and_stable(spark):
    df = spark.range(1797)
    one = {r["id"] for r in random_split(df, "id", 0.2, 42).filter("part = 'test'").collect()}
    two = {r["id"] for r in random_split(df.repartition(7), "id", 0.2, 42).filter("part = 'test'").collect()}
    assert len(one) == 360 and one == two
    narrowed = random_split(df, "id", 0.2, 42, sort_below=5).filter("part = 'test'").collect()
    assert {r["id"] for r in narrowed} == one
    other = {r["id"] for r in random_split(df, "id", 0.2, 43).filter("part = 'test'").collect()}
    assert other != one


def test_approximate_split_needs_no_count(spark):
    share = random_split(spark.range(20000), "id", 0.2, exact=False).filter("part = 'test'").count() / 20000
    assert share == pytest.approx(0.2, abs=0.02)


@pytest.mark.parametrize("k", [1, 2, 500, 1999, 2000])
def test_kth_row_by_narrowing(spark, k):
    rng = random.Random(k)
    values = [(rng.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(values, "a int, b int").repartition(5)
    assert kth_row(df, ["a", "b"], k, sort_below=20) == sorted(values)[k - 1]


def bad_guess(floor, ceiling, k, inside):
    """Halves the interval, which says nothing about where the rows are."""
    low, high = floor if floor is not None else -5, ceiling if ceiling is not None else 4000
    return low + (high - low) // 3, low + (high - low) // 2


def test_kth_row_with_one_heavy_value_and_bad_guess(spark):
    values = [(5 if i % 3 else i, i) for i in range(1500)]
    df = spark.createDataFrame(values, "a int, b int")
    for k in (1, 400, 900, 1500):
        assert kth_row(df, ["a", "b"], k, sort_below=10, narrow=bad_guess) == sorted(values)[k - 1]


def test_kth_row_of_timestamps(spark):
    df = spark.range(300).select((F.timestamp_seconds(F.col("id") * 10)).cast("timestamp_ntz").alias("t"), "id")
    border = kth_row(df, ["t", "id"], 100, sort_below=10)
    assert df.filter(at_or_before(df, ["t", "id"], border)).count() == 100


@pytest.mark.parametrize("k", [1, 77, 500, 1000])
def test_text_leads_an_order_of_any_size(spark, k):
    df = spark.range(1000).select((F.col("id") % 300).cast("string").alias("s"), "id")
    want = sorted((str(i % 300), i) for i in range(1000))[k - 1]
    assert kth_row(df, ["s", "id"], k, sort_below=10) == want
    assert kth_row(df, ["s", "id"], k) == want


def test_split_by_text_is_exact_on_the_narrowed_path(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") * 7 % 1000).alias("s"))
    parts = ordered_split(df, ["s"], 0.8, sort_below=20).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 800, "test": 200}


def test_rank_by_text_over_ranges(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("s")).repartition(5)
    got = {r["s"]: r["rank"] for r in global_rank(df, ["s"], rows_per_range=90).collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(str(i) for i in range(1000)))}


def test_null_order_values_are_refused(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 20, F.col("id")).alias("v"), "id")
    with pytest.raises(ValueError, match="20 rows"):
        ordered_split(df, ["v"], 0.8)
    with pytest.raises(ValueError, match="20 rows"):
        random_split(df, "v")


@pytest.mark.parametrize("max_ranges", [1, 3])
def test_large_ranges_are_cut_again(spark, max_ranges):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(2).alias("w")).repartition(6)
    got = running_totals(df, ["v"], {"t": F.col("w")}, rows_per_range=20, max_ranges=max_ranges).collect()
    assert all(r["t"] == 2 * (r["v"] + 1) for r in got) and len(got) == 1000
    assert set(got[0].asDict()) == {"v", "w", "t"}


def test_global_rank_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    got = global_rank(df, ["v"], rows_per_range=90).collect()
    assert all(r["rank"] == r["v"] + 1 for r in got) and len(got) == 1000


def test_running_totals_over_ranges_with_ties_in_the_lead(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, rng.randint(1, 30)]), i, rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b int, m int")
    got = {r["b"]: (r["t"], r["n"]) for r in running_totals(df, ["a", "b"], {"t": F.col("m"), "n": F.lit(1)}, 50).collect()}
    total = 0
    for n, (a, b, m) in enumerate(sorted(rows), 1):
        total += m
        assert got[b] == (total, n)


def test_split_shares_match_rounding(spark):
    for n, ratio in ((10, 0.25), (7, 0.5), (1, 0.8)):
        df = ordered_split(spark.range(n), ["id"], ratio)
        assert df.filter("part = 'train'").count() == math.floor(n * ratio)


@pytest.mark.parametrize("sort_below", [200_000, 20])
def test_splits_of_many_seeds_together(spark, sort_below):
    rows = spark.range(700).selectExpr("concat('k', id % 350) as a", "id as b")
    seeds = [3, 4, 5]
    marked = random_tests(rows, ["a", "b"], 0.3, seeds, sort_below=sort_below).collect()
    for i, seed in enumerate(seeds):
        alone = {(r["a"], r["b"]): r["part"] == "test" for r in random_split(rows, ["a", "b"], 0.3, seed).collect()}
        assert {(r["a"], r["b"]): r[f"_test{i}"] for r in marked} == alone
    same = rows.withColumn("b", F.lit(1)).withColumn("a", F.lit("x"))
    assert random_tests(same, "a", 0.3, [1], sort_below=20).filter("_test0").count() == 700
    assert random_tests(rows.limit(0), "a", 0.3, [1]).count() == 0


def test_three_seeds_read_the_table_as_often_as_one(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    def read(seeds):
        before = reads.value
        rows = spark.range(500).selectExpr("id", "cast(id as double) as x", "cast(id % 2 as int) as label").mapInArrow(seen, "id long, x double, label int")
        with hold_outs(rows, "id", ["x"], "label", 0.2, seeds) as data:
            assert [(d.n_train, d.n_test, d.train.count(), d.test.count()) for d in data] == [(400, 100, 400, 100)] * len(seeds)
        return reads.value - before

    assert read([1]) == read([1, 2, 3]) == 500


@pytest.mark.parametrize("max_ranges", [3, 40])
def test_text_ranges_are_cut_again_and_stay_out_of_the_plan(spark, max_ranges):
    texts = [f"{'prefix' * (i % 3)}ß{i * 7919 % 3000:05d}" + "x" * (i % 50) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(6)
    ranked = running_totals(df, ["s"], {"t": F.lit(1).cast("bigint")}, rows_per_range=30, max_ranges=max_ranges)
    assert "prefixß" not in ranked._jdf.queryExecution().toString()
    assert {r["s"]: r["t"] for r in ranked.collect()} == {s: i + 1 for i, s in enumerate(sorted(texts))}
    part = with_part(df.withColumn("_range", F.lit(0)), F.col("s"), 30, True)
    sizes = [r["count"] for r in part.groupBy("_part").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 600
