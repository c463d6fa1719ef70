from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.operators import stats
from fitgrid.operators.ranking import champions, first_n


def test_single_run_deviation_rules(frame):
    df = frame([("a", 2.0)], "k string, v double")
    assert stats.group_stats(df, ["k"], ["v"]).first()["v_std"] is None
    assert stats.sample_stats(df, ["k"], "v").first()["std_dev"] == 0.0
    assert stats.sample_stats(df, ["k"], "v", single="null").first()["std_dev"] is None


def test_no_samples_give_zeros(frame):
    row = stats.sample_stats(frame([], "v double"), [], "v").first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 0)


def test_sample_and_population_deviation(frame):
    df = frame([(1.0,), (2.0,), (4.0,)], "v double")
    assert stats.sample_stats(df, [], "v").first()["std_dev"] == pytest.approx(statistics.stdev([1, 2, 4]))
    assert stats.sample_stats(df, [], "v", ddof=0).first()["std_dev"] == pytest.approx(statistics.pstdev([1, 2, 4]))


def test_optional_metrics_only_if_present(frame):
    df = frame([("a", 1.0, 2.0)], "k string, v double, w double")
    out = stats.group_stats(df, ["k"], ["v"], ("mean",), optional=["w", "missing"])
    assert out.columns == ["k", "v_mean", "w_mean"]


def test_percentiles_are_interpolated(frame):
    df = frame([(float(i),) for i in range(1, 11)], "v double")
    row = stats.latency_summary(df, [], "v").first()
    assert (row["mean"], row["p50"]) == (5.5, 5.5)
    assert row["p90"] == pytest.approx(9.1) and row["p99"] == pytest.approx(9.91)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_by_range_equal_the_built_in(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([5.0, rng.gauss(0, 10), rng.expovariate(1)])) for _ in range(2000)]
    rows += [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    built_in = stats.latency_summary(df, keys, "v", qs).collect()
    by_range = stats.latency_summary(df, keys, "v", qs, group_rows=100).collect()
    index = {tuple(r[k] for k in keys): r for r in by_range}
    for row in built_in:
        if row["mean"] is None:
            continue
        other = index[tuple(row[k] for k in keys)]
        for name in row.asDict():
            if name not in keys:
                assert other[name] == pytest.approx(row[name]), (name, row)


def test_percentiles_of_a_large_group_in_a_narrow_band(spark):
    """One group holds most rows, all close together, among thousands of small ones far apart."""
    large = spark.range(60_000).selectExpr("'large' as k", "500 + (id * 7919 % 60000) / 1e9 as v")
    small = spark.range(9_000).selectExpr("concat('s', id % 3000) as k", "cast(id % 1000 as double) as v")
    df, qs = large.unionByName(small), (0.5, 0.9, 0.99)
    want = {r["k"]: r for r in stats.latency_summary(df, ["k"], "v", qs).collect()}
    found = {r["k"]: r for r in stats.latency_summary(df, ["k"], "v", qs, group_rows=1_000).collect()}
    assert set(found) == set(want) and len(found) == 3001
    for k, row in want.items():
        assert tuple(found[k]) == pytest.approx(tuple(row))
    # the cells that are sorted hold a small part of the large group
    values = df.selectExpr("k as _g", "v as _v").filter("k = 'large'")
    sizes = values.groupBy("_g").agg(F.count("*").alias("_rows"))
    points = stats._percentiles_by_cells(values, sizes, list(qs), ["a", "b", "c"], 40).first()
    assert (points["a"], points["b"], points["c"]) == pytest.approx(tuple(want["large"])[2:])


def test_percentiles_of_equal_values_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 3.0)] * 50 + [("b", None)] * 20 + [("a", 4.0)] * 50 + [(None, 1.0)] * 30, "k string, v double")
    rows = {r["k"]: r for r in stats.latency_summary(df, ["k"], "v", (0.0, 0.5, 1.0), group_rows=10).collect()}
    assert (rows["a"]["p0"], rows["a"]["p50"], rows["a"]["p100"]) == (3.0, 3.5, 4.0)
    assert rows["b"]["mean"] is None and rows[None]["p50"] == 1.0


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(size=777)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = stats.latency_summary(df, [], "v", group_rows=50).first()
    assert [row["p50"], row["p90"], row["p99"]] == pytest.approx(list(np.percentile(values, [50, 90, 99])))


def test_runs_without_samples_report_zero(frame):
    runs = frame([(1,), (2,)], "run int")
    samples = frame([(1, 10.0), (1, 30.0)], "run int, cpu double")
    got = {r["run"]: (r["cpu_mean"], r["cpu_peak"]) for r in stats.mean_peak(samples, runs, "run", ["cpu"]).collect()}
    assert got == {1: (20.0, 30.0), 2: (0.0, 0.0)}


def test_peak_record_keeps_the_whole_row_and_the_baseline(frame):
    rows = [("a", 0, 5.0, 1.0), ("a", 1, 9.0, 2.0), ("a", 2, 9.0, 3.0), ("b", 0, 5.0, 4.0), ("b", 1, 3.0, 5.0)]
    df = frame(rows, "k string, run int, mem double, cpu double")
    got = {r["k"]: tuple(r["peak"]) for r in stats.peak_record(df, ["k"], "mem", ["mem", "cpu"], ["run"]).collect()}
    assert got == {"a": (9.0, 2.0), "b": (5.0, 4.0)}


def test_union_fills_missing_fields(frame):
    whole = stats.append_results(frame([(1, 2)], "a int, b int"), frame([(3, 4, 5)], "a int, b int, c int"))
    assert sorted((tuple(r) for r in whole.collect()), key=str) == [(1, 2, None), (3, 4, 5)]


def test_throughput_of_no_time_is_null(frame):
    df = frame([("a", 2.0), ("a", 2.0), ("b", 0.0)], "k string, s double")
    assert {r["k"]: r["samples_per_sec"] for r in stats.throughput(df, ["k"], "s").collect()} == {"a": 0.5, "b": None}


def test_profile(frame):
    row = stats.dataset_profile(frame([(1, "x"), (2, "y"), (3, "x")], "a int, t string")).first()
    assert tuple(row) == (3, 1, 2, "small")


def test_champions_break_ties_by_name_and_skip_missing(frame):
    df = frame([("b", 1.0, 0.9), ("a", 1.0, None), ("c", 2.0, 0.95)], "n string, t double, q double")
    got = {r["objective"]: (r["n"], r["value"]) for r in champions(df, {"fast": ("t", "min"), "good": ("q", "max")}, ["n"]).collect()}
    assert got == {"fast": ("a", 1.0), "good": ("c", 0.95)}


def test_first_n(spark):
    assert [r[0] for r in first_n(spark.range(50).repartition(5), ["id"], 3).collect()] == [0, 1, 2]


def test_nested_stats_flatten(frame):
    df = frame([("a", 1.0), ("a", 3.0)], "k string, v double")
    row = stats.flatten_stats(stats.stats_struct(df, ["k"], ["v"])).first()
    assert row.asDict() == {"k": "a", "v_mean": 2.0, "v_std": 1.0, "v_min": 1.0, "v_max": 3.0, "v_n": 2}


def test_results_do_not_depend_on_partitions(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    def summary(n):
        out = stats.group_stats(lines.repartition(n), ["l_returnflag"], ["l_quantity", "l_tax"], digits=6)
        return sorted(map(tuple, out.collect()))
    assert summary(1) == summary(7)


def test_not_a_number_sorts_last_in_both_ways(frame):
    df = frame([(float(i),) for i in range(40)] + [(math.nan,)], "v double").withColumn("k", F.lit("x"))
    for rows in (1000, 10):
        row = stats.latency_summary(df, ["k"], "v", (0.5, 1.0), group_rows=rows).first()
        assert row["p50"] == 20.0 and math.isnan(row["p100"])


def test_objective_without_values_has_no_champion(frame):
    df = frame([("a", 1.0, None), ("b", 2.0, None)], "n string, t double, q double")
    rows = champions(df, {"fast": ("t", "min"), "good": ("q", "max")}, ["n"]).collect()
    assert [(r["objective"], r["n"]) for r in rows] == [("fast", "a")]
    grouped = champions(df, {"good": ("q", "max")}, ["t"], keys=["n"])
    assert grouped.count() == 0
