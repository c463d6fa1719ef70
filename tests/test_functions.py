from __future__ import annotations

import datetime
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fitgrid.functions import (
    argmax,
    clipped_delta,
    compact_stamp,
    cross_entropy,
    delta,
    dot,
    epoch_seconds,
    eq_target,
    file_stem,
    fmt_mean_std,
    normalise_array,
    size_class,
    squared_distance,
    thousands,
    title_case,
    to_double,
    to_mb,
    vote_first_positive,
)


@pytest.mark.parametrize(
    "text,value",
    [
        ("1.5", 1.5), (" 1.5 ", 0.0), ("1.5d", 0.0), ("abc", 0.0), ("", 0.0), ("1e3", 1000.0), (".2", 0.2), ("5.", 5.0),
        ("+7", 7.0), ("-.5E-1", -0.05), (".", 0.0), ("1e", 0.0), ("inf", math.inf), ("-Infinity", -math.inf), (None, 0.0),
        ("0x10", 0.0), ("1_000", 0.0), ("1,5", 0.0),
    ],
)
def test_lenient_parse(frame, text, value):
    got = frame([(text,)], "s string").select(to_double("s")).first()[0]
    assert got == value


def test_lenient_parse_nan_and_default(frame):
    row = frame([("nan", "x")], "a string, b string").select(to_double("a"), to_double("b", -1.0)).first()
    assert math.isnan(row[0]) and row[1] == -1.0


def test_argmax_first_maximum_wins(frame):
    rows = frame([([1.0, 3.0, 3.0],), ([5.0],), ([-1.0, -2.0],)], "s array<double>").select(argmax("s")).collect()
    assert [r[0] for r in rows] == [1, 0, 0]


def test_vote_rules(frame):
    votes = [([0, 0, 0],), ([0, 1, 0],), ([0, 1, 1],)]
    assert [r[0] for r in frame(votes, "v array<int>").select(vote_first_positive("v")).collect()] == [0, 1, 1]


def test_array_arithmetic(frame):
    row = frame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>").select(
        dot("a", "b"), squared_distance("a", "b"), normalise_array(F.array(F.lit(0), F.lit(255)), 255, 0.5, 0.5)
    ).first()
    assert row[0] == 13.0 and row[1] == 13.0 and row[2] == [-1.0, 1.0]


def test_cross_entropy_is_stable(frame):
    row = frame([([1000.0, 0.0], 0), ([0.0, 0.0], 1)], "s array<double>, y int").select(cross_entropy("s", "y")).collect()
    assert row[0][0] == pytest.approx(0.0) and row[1][0] == pytest.approx(math.log(2))


def test_deltas_and_units(frame):
    row = frame([(5.0, 3.0)], "b double, a double").select(
        delta(F.col("a"), F.col("b")), clipped_delta(F.col("a"), F.col("b")), to_mb(F.lit(1048576))
    ).first()
    assert tuple(row) == (-2.0, 0.0, 1.0)


def test_targets_and_size(frame):
    df = frame([("yes", 999), ("no", 1000), (None, 1)], "y string, n int")
    assert [r[0] for r in df.select(eq_target("y", "yes")).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(size_class(F.col("n"))).collect()] == ["small", "large", "small"]


def test_text_formats(frame):
    ts = datetime.datetime(2025, 7, 27, 19, 9, 10)
    row = frame([(ts,)], "ts timestamp_ntz").select(
        compact_stamp(F.col("ts")), epoch_seconds(F.col("ts")), thousands(F.lit(1234567)),
        title_case(F.lit("bank-additional_full 2x")), file_stem(F.lit("a/b/archive.tar.gz")), file_stem(F.lit(".bashrc")),
    ).first()
    assert row[0] == "20250727_190910" and row[1] == 1753643350 and row[2] == "1,234,567"
    assert row[3] == "Bank-Additional_Full 2X" and row[4] == "archive.tar" and row[5] == ".bashrc"


def test_missing_deviation_prints_nan(frame):
    df = frame([(1.25, None), (248.755, 0.125)], "m double, s double")
    got = [r[0] for r in df.select(fmt_mean_std(F.col("m"), F.col("s"), 2)).collect()]
    assert got == ["1.25±nan", f"{248.755:.2f}±{0.125:.2f}"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_fixed_decimals_match_c_printf(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fmt_mean_std(F.col("v"), F.lit(None).cast("double"), 4)).collect()]
    assert got == [f"{v:.4f}±nan" for v in values]
