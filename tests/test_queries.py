from __future__ import annotations

import math
import re

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# the training-data operators have tests of their own
ELSEWHERE = {n for n in driver.queries() if n == "pipeline" or re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def ordered(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - ELSEWHERE))
def test_query_equals_sql(spark, duck, sf, name):
    df = driver.queries()[name](spark, sf)
    result = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert repr(ordered(df.collect(), df.columns)) == repr(ordered(result.fetchall(), names))


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql()) - ELSEWHERE))
def test_query_gives_rows(spark, sf, name):
    assert driver.queries()[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r["name"] for r in rows} == {"SVM (Linear)", "Decision Tree"}
    assert all(r["runs"] == 2 and r["balanced_accuracy_mean"] > 0.6 for r in rows)
