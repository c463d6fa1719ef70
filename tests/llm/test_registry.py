from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from fitgrid.llm import QUERIES, SQL


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(columns) == sorted(df.columns)
    assert repr(got) == repr(want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", ["op7_sharding", "op9_url_filter", "op13_topk"])
def test_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "line_dedup", "near_copies", "packing"]
