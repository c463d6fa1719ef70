from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from fitgrid.session import materialise

from .test_lines import slow as slow_lines
from .test_near_copies import slow_first


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = docs, materialise(stage(spark, docs, sf), name)
        docs = found[name][1]
    return found


def test_stages_keep_the_columns(outputs):
    for name, (before, after) in outputs.items():
        if name != "packing":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_and_quality_drop_rows_only(outputs, spark, sf):
    for name in ("language", "quality"):
        before, after = ({r["doc_id"]: r for r in df.collect()} for df in outputs[name])
        assert set(after) <= set(before) and all(after[k] == before[k] for k in after)
    bad = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
    assert not bad & set(after)
    assert len(outputs["language"][1].collect()) >= 0.99 * outputs["language"][0].count()


def test_lines_against_brute_force(outputs):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in outputs["line_dedup"])
    gone = slow_lines([(k, r["text"]) for k, r in before.items()], 50)
    for key, row in before.items():
        text = "\n".join(x for i, x in enumerate(row["text"].split("\n")) if i not in gone.get(key, ()))
        if key not in after:
            assert gone[key] and not text.strip()
        else:
            assert after[key]["text"] == text and after[key]["n_chars"] == len(text)


def test_one_of_each_group_against_brute_force(outputs):
    before, after = (sorted((r["doc_id"], r["text"]) for r in df.collect()) for df in outputs["near_copies"])
    assert after == [before[i] for i in slow_first([text for _, text in before])]


def test_packing_places_all_that_is_left(outputs):
    docs, pieces = outputs["packing"]
    places = defaultdict(list)
    for r in pieces.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_hard_documents_go_through(spark, sf, hard_docs):
    docs = hard_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_empty_table_goes_through(spark, sf, empty_docs):
    docs = empty_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
    assert docs.count() == 0
