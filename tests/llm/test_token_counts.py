from __future__ import annotations

import random

import pytest
import tiktoken

from fitgrid.llm import QUERIES, token_counts
from fitgrid.llm.bpe import Ranks
from fitgrid.llm.token_counts import TokenTree

from .conftest import MULTI, PATTERN


@pytest.fixture(scope="module")
def ranks():
    return Ranks(MULTI, PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


@pytest.mark.parametrize("leaf", [64, 2])
def test_random_edits(ranks, library, monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF_WORDS", leaf)
    draw, chars = random.Random(leaf), "ab cd'sre \n\n  ß1!?  ՘"
    for _ in range(400):
        text = "".join(draw.choice(chars) for _ in range(draw.randint(0, draw.choice([5, 60, 600]))))
        tree = TokenTree(text, ranks)
        for _ in range(5):
            start, length = draw.randint(-2, len(text) + 2), draw.randint(-1, draw.choice([0, 3, 30, 300]))
            insert = "".join(draw.choice(chars) for _ in range(draw.choice([0, 1, 6, 40])))
            tree.edit(start, length, insert)
            start, length = min(max(start, 0), len(text)), max(length, 0)
            text = text[:start] + insert + text[start + length :]
            assert tree.text() == text and tree.total == len(library.encode_ordinary(text))


def test_an_edit_costs_few_words(ranks, library):
    text = "some words in a row " * 20_000
    tree = TokenTree(text, ranks)
    tree.edit(200_003, 9, "x y")
    assert tree.reencoded < 12
    assert tree.total == len(library.encode_ordinary(text[:200_003] + "x y" + text[200_012:]))


def test_hard_documents(hard_docs, empty_docs, library):
    docs = token_counts.masking_edits(hard_docs.withColumnRenamed("other", "n_tokens"))
    rows = token_counts.count_edits(docs, MULTI, PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in hard_docs.collect()}
    assert len(rows) == hard_docs.count()
    for r in rows:
        assert r["n_tokens_before"] == len(library.encode_ordinary(texts[r["doc_id"]]))
    assert token_counts.count_edits(token_counts.masking_edits(empty_docs), MULTI, PATTERN).count() == 0


def test_null_edits(spark, library):
    rows = [(1, "a b", None), (2, None, [(0, 5, "new text")]), (3, "one two", [(4, 3, None), None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start:int,length:int,insert:string>>")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_edits(docs, MULTI, PATTERN).collect()}
    assert found == {1: 2, 2: len(library.encode_ordinary("new text")), 3: len(library.encode_ordinary("one "))}


def test_query(spark, sf, library):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op5_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_tokens_before"] == len(library.encode_ordinary(text))
        masked = token_counts.PRIVATE.sub(lambda m: "[mail]" if m.group(1) else "[number]", text)
        assert r["n_tokens"] == len(library.encode_ordinary(masked))
    assert any(r["n_reencoded"] for r in rows)
