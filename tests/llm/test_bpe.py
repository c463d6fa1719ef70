from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from fitgrid.llm import QUERIES, bpe
from fitgrid.llm.batches import memo

from .conftest import HARD, MULTI, PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(MULTI, PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def ids_of(data):
    return np.frombuffer(bytes(data), "<u4").tolist()


def test_random_texts_as_the_library(ranks, library):
    chars, draw = "ab cdé ß中\n\t 12'sreéñ!?#\x1c՘　😀", random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice(chars) for _ in range(draw.randint(0, 40)))
        assert ids_of(ranks.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "ab" * 40_000, "\n \n  x"])
def test_long_words_as_the_library(ranks, library, text):
    assert ids_of(ranks.encode(text)) == library.encode_ordinary(text)


def test_every_code_point_falls_into_the_same_class(ranks, library):
    for low in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}\n" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        if text:
            assert ids_of(ranks.encode(text)) == library.encode_ordinary(text)


def test_text_over_the_block_limit(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    text = "one two  three\n\nfour don't " * 30
    assert ids_of(ranks.encode_many([text, "short"])[0]) == library.encode_ordinary(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    small = bpe.Ranks(MULTI, PATTERN)
    for i in range(50):
        small.encode(f"word{i} again")
        assert len(small.young) + len(small.old) < 40


def test_round_trip_keeps_rows_and_columns(hard_docs, library):
    docs = hard_docs.withColumnRenamed("other", "IDS")  # clashes with the new column
    rows = bpe.decode(bpe.encode(docs, MULTI, PATTERN), MULTI, PATTERN).collect()
    assert len(rows) == docs.count()
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"}
    for r in rows:
        text = r["text"] or ""
        assert ids_of(r["ids"]) == library.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text


def test_empty_table(empty_docs):
    assert bpe.encode(empty_docs, MULTI, PATTERN).count() == 0


def test_query(spark, sf, library):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_memo_makes_once():
    calls = []
    for _ in range(2):
        memo("test-once", lambda: calls.append(1) or 5)
    assert len(calls) == 1 and HARD
