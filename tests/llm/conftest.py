from __future__ import annotations

import public_tokenizers
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

# Nulls, empty and blank texts, a very long word, ties and repeated rows.
HARD = [
    None,
    "",
    " ",
    " \t\n\x0b\x0c\r",
    "a",
    "x" * 30_000,
    "word " * 20_000,
    "naïve ß 中文字 😀 don't\n\n  it's 12345 <|endoftext|>",
    "the same text twice",
    "the same text twice",
    "a\x1cb ՘    end",
]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **extra):
        rows = [(i, t, "en", "s", None if t is None else len(t), *[v] * 1) for i, t in enumerate(texts) for v in [*extra.values()] or ["-"]]
        return spark.createDataFrame(rows, DOCS + ", " + (next(iter(extra)) if extra else "other") + " string")

    return make


@pytest.fixture(scope="session")
def hard_docs(make_docs):
    """Hard texts, one row again as it is, and one without an id."""
    docs = make_docs(HARD)
    return docs.unionByName(docs.filter("doc_id = 4")).unionByName(docs.filter("doc_id = 8").selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]))


@pytest.fixture(scope="session")
def empty_docs(make_docs):
    return make_docs(["x"]).limit(0)
