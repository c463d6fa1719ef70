from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from fitgrid.llm import QUERIES, simhash
from fitgrid.llm.components import components

from .conftest import HARD


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, ids, radius=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, key in enumerate(ids):
        groups.setdefault(find(i), []).append(key)
    return {i: min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(values))}


@pytest.mark.parametrize("text", [t for t in HARD if t is None or len(t) < 1000] + ["A b C d E f " * 30, "one two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def signed(value):
    return value - 2**64 if value >> 63 else value


def crowd(seed, number):
    """Chains and clusters of fingerprints a few bits apart, beside lone ones."""
    draw = random.Random(seed)
    values = {0, 2**64 - 1}
    while len(values) < number:
        at = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 5, 40])):
            values.add(at)
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                at ^= 1 << bit
    return sorted(values)


@pytest.mark.parametrize("cell_rows", [16_384, 8])
def test_links_find_all_components(spark, cell_rows):
    values = crowd(3, 700)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.links(prints, "fp", 4, cell_rows)).collect()}
    want = slow_components(values, [signed(v) for v in values])
    assert {signed(v): roots.get(signed(v), signed(v)) for v in values} == {signed(v): want[i] for i, v in enumerate(values)}


def test_forest_of_a_dense_group_is_small():
    base = random.Random(5).getrandbits(60)
    near = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}), dtype=np.int64)
    ones = np.bitwise_count(near.view(np.uint64))
    order = np.argsort(ones, kind="stable")
    found = simhash._forest(np.zeros(len(near), dtype=np.int64), ones[order], near[order], 4)
    assert found.num_rows == len(near) - 1


def test_path_of_many_links(spark):
    rows = components(spark.range(300).selectExpr("id as a", "id + 1 as b")).collect()
    assert len(rows) == 301 and {r["root"] for r in rows} == {0}


def test_hard_documents(hard_docs):
    found = simhash.near_duplicates(hard_docs)
    rows, docs = found.collect(), hard_docs.collect()
    assert len(rows) == len(docs)
    values = [slow_fingerprint(d["text"]) for d in docs]
    want = slow_components(values, [d["doc_id"] for d in docs])
    assert sorted((repr(d["doc_id"]), signed(values[i]), want[i]) for i, d in enumerate(docs)) == sorted(
        (repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows
    )


def test_one_document_of_each_group_stays(hard_docs):
    kept = simhash.one_per_group(hard_docs).collect()
    assert kept[0].asDict().keys() == hard_docs.first().asDict().keys()
    texts = [k["text"] for k in kept]
    assert texts.count("the same text twice") == 1
    assert sorted(k["doc_id"] for k in kept) == [0, 4, 5, 6, 7, 8, 10]


def test_rows_without_a_key(make_docs):
    docs = make_docs(["one two three four five six"] * 3 + ["quite another text that has nothing in common"])
    docs = docs.selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:])
    assert simhash.one_per_group(docs).count() == 2


def test_clashing_columns_and_empty_table(make_docs, empty_docs):
    docs = make_docs(["a b c d", "a b c d"], component_id="x")
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == [0, 0]
    assert simhash.near_duplicates(empty_docs).count() == 0
    assert simhash.one_per_group(empty_docs).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    values = [slow_fingerprint(d["text"]) for d in docs]
    want = slow_components(values, [d["doc_id"] for d in docs])
    rows = QUERIES["op10_simhash"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted((d["doc_id"], f"{values[i]:016x}", want[i]) for i, d in enumerate(docs))


def test_a_repeated_key_with_several_texts(make_docs):
    docs = make_docs(["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black"])
    docs = docs.unionByName(docs.filter("doc_id = 1").selectExpr("0L as doc_id", *docs.columns[1:]))
    docs = docs.unionByName(docs.filter("doc_id = 2").selectExpr("0L as doc_id", *docs.columns[1:]))
    kept = simhash.one_per_group(docs).collect()
    assert sorted(k["text"][:3] for k in kept) == ["alp", "one", "red"] and {k["doc_id"] for k in kept} == {0}
