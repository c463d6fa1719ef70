from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from fitgrid.llm import near_copies, simhash


def slow_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_first(texts):
    """Positions of the first text of each group, by comparing all pairs."""
    sets = [slow_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def corpus(seed):
    """Families of texts around the border, passages that unlike texts share, short and empty texts."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    passage, texts = words(12), ["", " \n", None, "one two", "One  two"]
    for n in [3, 6, 12, 30, 80, 200, 400] * 3:
        base = words(n) + passage * (draw.random() < 0.5)
        for _ in range(6):
            near = list(base)
            for _ in range(draw.randint(0, max(1, n // 30))):
                near[draw.randrange(len(near))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(near))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 3])
def test_groups_are_those_of_all_pairs(spark, make_docs, crowd):
    texts = corpus(crowd)
    found = near_copies.one_per_group(make_docs(texts), crowd=crowd)
    assert sorted(r["doc_id"] for r in found.collect()) == slow_first(texts)


def test_stage_finds_copies_with_changed_words(spark, make_docs):
    words = [f"w{i}" for i in range(200)]
    near = [w if i not in (20, 100) else "other" for i, w in enumerate(words)]
    docs = make_docs([" ".join(words), " ".join(near), "quite another text that shares nothing with them"])
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").orderBy("doc_id").collect()] == [0, 2]


def test_fingerprints_put_sets_together(spark):
    sets = spark.createDataFrame([(5, 10, 0), (3, 9, 0), (7, 10, 0b1111), (9, 10, 0b11111 << 40), (2, 8, -1)], "id bigint, n int, fp bigint")
    found = {(r["id"], r["n"], r["id2"], r["n2"]) for r in near_copies.alike(sets).collect()}
    assert {frozenset([(a, n), (b, m)]) for a, n, b, m in found} == {frozenset([(5, 10), (3, 9)]), frozenset([(7, 10), (3, 9)])}


def test_stage_finds_copies_by_fingerprints(spark, make_docs, monkeypatch):
    met, links = [], simhash.links

    def seen(prints, column, radius, cell_rows):
        found = links(prints, column, radius, cell_rows)
        met.extend((r["a"], r["b"]) for r in found.collect())
        return found

    monkeypatch.setattr(simhash, "links", seen)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-3]), "quite another text that shares nothing with them"]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert prints[0] != prints[1] and ((prints[0] ^ prints[1]) & (2**64 - 1)).bit_count() <= simhash.RADIUS
    left = corpus_pipeline.drop_near_copies(spark, make_docs(texts), "")
    assert [r["doc_id"] for r in left.orderBy("doc_id").collect()] == [0, 2]
    assert {frozenset(p) for p in met} == {frozenset(prints[:2])}


@pytest.mark.parametrize("radius", [0, 9])
def test_groups_do_not_depend_on_the_radius(spark, make_docs, radius):
    texts = corpus(7)
    found = near_copies.one_per_group(make_docs(texts), crowd=5, radius=radius)
    assert sorted(r["doc_id"] for r in found.collect()) == slow_first(texts)


def test_stage_against_all_pairs_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    left = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id").collect())
    assert left == [rows[i]["doc_id"] for i in slow_first([r["text"] for r in rows])]


def test_hard_rows_and_any_column_names(spark, hard_docs):
    docs = hard_docs.withColumnsRenamed({"lang": "_row", "source": "_key", "n_chars": "component_id", "other": "_text"})
    left = near_copies.one_per_group(docs)
    assert left.columns == docs.columns
    rows = {r["doc_id"]: r for r in left.collect()}
    texts = {r["doc_id"]: r for r in docs.filter("doc_id is not null").collect()}
    # 0 to 3 have no word, 8 and 9 (and the row without an id) are equal, 4 is there twice
    assert sorted(rows) == [0, 4, 5, 6, 7, 8, 10] and left.count() == 7
    assert all(rows[k] == texts[k] for k in rows)


def test_null_keys_only_and_empty_tables(spark, empty_docs):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "else")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in near_copies.one_per_group(docs).collect()) == ["a b c d e f", "else"]
    assert near_copies.one_per_group(empty_docs).count() == 0 and near_copies.near_copies(empty_docs).count() == 0
