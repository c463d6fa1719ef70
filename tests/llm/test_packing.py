from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fitgrid.llm import QUERIES, packing
from fitgrid.llm.packing import Plan, Sums

from .conftest import PLAIN


def check_places(rows, capacity=1024):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("number", [0, 1, 7, 400, 5000])
def test_plan_places_every_piece(number):
    lengths = np.clip(np.random.default_rng(number).lognormal(5.5, 1.2, number).astype(int), 1, 1024)
    counts = np.bincount(lengths, minlength=1025)
    plan = Plan.best(counts)
    assert (plan.used == counts).all()
    least = -(-int(lengths.sum()) // 1024)
    assert least <= plan.sequences <= least * 1.03 + 1


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, dtype=int)
    counts[[60, 40, 50, 30, 20, 10, 100]] = [5, 5, 4, 3, 3, 3, 2]
    # 60+40, 50+50, 50+30+20 or 30+... by turns: 5*60+5*40+4*50+3*60+200 = 1080
    assert Plan(counts).sequences == -(-1080 // 100)


def test_pairs_and_triples_are_consumed_by_availability():
    counts = np.zeros(101, dtype=int)
    counts[[70, 20, 10, 61, 15, 14]] = [3, 2, 3, 2, 1, 2]
    plan = Plan(counts)
    # 70+20+10 twice by a pair, 61+15+14+10 once by a triple, then 70+14 and 61
    assert plan.exact == [0, 0, 2, 1] and plan.sequences == 5 and (plan.used == counts).all()
    sums = Sums(counts.copy(), 0)
    assert list(sums.pairs(30)) == [(15, 15), (20, 10)] and list(sums.pairs(30, 15)) == [(15, 15)]
    assert (15, 14, 10) in list(sums.triples(39)) and not sums.single(30) and sums.single(61)
    assert list(Sums(counts.copy(), 10).pairs(30)) == [(15, 15)]


@pytest.mark.parametrize("sf, most", [("sf0.01", 964), ("sf0.1", 9872)])
def test_plan_of_the_tables_uses_combinations(sf, most):
    vocabulary, counts = packing.Vocabulary(PLAIN, True), np.zeros(1025, dtype=int)
    texts = [t or "" for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for ids in vocabulary.encode_many(texts):
        counts[1024] += len(ids) // 1024
        counts[len(ids) % 1024 + 1] += 1
    plan = Plan.best(counts)
    assert plan.sequences <= most and plan.exact[2] + plan.exact[3] > 0 and (plan.used == counts).all()


def test_equal_odd_lengths_go_by_best_fit():
    counts = np.zeros(11, dtype=int)
    counts[3], counts[7] = 7, 1
    assert Plan(counts).sequences == 3  # 7+3, then 3+3+3 twice


def test_pieces_match_the_library(hard_docs):
    own = Tokenizer.from_file(PLAIN)
    own.encode_special_tokens = True
    rows = packing.pack(hard_docs, PLAIN).collect()
    pieces = defaultdict(list)
    texts = {r["doc_id"]: r["text"] for r in hard_docs.collect()}
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        found.sort(key=lambda r: r["piece"])
        ids = [*own.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        copies = 2 if key == 4 else 1
        assert len(found) == copies * -(-len(ids) // 1024)
        if copies == 1:
            assert sum((np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in found), []) == ids
            assert [r["start"] for r in found] == np.cumsum([0, *[r["length"] for r in found[:-1]]]).tolist()
            assert all(r["length"] == 1024 for r in found[1:])
    check_places(rows)
    assert "text" not in rows[0].asDict() and rows[0]["lang"] == "en"


def test_clashing_columns_are_replaced(make_docs):
    rows = packing.pack(make_docs(["a", "b"], offset="mine"), PLAIN).collect()
    assert sorted(r["offset"] for r in rows) == [0, 2]


def test_empty_table(empty_docs):
    assert packing.pack(empty_docs, PLAIN).count() == 0


def test_frequent_length_is_ranked_in_groups(spark):
    pieces = spark.range(500).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 5 = 0, 700, 324) as bigint) as length")
    rows = packing.place(pieces, rank_rows=16).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    # 100 of 700 take one of 324 each, the other 300 go by threes
    assert check_places(rows) == 200


def test_too_long_piece_is_refused(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0, 9)], "doc_id bigint, piece int, length bigint"), capacity=8)


def test_query(spark, sf):
    rows = QUERIES["op8_packing"](spark, sf).collect()
    own = Tokenizer.from_file(PLAIN)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for key, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        for n, stop in enumerate(range(first, len(ids) + 1, 1024)):
            part = ids[max(0, stop - 1024) if n else 0 : stop]
            want.add((key, n, stop - len(part), len(part), zlib.crc32(part.tobytes())))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert check_places(rows) <= -(-sum(r["length"] for r in rows) // 1024) * 1.01 + 2


def test_added_tokens_by_the_default_of_the_library(spark, make_docs, tmp_path):
    texts = ["one<|endoftext|>two", "<|endoftext|>", " a <|endoftext|> <|endoftext|>b  ", "<|endoftext", "plain"]
    own = Tokenizer.from_file(PLAIN)
    want = {(i, zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for i, t in enumerate(texts)}
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["ids_crc32"]) for r in QUERIES["op8_packing"](spark, str(tmp_path)).collect()} == want
