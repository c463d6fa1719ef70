from __future__ import annotations

import numpy as np
import pytest

from fitgrid.llm import QUERIES, ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def slow(points, ids, query, own, k):
    far = np.sqrt(np.square(np.asarray(points) - query).sum(axis=1))
    best = sorted((d, i) for d, i in zip(far.tolist(), ids) if i != own)
    return best[:k]


def table(spark, points, ids=None):
    ids = range(len(points)) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, p if p is None else [None if v is None else float(v) for v in p], 0) for i, p in zip(ids, points)], SCHEMA)


@pytest.mark.parametrize("shard_rows", [8_192, 150])
def test_recall(spark, shard_rows):
    points = np.random.default_rng(2).normal(size=(900, 24)).astype(np.float32)
    vectors = table(spark, points)
    rows = ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), shard_rows=shard_rows).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = 0
    for q in range(0, 900, 20):
        want = slow(points.astype(float), range(900), points[q].astype(float), q, 10)
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: f[1:])
        hits += len({i for _, i in want} & {f[2] for f in found})
        for _, d, i in found:
            assert abs(d - np.sqrt(np.square(points[i].astype(float) - points[q].astype(float)).sum())) < 1e-12
    assert hits / (45 * 10) >= 0.97


def test_copies_and_ties_go_by_id(spark):
    points = [[1.0, 0.0]] * 60 + [[0.0, 1.0], [0.0, -1.0], [0.9, 0.1]]
    rows = ann.nearest(table(spark, points), table(spark, points).filter("vec_id in (5, 62)"), k=4).collect()
    found = {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (5, 62)}
    assert found == {5: [0, 1, 2, 3], 62: [0, 1, 2, 3]}


def test_vectors_that_take_no_part(spark):
    points = [[1.0, 2.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [], [2.0, 2.0], [1.0, 2.0, 3.0], [1.0, 2.0, 4.0], [3.0, 2.0]]
    ids = [*range(10), None]
    vectors = table(spark, points, ids)
    rows = ann.nearest(vectors.unionByName(vectors.filter("vec_id = 7")), vectors).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows) == [(0, 1, 7, 1.0), (7, 1, 0, 1.0), (8, 1, 9, 1.0), (9, 1, 8, 1.0)]


def test_fewer_candidates_and_empty_tables(spark):
    three = table(spark, [[1.0, 0.5], [2.0, 0.5], [4.0, 0.5]])
    rows = ann.nearest(three, three.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(rows)] == [(1, 1), (2, 2)]
    assert ann.nearest(three.limit(0), three.limit(0)).count() == 0
    assert ann.nearest(three, three.limit(0)).count() == 0
    assert ann.nearest(three.filter("vec_id = 0"), three.filter("vec_id = 0")).count() == 0


def test_graph_is_flat_bounded_and_without_loops():
    points = np.random.default_rng(4).normal(size=(700, 8))
    levels = np.minimum((-np.log(np.random.default_rng(5).random(700)) / np.log(16)).astype(int), 5)
    graph = ann.Graph(points, levels).build()
    for level, near in enumerate(graph.near):
        assert near.dtype == np.int32 and near.shape == (700, 32 if level == 0 else 16)
        assert (near[levels < level] == -1).all()
        for node, row in enumerate(near):
            there = row[row >= 0]
            assert node not in there and len(set(there.tolist())) == len(there)
            assert (levels[there] >= level).all()


def test_same_result_whatever_the_partitions(spark):
    points = np.random.default_rng(6).normal(size=(300, 6)).astype(np.float32)
    vectors = table(spark, points)
    first = ann.nearest(vectors, vectors.filter("vec_id < 9"), shard_rows=100).collect()
    again = ann.nearest(vectors.repartition(11), vectors.filter("vec_id < 9").repartition(3), shard_rows=100).collect()
    assert sorted(first) == sorted(again)


def test_query(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    points, ids = np.array([r["embedding"] for r in data], dtype=float), [r["vec_id"] for r in data]
    rows = QUERIES["op1_ann"](spark, sf).collect()
    hits = total = 0
    for q in (i for i in ids if i % 100 == 0):
        want = slow(points, ids, points[ids.index(q)], q, 10)
        hits += len({i for _, i in want} & {r["vec_id"] for r in rows if r["query_id"] == q})
        total += len(want)
    assert len(rows) == total and hits / total >= 0.97


def test_an_id_with_several_vectors_leaves_all_places(spark):
    rows = [(0, [1.0, i / 1000]) for i in range(6)] + [(i, [1.0, i / 10]) for i in range(1, 15)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = ann.nearest(vectors, vectors.filter("vec_id = 0 and embedding[1] = 0"))
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == list(range(1, 11))
