from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fitgrid.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, score string, shard string, rank string"


def slow(rows, asks, k):
    """Best rows by comparing every query with every row; an id asks with its least vector."""
    def numbers(rows):
        return {
            (i, tuple(math.floor(1024 * x) for x in v))
            for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        }

    points, least = numbers(rows), {}
    for i, v in numbers(asks):
        least[i] = min(v, least.get(i, v))
    out = []
    for q, v in least.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in points if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, asks, k=10, **kw):
    frames = [spark.createDataFrame([(i, v, "-", "-", "-") for i, v in part], SCHEMA) for part in (rows, asks)]
    return sorted(tuple(r) for r in topk.top_products(*frames, k=k, **kw).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("values", [topk.SHARD_VALUES, 300])
def test_equals_all_pairs(spark, values):
    draw = random.Random(values)
    vector = lambda: [draw.choice([0.0, draw.gauss(0, 1), -0.5]) for _ in range(6)]
    rows = [(i, vector()) for i in range(400)]
    rows += [(500 + i, rows[i % 7][1]) for i in range(60)]  # ties
    assert found(spark, rows, rows[::9], shard_values=values) == slow(rows, rows[::9], 10)


def test_hard_rows(spark):
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]),
        (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, []), (10, [-0.001, 0.001]),
    ]
    assert found(spark, rows, rows) == slow(rows, rows, 10)
    assert found(spark, rows, rows, k=1, shard_values=2) == slow(rows, rows, 1)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**40 + i / 1024, 2.0**15, -(2.0**14) + i]) for i in range(20)]
    asks = [(100, [1.0 + 1 / 1024, 3 / 1024, -1.0])]
    assert found(spark, rows, asks) == slow(rows, asks, 10)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, rows, rows)


def test_empty_tables(spark):
    assert found(spark, [], []) == [] and found(spark, [], [(1, [1.0])]) == [] and found(spark, [(1, [1.0])], [(1, [1.0])]) == []


def test_stops_before_the_end_of_the_lists():
    draw = np.random.default_rng(1)
    points = draw.integers(-100, 100, (5000, 4))
    points[17] = 1000
    lists, seen = topk.SortedLists(np.arange(5000), points), []
    whole = lists.scores
    lists.scores = lambda rows, query: seen.extend(rows) or whole(rows, query)
    best, score = lists.top(np.array([1, 2, 3, 4]), 3, 1)
    assert best.tolist() == [17] and score.tolist() == [10_000] and len(seen) < 1000
    # a bound that nothing reaches ends the search at once
    seen.clear()
    best, _ = lists.top(np.array([1, 2, 3, 4]), 3, 10, least=20_000)
    assert len(best) == 0 and len(seen) < 1000
