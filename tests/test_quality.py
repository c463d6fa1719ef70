from __future__ import annotations

import numpy as np
import pytest

from fitgrid.operators import metrics
from fitgrid.operators.silhouette import meetings, silhouette_exact, silhouette_squared
from fitgrid.operators.votes import ovr_vote


def test_accuracy_forms(frame):
    df = frame([(1, 1), (1, 0), (0, 0), (0, None)], "y int, p int")
    assert metrics.accuracy(df, "y", "p").first()[0] == 0.5
    assert tuple(metrics.accuracy_pct(df, "y", "p").first()) == (2, 4, 50.0)
    matrix = metrics.confusion(df, "y", "p")
    assert metrics.accuracy_from_confusion(matrix).first()[0] == 0.5
    wide = {r["label"]: (r["pred_0"], r["pred_1"]) for r in metrics.confusion_wide(df, "y", "p", [0, 1]).collect()}
    assert wide == {1: (1, 1), 0: (1, 0)}
    assert metrics.balanced_accuracy(df, "y", "p").first()[0] == 0.5


def test_r2(frame):
    df = frame([(1.0, 1.0), (2.0, 2.5), (3.0, 2.5)], "y double, p double")
    assert metrics.r2(df, "y", "p").first()[0] == pytest.approx(1 - 0.5 / 2)
    assert metrics.r2(frame([(1.0, 2.0)], "y double, p double"), "y", "p").first()[0] is None


def test_epoch_curve_is_ordered(frame):
    df = frame([(2, 1.0), (1, 4.0), (1, 2.0)], "e int, l double")
    assert [tuple(r) for r in metrics.epoch_curve(df, "e", "l").collect()] == [(1, 3.0, 2), (2, 1.0, 1)]


def test_vote_rules(frame):
    votes = [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1), (3, 1, 1), (3, 2, 1)]
    got = {r["k"]: r["prediction"] for r in ovr_vote(frame(votes, "k int, c int, v int"), "k", "c", "v", 0).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def brute_silhouette(points, clusters):
    points, clusters = np.asarray(points), np.asarray(clusters)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(clusters):
        own = clusters == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = far[i, own].sum() / (own.sum() - 1)
        b = min(far[i, clusters == o].mean() for o in set(clusters) if o != c)
        out.append((b - a) / max(a, b))
    return out


def test_exact_silhouette_with_singleton(frame):
    rows = [(1, [0.0], 0), (2, [1.0], 0), (3, [10.0], 1), (4, [12.0], 1), (5, [50.0], 2)]
    got = silhouette_exact(frame(rows, "id int, x array<double>, c int"), "id", "x", "c").orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(brute_silhouette([r[1] for r in rows], [r[2] for r in rows]))
    assert got[4]["silhouette"] == 0.0


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_exact_silhouette_over_blocks(spark, block_rows):
    rng = np.random.default_rng(0)
    points, clusters = rng.normal(size=(90, 5)), rng.integers(0, 4, 90)
    rows = [(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, clusters))]
    df = spark.createDataFrame(rows, "id long, x array<double>, c int")
    got = silhouette_exact(df, "id", "x", "c", block_rows).orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(brute_silhouette(points, clusters))


def test_squared_silhouette_separates(frame):
    rows = [(1, [0.0, 0.0], 0), (2, [0.1, 0.0], 0), (3, [9.0, 9.0], 1), (4, [9.1, 9.0], 1)]
    assert silhouette_squared(frame(rows, "id int, x array<double>, c int"), "x", "c").first()[0] > 0.99


def test_silhouette_of_equal_points_in_two_clusters(spark):
    rows = [(i, [1.0, 1.0], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, c int")
    assert {r["silhouette"] for r in silhouette_exact(df, "id", "x", "c").collect()} == {0.0}


@pytest.mark.parametrize("block_rows", [8192, 16])
def test_far_clusters_are_never_met(spark, block_rows):
    draw = np.random.default_rng(6)
    middles = np.array([[0.0, 0.0], [3.0, 0.0], [60.0, 0.0], [63.0, 1.0], [0.0, 90.0]])
    clusters = draw.integers(0, 5, 150).tolist() + [7, None]
    points = [(middles[c % 5 if c is not None else 0] + draw.normal(size=2)).tolist() for c in clusters]
    df = spark.createDataFrame([(f"k{i:03d}", p, c) for i, (p, c) in enumerate(zip(points, clusters))], "id string, x array<double>, c int")
    got = silhouette_exact(df, "id", "x", "c", block_rows).orderBy("id").collect()
    want = brute_silhouette(points[:-1], clusters[:-1])
    assert [r["silhouette"] for r in got] == pytest.approx(want)
    pairs = silhouette_exact(df, "id", "x", "c", block_rows, most_clusters=1).orderBy("id").collect()
    assert [r["silhouette"] for r in pairs] == pytest.approx(want)
    sizes = df.groupBy("c").count().withColumnRenamed("c", "other")
    met = meetings(df.filter("c is not null"), "id", "x", "c").join(sizes, "other").agg({"count": "sum"}).first()[0]
    assert met < 0.6 * 151**2
