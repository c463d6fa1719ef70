"""Scoring and quality metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.arrays import argmax, cross_entropy
from ..functions.scalars import eq_target
from ..models.kmeans import Centres, assign_cluster
from ..models.linear import LinearModel
from ..operators import metrics
from ..models.svm import LinearMachineModel
from ..operators.features import assemble, ovr_targets
from ..operators.ranking import first_n
from ..operators.silhouette import silhouette_exact, silhouette_squared
from ..operators.votes import ovr_vote
from ..session import scratch_path
from ..sources.tables import stream_parquet
from ..streaming import score_stream
from .base import query, table

FIXED_MODEL = LinearModel(("l_quantity", "l_discount", "l_tax"), (2100.0, -1500.0, 320.5), 25.0)
PREDICT_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round(25.0::DOUBLE + 2100.0::DOUBLE * l_quantity + -1500.0::DOUBLE * l_discount + 320.5::DOUBLE * l_tax, 4) AS prediction
FROM lineitem"""
LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("i01_predict_linear", PREDICT_SQL)
def i01(spark, sf):
    scored = FIXED_MODEL.transform(table(spark, sf, "lineitem"))
    return scored.select(*LINE_KEYS, F.round("prediction", 4).alias("prediction"))


@query("i05_stream_score", PREDICT_SQL)
def i05(spark, sf):
    path = f"{sf}/lineitem.parquet"
    stream = stream_parquet(spark, path, spark.read.parquet(path).schema)
    out, log = scratch_path(spark, "scored"), scratch_path(spark, "score-log")
    score_stream(stream.select(*LINE_KEYS, *FIXED_MODEL.features), FIXED_MODEL, out, log).awaitTermination()
    return spark.read.parquet(out).select(*LINE_KEYS, F.round("prediction", 4).alias("prediction"))


def first_centres(spark, sf, k: int = 8) -> Centres:
    """The points with the lowest ids as starting centres."""
    points = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return Centres.of([r["x"] for r in first_n(points, ["vec_id"], k).collect()])


CENTRES_SQL = """c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, embedding::DOUBLE[] AS c
       FROM embeddings ORDER BY vec_id LIMIT 8),
e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"""


@query(
    "i02_assign_cluster",
    f"""WITH {CENTRES_SQL}
SELECT vec_id, CAST(arg_min(cluster, list_distance(x, c)) AS INTEGER) AS cluster,
       round(min(list_distance(x, c)) * min(list_distance(x, c)), 6) AS cost
FROM e, c0 GROUP BY vec_id""",
)
def i02(spark, sf):
    near = assign_cluster(table(spark, sf, "embeddings"), "embedding", first_centres(spark, sf))
    return near.select("vec_id", "cluster", F.round("cost", 6).alias("cost"))


@query(
    "i03_argmax",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
)
def i03(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax("embedding").alias("best"))


@query(
    "i04_ovr_vote",
    """WITH v AS (SELECT vec_id, c.cls, CASE WHEN label > c.cls AND embedding[1 + c.cls] > 0 THEN 1 ELSE 0 END AS vote
           FROM embeddings CROSS JOIN (SELECT DISTINCT label AS cls FROM embeddings) c)
SELECT vec_id, coalesce(min(cls) FILTER (WHERE vote = 1), 0) AS prediction FROM v GROUP BY vec_id""",
)
def i04(spark, sf):
    vectors = table(spark, sf, "embeddings")
    votes = ovr_targets(vectors, "label", keep=["vec_id", "embedding", "label"]).withColumn(
        "vote",
        F.when((F.col("label") > F.col("cls")) & (F.get("embedding", F.col("cls")) > 0), 1).otherwise(0),
    )
    return ovr_vote(votes, "vec_id", "cls", "vote", first_class=0)


# Three machines over four line columns; the last weight is the constant.
MACHINES = [[0.04, 2.0, -1.0, 0.1, -1.2], [-0.02, -3.0, 4.0, -0.2, 0.9], [0.01, 5.0, 5.0, 0.05, -0.8]]
MACHINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _margin_sql(weights: list[float]) -> str:
    terms = [f"{w}::DOUBLE * {c}" for w, c in zip(weights, MACHINE_COLUMNS)]
    return " + ".join([f"{weights[-1]}::DOUBLE", *terms])


@query(
    "i04b_machine_votes",
    f"""WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       {', '.join(f'{_margin_sql(w)} AS m{i}' for i, w in enumerate(MACHINES))} FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0.0::DOUBLE WHEN m1 >= m2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS by_margin,
       CASE WHEN m0 > 0 THEN 0.0::DOUBLE WHEN m1 > 0 THEN 1.0::DOUBLE WHEN m2 > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS by_vote
FROM m""",
)
def i04b(spark, sf):
    lines = assemble(table(spark, sf, "lineitem"), MACHINE_COLUMNS)
    model = LinearMachineModel(np.array(MACHINES), prediction="by_margin")
    both = model.with_vote("hard", "by_vote").transform(model.transform(lines))
    return both.select(*LINE_KEYS, "by_margin", "by_vote")


def flagged(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag",
        eq_target("l_linestatus", "F").alias("label"),
        (F.col("l_quantity") > 25).cast("int").alias("prediction"),
    )


FLAGGED = "(SELECT l_returnflag, CAST(l_linestatus = 'F' AS INTEGER) AS label, CAST(l_quantity > 25 AS INTEGER) AS prediction FROM lineitem)"


@query(
    "e01_accuracy",
    f"SELECT l_returnflag, round(avg(CAST(label = prediction AS INTEGER)), 9) AS accuracy FROM {FLAGGED} GROUP BY l_returnflag",
)
def e01(spark, sf):
    out = metrics.accuracy(flagged(spark, sf), "label", "prediction", ["l_returnflag"])
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(
    "e02_accuracy_pct",
    f"""SELECT CAST(sum(CAST(label = prediction AS INTEGER)) AS BIGINT) AS correct, count(*) AS total,
       round(100.0::DOUBLE * sum(CAST(label = prediction AS INTEGER)) / count(*), 6) AS accuracy_pct FROM {FLAGGED}""",
)
def e02(spark, sf):
    out = metrics.accuracy_pct(flagged(spark, sf), "label", "prediction")
    return out.withColumn("accuracy_pct", F.round("accuracy_pct", 6))


@query(
    "e03_confusion_matrix",
    f"SELECT label, prediction, count(*) AS n FROM {FLAGGED} GROUP BY label, prediction",
)
def e03(spark, sf):
    return metrics.confusion(flagged(spark, sf), "label", "prediction")


@query(
    "e03b_confusion_accuracy",
    f"SELECT round(count(*) FILTER (WHERE label = prediction) / count(*), 9) AS accuracy FROM {FLAGGED}",
)
def e03b(spark, sf):
    matrix = metrics.confusion(flagged(spark, sf), "label", "prediction")
    return metrics.accuracy_from_confusion(matrix).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "e04_r2",
    """SELECT round(1 - sum(power(l_extendedprice - 2100 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 9) AS r2
FROM lineitem""",
)
def e04(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2100).alias("p"))
    return metrics.r2(lines, "l_extendedprice", "p").withColumn("r2", F.round("r2", 9))


def clustered(spark, sf):
    return table(spark, sf, "embeddings").withColumn("cluster", (F.col("vec_id") % 8).cast("int"))


def silhouette_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(vec_id % 8 AS INTEGER) AS cluster, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT a.vec_id, a.cluster, b.cluster AS other, sum({distance}) AS s, count(*) AS n
      FROM e a, e b GROUP BY 1, 2, 3),
m AS (SELECT vec_id, cluster, max(CASE WHEN cluster = other AND n > 1 THEN s / (n - 1) END) AS a,
             min(CASE WHEN cluster <> other THEN s / n END) AS b FROM d GROUP BY 1, 2)"""


@query(
    "e05_silhouette_sq",
    silhouette_sql("list_distance(a.x, b.x) * list_distance(a.x, b.x)")
    + "\nSELECT round(avg((b - a) / greatest(a, b)), 9) + 0.0::DOUBLE AS silhouette FROM m",
)
def e05(spark, sf):
    out = silhouette_squared(clustered(spark, sf), "embedding", "cluster")
    return out.withColumn("silhouette", F.round("silhouette", 9))


@query(
    "e06_silhouette_exact",
    silhouette_sql("list_distance(a.x, b.x)")
    + "\nSELECT vec_id, cluster, round((b - a) / greatest(a, b), 6) + 0.0::DOUBLE AS silhouette FROM m",
)
def e06(spark, sf):
    out = silhouette_exact(clustered(spark, sf), "vec_id", "embedding", "cluster")
    return out.withColumn("silhouette", F.round("silhouette", 6))


@query(
    "e07_epoch_curve",
    """SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(avg(value), 6) AS mean_loss, count(*) AS batches,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS epoch_seconds
FROM events GROUP BY 1 ORDER BY 1""",
)
def e07(spark, sf):
    batches = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "value", "ts")
    curve = metrics.epoch_curve(batches, "epoch", "value", "ts")
    return curve.withColumns(
        {"mean_loss": F.round("mean_loss", 6), "epoch_seconds": F.round("epoch_seconds", 6)}
    )


@query(
    "e08_cross_entropy",
    """WITH u AS (SELECT vec_id, label, embedding[1 + label]::DOUBLE AS own, unnest(embedding::DOUBLE[]) AS s FROM embeddings)
SELECT vec_id, round(ln(sum(exp(s))) - any_value(own), 6) AS loss FROM u GROUP BY vec_id""",
)
def e08(spark, sf):
    scores = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(cross_entropy(scores, "label"), 6).alias("loss"))
