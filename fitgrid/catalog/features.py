"""Feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import normalise_array
from ..functions.scalars import above_target, eq_target, one_vs_others, to_double
from ..operators.encode import encode_first_seen, encode_target
from ..operators.features import assemble, feature_set, fit_scaler, ovr_targets, scaler_stats, split_xy
from ..operators.split import ordered_split
from .base import query, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALGORITHMS = ["SVC", "LinearSVC", "DecisionTreeClassifier", "RandomForestClassifier", "MLPClassifier"]


@query(
    "f01_split_xy",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice AS target FROM part",
)
def f01(spark, sf):
    x, y = split_xy(table(spark, sf, "part"), "p_retailprice", ["p_partkey"])
    return x.join(y.withColumnRenamed("p_retailprice", "target"), "p_partkey")


FLOAT = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def parse_sql(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, {FLOAT}) THEN CAST({expr} AS DOUBLE) ELSE 0.0::DOUBLE END"


@query(
    "f02_lenient_double",
    f"""SELECT o_orderkey AS id, {parse_sql('o_orderpriority')} AS whole, {parse_sql('substr(o_orderpriority, 1, 1)')} AS part,
       {parse_sql("(' ' || substr(o_orderpriority, 1, 1))")} AS blank FROM orders
UNION ALL
SELECT -1 - event_id, {parse_sql('props')}, {parse_sql("regexp_extract(props, '[0-9]+')")},
       {parse_sql("(regexp_extract(props, '[0-9]+') || 'e1')")} FROM events""",
)
def f02(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        to_double("o_orderpriority").alias("whole"),
        to_double(first).alias("part"),
        to_double(F.concat(F.lit(" "), first)).alias("blank"),
    )
    digits = F.regexp_extract("props", "[0-9]+", 0)
    events = table(spark, sf, "events").select(
        (-1 - F.col("event_id")).alias("id"),
        to_double("props").alias("whole"),
        to_double(digits).alias("part"),
        to_double(F.concat(digits, F.lit("e1"))).alias("blank"),
    )
    return orders.unionByName(events)


def codes_sql(name: str, source: str, col: str, order: str) -> str:
    return (
        f"{name} AS (SELECT {col} AS v, row_number() OVER (ORDER BY min({order})) - 1 AS code "
        f"FROM {source} GROUP BY {col})"
    )


@query(
    "f03_encode_first_seen",
    f"""WITH {codes_sql('s', 'orders', 'o_orderstatus', 'o_orderkey')},
{codes_sql('p', 'orders', 'o_orderpriority', 'o_orderkey')}
SELECT o_orderkey, s.code AS o_orderstatus_code, p.code AS o_orderpriority_code
FROM orders JOIN s ON o_orderstatus = s.v JOIN p ON o_orderpriority = p.v""",
)
def f03(spark, sf):
    cols = ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf, "orders").select("o_orderkey", *cols)
    return encode_first_seen(orders, cols, "o_orderkey").drop(*cols)


@query(
    "f04_encode_target",
    f"""WITH {codes_sql('t', 'events', 'event_type', 'event_id')}
SELECT event_id, t.code AS label FROM events JOIN t ON event_type = t.v""",
)
def f04(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return encode_target(events, "event_type", "event_id").select("event_id", "label")


@query("f05_binary_target", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders")
def f05(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", eq_target("o_orderstatus", "F").alias("y"))


@query("f06_one_vs_others", "SELECT vec_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings")
def f06(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", one_vs_others("label", 0).alias("y"))


@query("f06_above_zero", "SELECT vec_id, CAST(label > 0 AS INTEGER) AS y FROM embeddings")
def f06_above(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", above_target("label").alias("y"))


@query(
    "f07_ovr_targets",
    """SELECT vec_id, c.cls, CAST(label = c.cls AS INTEGER) AS y
FROM embeddings CROSS JOIN (SELECT DISTINCT label AS cls FROM embeddings) c""",
)
def f07(spark, sf):
    return ovr_targets(table(spark, sf, "embeddings"), "label", keep=["vec_id"])


@query(
    "f08_assemble",
    f"""WITH {codes_sql('b', 'part', 'p_brand', 'p_partkey')},
{codes_sql('t', 'part', 'p_type', 'p_partkey')},
w AS (SELECT p_partkey, p_size, p_retailprice, b.code AS brand, t.code AS kind
      FROM part JOIN b ON p_brand = b.v JOIN t ON p_type = t.v)
SELECT p_partkey, CAST(0 AS INTEGER) AS pos, CAST(p_size AS DOUBLE) AS value FROM w
UNION ALL SELECT p_partkey, 1, p_retailprice FROM w
UNION ALL SELECT p_partkey, 2, CAST(brand AS DOUBLE) FROM w
UNION ALL SELECT p_partkey, 3, CAST(kind AS DOUBLE) FROM w""",
)
def f08(spark, sf):
    coded = encode_first_seen(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey")
    vectors = assemble(coded, ["p_size", "p_retailprice"], ["p_brand_code", "p_type_code"])
    return vectors.select("p_partkey", F.posexplode("features").alias("pos", "value"))


@query(
    "f09_scaler_fit",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean,
       round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1 ELSE stddev_pop({c}) END, 4) AS std FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def f09(spark, sf):
    out = scaler_stats(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return out.select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(
    "f10_scaler_transform",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS total FROM orders),
p AS (SELECT *, CASE WHEN r <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS part FROM n),
s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS d1, avg(o_custkey) AS m2, stddev_pop(o_custkey) AS d2
      FROM p WHERE part = 'train')
SELECT o_orderkey, part, round((o_totalprice - m1) / d1, 6) + 0.0::DOUBLE AS o_totalprice,
       round((o_custkey - m2) / d2, 6) + 0.0::DOUBLE AS o_custkey
FROM p, s""",
)
def f10(spark, sf):
    cols = ["o_totalprice", "o_custkey"]
    split = ordered_split(table(spark, sf, "orders").select("o_orderkey", *cols), ["o_orderkey"])
    scaler = fit_scaler(split.filter(F.col("part") == "train"), cols)
    scaled = scaler.transform(split)
    return scaled.select("o_orderkey", "part", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "f11_array_normalise",
    """SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round((v - 0.5) / 0.5, 6) + 0.0::DOUBLE AS value FROM
(SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
)
def f11(spark, sf):
    normal = normalise_array("embedding", 1.0, 0.5, 0.5)
    wide = table(spark, sf, "embeddings").select("vec_id", F.posexplode(normal).alias("pos", "value"))
    return wide.withColumn("value", F.round("value", 6))


@query(
    "f12_feature_choice",
    f"""WITH a AS (SELECT p_partkey, p_retailprice, {ALGORITHMS}[1 + p_size % 5] AS algorithm FROM part),
s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part)
SELECT p_partkey, algorithm,
       CASE WHEN algorithm IN ('SVC', 'LinearSVC', 'MLPClassifier') THEN 'scaled' ELSE 'raw' END AS feature_set,
       round(CASE WHEN algorithm IN ('SVC', 'LinearSVC', 'MLPClassifier') THEN (p_retailprice - m) / d ELSE p_retailprice END, 6) + 0.0::DOUBLE AS value
FROM a, s""",
)
def f12(spark, sf):
    part = table(spark, sf, "part")
    scaled = fit_scaler(part, ["p_retailprice"]).transform(part, suffix="_z")
    name = F.array(*[F.lit(a) for a in ALGORITHMS])[F.col("p_size") % 5]
    chosen = scaled.withColumn("algorithm", name).withColumn("feature_set", feature_set(F.col("algorithm")))
    value = F.when(F.col("feature_set") == "scaled", F.col("p_retailprice_z")).otherwise(F.col("p_retailprice"))
    return chosen.select("p_partkey", "algorithm", "feature_set", F.round(value, 6).alias("value"))
