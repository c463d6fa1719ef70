"""Sources and sinks: each query writes a whole table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import fit_scaler
from ..operators.split import ordered_split
from ..operators.stats import flatten_stats, stats_struct
from ..plans.suite import numeric_table
from ..session import scratch_path
from ..sources.blobs import blobs
from ..sources.results import flatten_report, read_results, write_result_arrays, write_results
from ..sources.tables import read_labelled_csv, write_csv
from .base import query, table


def _csv_round_trip(spark, sf, name, sep, quote_all):
    whole = table(spark, sf, name)
    path = scratch_path(spark, f"csv-{name}")
    write_csv(whole, path, sep, quote_all)
    return read_labelled_csv(spark, path, whole.schema, sep).frame


@query("s01_csv_comma", "SELECT * FROM customer")
def s01(spark, sf):
    return _csv_round_trip(spark, sf, "customer", ",", False)


@query("s02_csv_semicolon", "SELECT * FROM supplier")
def s02(spark, sf):
    return _csv_round_trip(spark, sf, "supplier", ";", True)


@query("s03_json_array", "SELECT * FROM part")
def s03(spark, sf):
    whole = table(spark, sf, "part")
    path = scratch_path(spark, "json-array")
    write_result_arrays(whole, path, "p_partkey")
    return read_results(spark, path, lines=False, schema=whole.schema)


@query("s04_json_lines", "SELECT * FROM events")
def s04(spark, sf):
    whole = table(spark, sf, "events")
    path = scratch_path(spark, "json-lines")
    write_results(whole, path)
    return read_results(spark, path, schema=whole.schema)


@query(
    "s05_json_flatten",
    """SELECT o_orderkey, 'spark' AS language, o_totalprice AS price, o_orderpriority AS priority,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS clusters, CAST(NULL AS BIGINT) AS classes
FROM orders""",
)
def s05(spark, sf):
    orders = table(spark, sf, "orders")
    packed = orders.select(
        "o_orderkey",
        F.lit("spark").alias("language"),
        F.struct(
            F.col("o_totalprice").alias("price"),
            F.col("o_orderpriority").alias("priority"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("clusters"),
        ).alias("benchmark_results"),
    )
    path = scratch_path(spark, "json-report")
    write_results(packed, path)
    schema = (
        "o_orderkey bigint, language string, "
        "benchmark_results struct<price: double, priority: string, clusters: bigint, classes: bigint>"
    )
    return flatten_report(read_results(spark, path, schema=schema), "benchmark_results")


def _flat_stats_sql() -> str:
    cols = []
    for m in ("l_quantity", "l_tax"):
        cols.append(
            f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, "
            f"min({m}) AS {m}_min, max({m}) AS {m}_max, count({m}) AS {m}_n"
        )
    return f"SELECT l_suppkey, {', '.join(cols)} FROM lineitem GROUP BY l_suppkey"


@query("s06_stats_struct", _flat_stats_sql())
def s06(spark, sf):
    report = stats_struct(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity", "l_tax"])
    nested = scratch_path(spark, "stats-json")
    write_results(report, nested)
    flat = flatten_stats(read_results(spark, nested, schema=report.schema))
    path = scratch_path(spark, "stats-csv")
    write_csv(flat, path)
    back = read_labelled_csv(spark, path, flat.schema).frame
    rounded = [c for c in back.columns if c.endswith(("_mean", "_std"))]
    return back.withColumns({c: F.round(c, 6) for c in rounded})


def _unit(text: str, at: int = 1) -> str:
    return f"((('0x' || substr(md5({text}), {at}, 8))::BIGINT + 1.0::DOUBLE) / 4294967296.0::DOUBLE)"


def _blob_sql(k: int, d: int, seed: int) -> str:
    parts = []
    for j in range(d):
        centre = f"({_unit(f"'{seed}:c:' || c || ':{j}'")} * 2 - 1) * 10"
        pair = f"'{seed}:p:' || o_orderkey || ':{j // 2}'"
        wave = "cos" if j % 2 == 0 else "sin"
        normal = f"sqrt(-2 * ln({_unit(pair)})) * {wave}({_unit(pair, 9)} * 2 * pi())"
        parts.append(
            f"SELECT o_orderkey, c AS cluster, CAST({j} AS INTEGER) AS pos, round({centre} + {normal}, 6) + 0.0::DOUBLE AS value FROM o"
        )
    return f"WITH o AS (SELECT o_orderkey, CAST(o_orderkey % {k} AS INTEGER) AS c FROM orders)\n" + "\nUNION ALL\n".join(parts)


@query("s07_make_blobs", _blob_sql(8, 4, 42))
def s07(spark, sf):
    points = blobs(table(spark, sf, "orders"), "o_orderkey", 8, 4, 42)
    wide = points.select("o_orderkey", "cluster", F.posexplode("features").alias("pos", "value"))
    return wide.withColumn("value", F.round("value", 6))


@query(
    "s08_prepared_table",
    """WITH priorities AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1),
statuses AS (SELECT o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS label FROM orders GROUP BY 1),
t AS (SELECT o_orderkey AS id, o_totalprice AS price, o_custkey::DOUBLE AS customer, code::DOUBLE AS priority_code, label::INTEGER AS label,
      row_number() OVER (ORDER BY o_orderkey) <= floor(0.8::DOUBLE * count(*) OVER ()) AS train
      FROM orders JOIN priorities USING (o_orderpriority) JOIN statuses USING (o_orderstatus)),
m AS (SELECT avg(price) AS p, stddev_pop(price) AS ps, avg(customer) AS c, stddev_pop(customer) AS cs,
      avg(priority_code) AS k, stddev_pop(priority_code) AS ks FROM t WHERE train)
SELECT id, label, CASE WHEN train THEN 'train' ELSE 'test' END AS part, round((price - p) / ps, 6) + 0.0::DOUBLE AS price,
       round((customer - c) / cs, 6) + 0.0::DOUBLE AS customer, round((priority_code - k) / ks, 6) + 0.0::DOUBLE AS priority_code
FROM t, m""",
)
def s08(spark, sf):
    """A delimited file to scaled vectors: lenient numbers, codes by first appearance, split by place."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("y"),
    )
    path = scratch_path(spark, "prepared")
    write_csv(orders, path, ";", quote_all=True)
    raw = read_labelled_csv(spark, path, "id bigint, price string, customer string, priority string, y string", ";").frame
    whole, features = numeric_table(raw, "id", ["price", "customer"], ["priority"], "y")
    split = ordered_split(whole, ["id"], 0.8)
    scaler = fit_scaler(split.filter("part = 'train'"), features)
    scaled = scaler.transform(split).select("id", F.col("label").cast("int").alias("label"), "part", *features)
    return scaled.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in features})
