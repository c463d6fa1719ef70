"""Summaries of runs: statistics, percentiles, champions, unions, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clipped_delta, delta
from ..operators import stats
from ..operators.features import drop_warmup, keep_members, lookup
from ..operators.ranking import OBJECTIVES, champions, first_n
from ..plans.joins import lookup_join
from .base import query, table

FLAGS = ["l_returnflag", "l_linestatus"]
METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL_STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

EVENT_NAMES = {"click": "Click", "view": "Page View", "purchase": "Order", "signup": "Registration"}
EVENT_CATEGORIES = {"click": "Interaction", "view": "Interaction", "purchase": "Sale"}


def stats_sql(metrics, names=("mean", "std", "min", "max"), digits=4) -> str:
    return ",\n       ".join(
        f"round({SQL_STATS[s]}({m}), {digits}) AS {m}_{s}" for m in metrics for s in names
    )


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def case_sql(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


@query(
    "a01_dataset_profile",
    """SELECT count(*) AS n_samples, CAST(5 AS INTEGER) AS n_features,
       count(DISTINCT o_orderpriority) AS n_classes,
       CASE WHEN count(*) < 1000 THEN 'small' ELSE 'large' END AS size_category
FROM orders""",
)
def a01(spark, sf):
    return stats.dataset_profile(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "a02_group_stats",
    f"SELECT l_returnflag, l_linestatus, {stats_sql(METRICS)}\nFROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def a02(spark, sf):
    return stats.group_stats(table(spark, sf, "lineitem"), FLAGS, METRICS, digits=4)


@query(
    "a03_optional_metrics",
    f"SELECT l_returnflag, {stats_sql(['l_quantity', 'l_tax'])}\nFROM lineitem GROUP BY l_returnflag",
)
def a03(spark, sf):
    return stats.group_stats(
        table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"], digits=4, optional=["l_tax", "peak_memory_mb"]
    )


@query(
    "a04_stats_sample",
    """WITH o AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_custkey, round(avg(cents), 4) AS mean, round(coalesce(stddev_samp(cents), 0)) AS std_dev,
       CAST(min(cents) AS DOUBLE) AS "min", CAST(max(cents) AS DOUBLE) AS "max", count(*) AS "count"
FROM o GROUP BY o_custkey
UNION ALL
SELECT CAST(-1 AS BIGINT), coalesce(avg(cents), 0), coalesce(stddev_samp(cents), 0),
       CAST(coalesce(min(cents), 0) AS DOUBLE), CAST(coalesce(max(cents), 0) AS DOUBLE), count(*)
FROM o WHERE cents < 0""",
)
def a04(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    orders = table(spark, sf, "orders").select("o_custkey", cents)
    by_customer = stats.sample_stats(orders, ["o_custkey"], "cents")
    none = stats.sample_stats(orders.filter(F.col("cents") < 0), [], "cents")
    both = by_customer.unionByName(none.withColumn("o_custkey", F.lit(-1).cast("bigint")))
    return rounded(rounded(both, 4, "mean"), 0, "std_dev")


@query(
    "a05_stats_pop",
    """SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean,
       round(stddev_pop(l_extendedprice), 4) AS std_dev, round(min(l_extendedprice), 4) AS "min",
       round(max(l_extendedprice), 4) AS "max", count(*) AS "count"
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a05(spark, sf):
    out = stats.sample_stats(table(spark, sf, "lineitem"), FLAGS, "l_extendedprice", ddof=0)
    return rounded(out, 4, "mean", "std_dev", "min", "max")


@query(
    "a06_stats_by_key",
    """SELECT l_returnflag || '_' || l_linestatus AS group_key, l_returnflag, l_linestatus,
       round(avg(l_quantity), 6) AS quantity_mean, round(stddev_pop(l_quantity), 6) AS quantity_std,
       round(avg(l_tax), 6) AS tax_mean, round(stddev_pop(l_tax), 6) AS tax_std, count(*) AS runs
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a06(spark, sf):
    nested = stats.stats_by_key(table(spark, sf, "lineitem"), FLAGS, ["l_quantity", "l_tax"])
    return nested.select(
        "group_key",
        *FLAGS,
        F.round("l_quantity_stats.mean", 6).alias("quantity_mean"),
        F.round("l_quantity_stats.std_dev", 6).alias("quantity_std"),
        F.round("l_tax_stats.mean", 6).alias("tax_mean"),
        F.round("l_tax_stats.std_dev", 6).alias("tax_std"),
        F.col("l_tax_stats.count").alias("runs"),
    )


@query(
    "a07_latency_percentiles",
    """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type""",
)
def a07(spark, sf):
    out = stats.latency_summary(table(spark, sf, "events"), ["event_type"], "value")
    return rounded(out, 6, "mean", "p50", "p90", "p99")


@query(
    "a08_throughput",
    """SELECT l_returnflag, l_linestatus, round(count(*) / sum(l_quantity), 9) AS samples_per_sec
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def a08(spark, sf):
    return rounded(stats.throughput(table(spark, sf, "lineitem"), FLAGS, "l_quantity"), 9, "samples_per_sec")


@query(
    "a09_sample_mean_peak",
    """SELECT d.doc_id, round(coalesce(avg(quality), 0), 6) AS quality_mean, CAST(coalesce(max(quality), 0) AS DOUBLE) AS quality_peak,
       round(coalesce(avg(toxic), 0), 6) AS toxic_mean, CAST(coalesce(max(toxic), 0) AS DOUBLE) AS toxic_peak
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id""",
)
def a09(spark, sf):
    out = stats.mean_peak(table(spark, sf, "labels"), table(spark, sf, "documents"), "doc_id", ["quality", "toxic"])
    return rounded(out, 6, "quality_mean", "toxic_mean")


PLACE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "a10_peak_record",
    f"""WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(PLACE)}) AS first_row,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, {', '.join(PLACE)}) AS peak_row
  FROM lineitem)
SELECT b.l_suppkey,
       CASE WHEN p.l_quantity > b.l_quantity THEN p.l_quantity ELSE b.l_quantity END AS l_quantity,
       CASE WHEN p.l_quantity > b.l_quantity THEN p.l_extendedprice ELSE b.l_extendedprice END AS l_extendedprice,
       CASE WHEN p.l_quantity > b.l_quantity THEN p.l_tax ELSE b.l_tax END AS l_tax
FROM r b JOIN r p ON b.l_suppkey = p.l_suppkey AND b.first_row = 1 AND p.peak_row = 1""",
)
def a10(spark, sf):
    kept = ["l_quantity", "l_extendedprice", "l_tax"]
    peak = stats.peak_record(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", kept, PLACE)
    return peak.select("l_suppkey", "peak.*")


@query(
    "a11_delta",
    """SELECT o_orderkey, round(o_totalprice - 250000.0::DOUBLE, 2) AS raw_delta,
       round(greatest(0, o_totalprice - 250000.0::DOUBLE), 2) AS clipped
FROM orders""",
)
def a11(spark, sf):
    after, before = F.col("o_totalprice"), F.lit(250000.0)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.round(delta(after, before), 2).alias("raw_delta"),
        F.round(clipped_delta(after, before), 2).alias("clipped"),
    )


@query(
    "a12_by_library",
    f"""SELECT l_returnflag AS library, {stats_sql(METRICS, ('mean', 'min', 'max'))}
FROM lineitem GROUP BY l_returnflag""",
)
def a12(spark, sf):
    runs = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "library")
    return stats.group_stats(runs, ["library"], METRICS, ("mean", "min", "max"), digits=4)


@query(
    "a13_library_summary",
    """WITH s AS (SELECT l_returnflag AS library, l_linenumber, avg(l_quantity) AS q, avg(l_tax) AS t
           FROM lineitem GROUP BY l_returnflag, l_linenumber)
SELECT library, count(*) AS models_tested, round(avg(q), 4) AS l_quantity_mean_mean, round(avg(t), 4) AS l_tax_mean_mean
FROM s GROUP BY library""",
)
def a13(spark, sf):
    runs = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "library")
    models = stats.group_stats(runs, ["library", "l_linenumber"], ["l_quantity", "l_tax"], ("mean",), digits=None)
    return stats.group_stats(
        models, ["library"], ["l_quantity_mean", "l_tax_mean"], ("mean",), digits=4, count="models_tested"
    )


@query("a14_sorted_distinct", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def a14(spark, sf):
    return stats.sorted_distinct(table(spark, sf, "part"), "p_brand")


@query("o01_head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def o01(spark, sf):
    return first_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


def run_means(lines: DataFrame, library, algorithm, extra=()) -> DataFrame:
    """Group means of lineitem under the names of run statistics."""
    runs = lines.select(
        *extra,
        library.cast("string").alias("library"),
        algorithm.cast("string").alias("algorithm"),
        F.col("l_quantity").alias("train_time_sec"),
        F.col("l_tax").alias("inference_time_sec"),
        F.col("l_discount").alias("accuracy"),
        F.col("l_extendedprice").alias("memory_usage_mb"),
    )
    metrics = ["train_time_sec", "inference_time_sec", "accuracy", "memory_usage_mb"]
    return stats.group_stats(runs, [*extra, "library", "algorithm"], metrics, ("mean",), digits=4)


def champions_sql(keys: str, source: str) -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    parts = []
    for title, (metric, direction) in OBJECTIVES.items():
        order = "DESC" if direction == "max" else "ASC"
        parts.append(
            f"SELECT {lead}'{title}' AS objective, library, algorithm, {metric} AS value FROM s "
            f"QUALIFY row_number() OVER ({by}ORDER BY {metric} {order}, library, algorithm) = 1"
        )
    return f"WITH s AS ({source})\n" + "\nUNION ALL\n".join(parts)


def run_means_sql(library: str, algorithm: str, extra: str = "", source: str = "lineitem") -> str:
    lead = f"{extra}, " if extra else ""
    group = "1, 2, 3" if extra else "1, 2"
    return f"""SELECT {lead}CAST({library} AS VARCHAR) AS library, CAST({algorithm} AS VARCHAR) AS algorithm,
  round(avg(l_quantity), 4) AS train_time_sec_mean, round(avg(l_tax), 4) AS inference_time_sec_mean,
  round(avg(l_discount), 4) AS accuracy_mean, round(avg(l_extendedprice), 4) AS memory_usage_mb_mean
  FROM {source} GROUP BY {group}"""


@query("o02_champions", champions_sql("", run_means_sql("l_suppkey", "l_linenumber")))
def o02(spark, sf):
    means = run_means(table(spark, sf, "lineitem"), F.col("l_suppkey"), F.col("l_linenumber"))
    return champions(means, OBJECTIVES, ["library", "algorithm"])


@query(
    "o03_champions_by_category",
    champions_sql(
        "category",
        run_means_sql(
            "l_returnflag", "l_linenumber", "p_type AS category", "lineitem JOIN part ON l_partkey = p_partkey"
        ),
    ),
)
def o03(spark, sf):
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    filed = lookup_join(table(spark, sf, "lineitem"), kinds, "l_partkey", "inner")
    means = run_means(filed, F.col("l_returnflag"), F.col("l_linenumber"), ["category"])
    return champions(means, OBJECTIVES, ["library", "algorithm"], ["category"])


@query(
    "u01_union_results",
    """SELECT c_mktsegment AS library, c_name AS model, c_acctbal AS train_time_sec, CAST(c_nationkey AS DOUBLE) AS inference_time_sec,
       0.5::DOUBLE AS accuracy, CAST(c_custkey AS DOUBLE) AS memory_usage_mb FROM customer
UNION ALL BY NAME
SELECT 'supplier' AS library, s_name AS model, s_acctbal AS train_time_sec, CAST(s_nationkey AS DOUBLE) AS inference_time_sec,
       0.25::DOUBLE AS accuracy, CAST(s_suppkey AS DOUBLE) AS memory_usage_mb,
       s_acctbal / 100 AS cpu_usage_percent, CAST(s_suppkey + 1 AS DOUBLE) AS peak_memory_mb FROM supplier""",
)
def u01(spark, sf):
    short = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("library"),
        F.col("c_name").alias("model"),
        F.col("c_acctbal").alias("train_time_sec"),
        F.col("c_nationkey").cast("double").alias("inference_time_sec"),
        F.lit(0.5).alias("accuracy"),
        F.col("c_custkey").cast("double").alias("memory_usage_mb"),
    )
    long = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("library"),
        F.col("s_name").alias("model"),
        F.col("s_acctbal").alias("train_time_sec"),
        F.col("s_nationkey").cast("double").alias("inference_time_sec"),
        F.lit(0.25).alias("accuracy"),
        F.col("s_suppkey").cast("double").alias("memory_usage_mb"),
        (F.col("s_acctbal") / 100).alias("cpu_usage_percent"),
        (F.col("s_suppkey") + 1).cast("double").alias("peak_memory_mb"),
    )
    return stats.append_results(short, long)


@query(
    "f13_standardise_name",
    f"SELECT event_id, {case_sql('event_type', EVENT_NAMES, 'event_type')} AS standard FROM events",
)
def f13(spark, sf):
    return lookup(table(spark, sf, "events"), "event_type", EVENT_NAMES, "standard").select("event_id", "standard")


def _sql_literal(text: str) -> str:
    return "'" + text + "'"


@query(
    "f14_category",
    f"SELECT event_id, {case_sql('event_type', EVENT_CATEGORIES, _sql_literal('Other'))} AS category FROM events",
)
def f14(spark, sf):
    named = lookup(table(spark, sf, "events"), "event_type", EVENT_CATEGORIES, "category", "Other")
    return named.select("event_id", "category")


@query(
    "f16_in_category",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def f16(spark, sf):
    chosen = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    return keep_members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", chosen)


@query(
    "f17_drop_warmup",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber >= 2",
)
def f17(spark, sf):
    runs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return drop_warmup(runs, "l_linenumber", 2)
