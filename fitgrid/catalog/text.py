"""Text formats and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import to_gb, to_mb
from ..functions.text import compact_stamp, epoch_seconds, file_stem, fmt_mean_std, long_stamp, thousands, title_case
from ..operators.stats import dataset_profile, group_stats
from ..plans.report import CATEGORIES, CHAMPION_LINES, report_document, report_rows
from .analytics import case_sql
from .base import query, table


@query(
    "x01_format_stats",
    """SELECT o_custkey,
       printf('%.6f', avg(o_totalprice)) || '±' || coalesce(printf('%.6f', stddev_samp(o_totalprice)), 'nan') AS six,
       printf('%.2f', avg(o_totalprice)) || '±' || coalesce(printf('%.2f', stddev_samp(o_totalprice)), 'nan') AS two
FROM (SELECT o_custkey, floor(o_totalprice / 1000) AS o_totalprice FROM orders) GROUP BY o_custkey""",
)
def x01(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price"))
    stats = group_stats(orders, ["o_custkey"], ["price"], ("mean", "std"), digits=None)
    mean, std = F.col("price_mean"), F.col("price_std")
    return stats.select("o_custkey", fmt_mean_std(mean, std, 6).alias("six"), fmt_mean_std(mean, std, 2).alias("two"))


@query(
    "x02_format_number",
    """SELECT l_suppkey, format('{:,}', count(*)) AS lines, format('{:,}', CAST(sum(l_quantity) AS BIGINT)) AS quantity
FROM lineitem GROUP BY l_suppkey""",
)
def x02(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q")
    )
    return sums.select("l_suppkey", thousands(F.col("n")).alias("lines"), thousands(F.col("q")).alias("quantity"))


@query(
    "x03_title_stem",
    r"""WITH s AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1') AS stem FROM pages)
SELECT page_id, stem,
       array_to_string(list_transform(regexp_extract_all(stem, '[\p{L}]+|[^\p{L}]+'),
                                      lambda w: upper(w[1]) || lower(w[2:])), '') AS title
FROM s""",
)
def x03(spark, sf):
    stems = table(spark, sf, "pages").select("page_id", file_stem(F.col("url")).alias("stem"))
    return stems.withColumn("title", title_case(F.col("stem")))


@query(
    "x04_timestamp_text",
    """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS compact, strftime(ts, '%Y-%m-%d %H:%M:%S') AS long,
       CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""",
)
def x04(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", compact_stamp(ts).alias("compact"), long_stamp(ts).alias("long"), epoch_seconds(ts).alias("seconds")
    )


@query(
    "x06_units",
    """SELECT doc_id, round(strlen(text) / 1048576.0::DOUBLE, 9) AS mb, round(strlen(text) / 1073741824.0::DOUBLE, 12) AS gb
FROM documents""",
)
def x06(spark, sf):
    size = F.octet_length("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.round(to_mb(size), 9).alias("mb"), F.round(to_gb(size), 12).alias("gb")
    )


ALGORITHM_OF_FLAG = {"A": "SVM", "N": "Decision Tree", "R": "Regression"}


REPORT_STATS_SQL = f"""s AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS library, {case_sql('l_returnflag', ALGORITHM_OF_FLAG, 'NULL')} AS algorithm,
         round(avg(l_quantity), 6) AS t, round(stddev_samp(l_quantity), 6) AS ts,
         round(avg(l_tax), 6) AS i, round(stddev_samp(l_tax), 6) AS "is",
         round(avg(l_discount), 6) AS a, round(stddev_samp(l_discount), 6) AS "as",
         round(avg(l_linenumber), 6) AS m, round(avg(l_quantity), 6) AS c
  FROM lineitem GROUP BY l_suppkey, l_returnflag)"""


@query(
    "x07_report_rows",
    f"""WITH {REPORT_STATS_SQL}
SELECT {case_sql('algorithm', CATEGORIES, "'Other'")} AS category, library, algorithm,
       printf('| %s | %s | %.6f±%.6f | %.6f±%.6f | %.4f±%.4f | %.2f | %.2f |',
              library, algorithm, t, ts, i, "is", a, "as", m, c) AS line
FROM s""",
)
def x07(spark, sf):
    return report_rows(line_stats(spark, sf))


def line_stats(spark, sf):
    """Statistics of order lines in the part of benchmark runs: a library per supplier."""
    flags = F.create_map(*[F.lit(x) for pair in ALGORITHM_OF_FLAG.items() for x in pair])
    runs = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("library"),
        flags[F.col("l_returnflag")].alias("algorithm"),
        F.col("l_quantity").alias("train_time_sec"),
        F.col("l_tax").alias("inference_time_sec"),
        F.col("l_discount").alias("accuracy"),
        F.col("l_linenumber").alias("memory_usage_mb"),
        F.col("l_quantity").alias("cpu_usage_percent"),
    )
    return group_stats(
        runs,
        ["library", "algorithm"],
        ["train_time_sec", "inference_time_sec", "accuracy", "memory_usage_mb"],
        optional=["cpu_usage_percent", "peak_memory_mb"],
    )


def _document_sql() -> str:
    heads = ["Library", "Algorithm", "Training (s)", "Inference (s)", "Accuracy", "Memory (MB)", "CPU (%)"]
    header, rule = "| " + " | ".join(heads) + " |", "|" + "|".join("-" * (len(h) + 2) for h in heads) + "|"
    filed = case_sql("algorithm", CATEGORIES, "'Other'")
    rows = """printf('| %s | %s | %.6f±%.6f | %.6f±%.6f | %.4f±%.4f | %.2f | %.2f |',
       library, algorithm, t, ts, i, "is", a, "as", m, c)"""
    parts = [
        "SELECT '0' AS section, '' AS place, '# ML Benchmark Report: Order Lines' AS line",
        "SELECT '1', '0', '## Dataset Information'",
        "SELECT '1', '1', '- **Name**: order lines'",
        "SELECT '1', '2', printf('- **Size**: %s (%s samples)', CASE WHEN count(*) < 1000 THEN 'small' ELSE 'large' END, format('{:,}', count(*))) FROM lineitem",
        "SELECT '1', '3', '- **Features**: 4'",
        "SELECT '1', '4', '- **Classes**: ' || count(DISTINCT l_returnflag) FROM lineitem",
        "SELECT '1', '5', '- **Timestamp**: 2025-01-02 03:04:05'",
        *[f"SELECT DISTINCT '2:' || {filed}, '0{n}', {text} FROM s" for n, text in enumerate((f"'## ' || {filed}", f"'{header}'", f"'{rule}'"))],
        f"SELECT '2:' || {filed}, '1:' || library || ':' || algorithm, {rows} FROM s",
        "SELECT '3', '0', '## Performance Champions'",
    ]
    for place, (objective, (title, digits, unit)) in enumerate(CHAMPION_LINES.items(), 1):
        column, order = {"fastest_training": ("t", "t"), "fastest_inference": ("i", "i"), "best_accuracy": ("a", "a DESC"), "most_efficient": ("m", "m")}[objective]
        parts.append(
            f"(SELECT '3', '{place}', printf('- **{title}**: %s (%s) - %.{digits}f{unit}', algorithm, library, {column}) "
            f"FROM s ORDER BY {order}, library, algorithm LIMIT 1)"
        )
    return f"WITH {REPORT_STATS_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("x08_report_document", _document_sql())
def x08(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_discount", "l_linenumber", "l_returnflag")
    stamp = F.lit("2025-01-02 03:04:05").cast("timestamp")
    return report_document(dataset_profile(lines, "l_returnflag"), line_stats(spark, sf), "order lines", stamp)
