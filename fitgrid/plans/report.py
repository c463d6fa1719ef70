"""From raw result records to grouped statistics and report rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fixed, fmt_mean_std, long_stamp, thousands, title_case
from ..operators.features import lookup
from ..operators.ranking import OBJECTIVES, champions
from ..operators.stats import group_stats

# Standard names of the algorithms, and the category of each.
ALGORITHM_NAMES = {
    "SVC": "SVM",
    "SVM (One-vs-Rest)": "SVM",
    "SVM (Binary: Setosa vs Others)": "SVM (Binary)",
    "MultiClassSVC": "SVM",
    "LinearSVC": "SVM (Linear)",
    "SVM (Gaussian/RBF)": "SVM (RBF)",
    "DecisionTreeClassifier": "Decision Tree",
    "Decision Tree": "Decision Tree",
    "RandomForestClassifier": "Random Forest",
    "Random Forest": "Random Forest",
    "MLPClassifier": "Neural Network",
    "MLP": "Neural Network",
}
CATEGORIES = {
    "SVM": "Support Vector Machines",
    "SVM (Binary)": "Support Vector Machines",
    "SVM (Linear)": "Support Vector Machines",
    "SVM (RBF)": "Support Vector Machines",
    "Decision Tree": "Tree-Based Models",
    "Random Forest": "Tree-Based Models",
    "Neural Network": "Neural Networks",
}
# Title, decimals and unit of each champion's line in the report, in this order.
CHAMPION_LINES = {
    "fastest_training": ("🏃 Fastest Training", 6, "s"),
    "fastest_inference": ("⚡ Fastest Inference", 6, "s"),
    "best_accuracy": ("🎯 Best Accuracy", 4, ""),
    "most_efficient": ("💾 Most Memory Efficient", 2, " MB"),
}
METRICS = ("train_time_sec", "inference_time_sec", "accuracy", "memory_usage_mb")
OPTIONAL_METRICS = ("cpu_usage_percent", "peak_memory_mb")
HEADINGS = ("Library", "Algorithm", "Training (s)", "Inference (s)", "Accuracy", "Memory (MB)")
OPTIONAL_HEADINGS = ("CPU (%)", "Peak Memory (MB)")


def standardise(results: DataFrame, more_names: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``algorithm`` and ``category`` to result records; ``more_names`` adds to the standard names."""
    named = lookup(results, "model", {**ALGORITHM_NAMES, **(more_names or {})}, "algorithm")
    return lookup(named, "algorithm", CATEGORIES, "category", "Other")


def analyse(
    results: DataFrame, digits: int = 6, more_names: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Standardised records, and their statistics by library and algorithm."""
    named = standardise(results, more_names)
    return named, group_stats(named, ["library", "algorithm"], METRICS, digits=digits, optional=OPTIONAL_METRICS)


def report_cells(stats: DataFrame) -> list[Column]:
    """The cells of one report row; resource cells only where the columns exist."""
    cells = [
        F.col("library"),
        F.col("algorithm"),
        fmt_mean_std(F.col("train_time_sec_mean"), F.col("train_time_sec_std"), 6),
        fmt_mean_std(F.col("inference_time_sec_mean"), F.col("inference_time_sec_std"), 6),
        fmt_mean_std(F.col("accuracy_mean"), F.col("accuracy_std"), 4),
        fixed(F.col("memory_usage_mb_mean"), 2),
    ]
    for m in OPTIONAL_METRICS:
        if f"{m}_mean" in stats.columns:
            cells.append(fixed(F.col(f"{m}_mean"), 2))
    return cells


def table_row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def report_rows(stats: DataFrame) -> DataFrame:
    """``category, library, algorithm, line``: one table row per group."""
    filed = lookup(stats, "algorithm", CATEGORIES, "category", "Other")
    return filed.select("category", "library", "algorithm", table_row(report_cells(stats)).alias("line"))


def report_document(profile: DataFrame, stats: DataFrame, name: str, stamp: Column | None = None) -> DataFrame:
    """The whole report as ordered lines ``(section, place, line)``.

    ``stamp`` is the time it names, by default now.

    ``section`` and ``place`` sort the document; groups of runs are few, so the
    ordered lines may be written by one task.
    """
    spark = stats.sparkSession
    title = spark.createDataFrame([(name,)], "name string").select(
        F.lit("0").alias("section"), F.lit("").alias("place"),
        F.concat(F.lit("# ML Benchmark Report: "), title_case(F.col("name"))).alias("line"),
    )
    facts = profile.select(
        F.lit("1").alias("section"),
        F.posexplode(
            F.array(
                F.lit("## Dataset Information"),
                F.concat(F.lit(f"- **Name**: {name}")),
                F.concat(F.lit("- **Size**: "), "size_category", F.lit(" ("), thousands(F.col("n_samples")), F.lit(" samples)")),
                F.concat(F.lit("- **Features**: "), F.col("n_features").cast("string")),
                F.concat(F.lit("- **Classes**: "), F.col("n_classes").cast("string")),
                F.concat(F.lit("- **Timestamp**: "), long_stamp(F.current_timestamp() if stamp is None else stamp)),
            )
        ).alias("pos", "line"),
    ).select("section", F.col("pos").cast("string").alias("place"), "line")

    rows = report_rows(stats)
    extra = [h for h, m in zip(OPTIONAL_HEADINGS, OPTIONAL_METRICS) if f"{m}_mean" in stats.columns]
    heads = [*HEADINGS, *extra]
    header = "| " + " | ".join(heads) + " |"
    rule = "|" + "|".join("-" * (len(h) + 2) for h in heads) + "|"
    section = F.concat(F.lit("2:"), "category").alias("section")
    tops = rows.select("category").distinct().select(
        section,
        F.posexplode(F.array(F.concat(F.lit("## "), "category"), F.lit(header), F.lit(rule))).alias("pos", "line"),
    ).select("section", F.concat(F.lit("0"), F.col("pos").cast("string")).alias("place"), "line")
    body = rows.select(section, F.concat(F.lit("1:"), "library", F.lit(":"), "algorithm").alias("place"), "line")

    value, place, text = F.col("value"), F.lit(None), F.lit(None)
    for n, (objective, (heading, digits, unit)) in enumerate(CHAMPION_LINES.items(), 1):
        mine = F.col("objective") == objective
        place = F.when(mine, F.lit(str(n))).otherwise(place)
        head = F.concat(F.lit(f"- **{heading}**: "), "algorithm", F.lit(" ("), "library", F.lit(") - "))
        text = F.when(mine, F.concat(head, fixed(value, digits), F.lit(unit))).otherwise(text)
    winners = champions(stats, OBJECTIVES, ["library", "algorithm"]).select(
        F.lit("3").alias("section"), place.cast("string").alias("place"), text.alias("line")
    )
    crown = spark.createDataFrame([("3", "0", "## Performance Champions")], "section string, place string, line string")
    whole = title
    for part in (facts, tops, body, crown, winners):
        whole = whole.unionByName(part)
    return whole.orderBy("section", "place")
