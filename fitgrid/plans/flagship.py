"""The whole path on one table: features, split, scaling, two models, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..models.classify import REGISTRY
from ..operators.stats import group_stats
from .evaluation import run_results
from .report import ALGORITHM_NAMES, CATEGORIES
from ..operators.features import lookup


def flagship(spark: SparkSession, sf: str, seeds=(0, 1)) -> DataFrame:
    """Hold-out quality of a linear machine and a tree on document quality."""
    from ..catalog.documents import QUALITY_FEATURES, quality_table

    docs = quality_table(spark, sf)
    runs = None
    for name in ("LinearSVC", "DecisionTreeClassifier"):
        mine = run_results(docs, "doc_id", QUALITY_FEATURES, "label", REGISTRY[name], seeds)
        runs = mine if runs is None else runs.unionByName(mine)
    named = lookup(runs, "algorithm", ALGORITHM_NAMES, "name")
    named = lookup(named, "name", CATEGORIES, "category", "Other").withColumn("library", F.lit("fitgrid"))
    return group_stats(
        named, ["library", "category", "name"], ["accuracy", "balanced_accuracy"], count="runs"
    ).orderBy("name")
