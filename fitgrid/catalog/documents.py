"""Numeric features of whole texts, for the model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.joins import fits_broadcast
from .base import table

QUALITY_FEATURES = ["unique_share", "letter_share", "space_share", "log_chars"]
# Letters whose shares tell the four languages apart.
LETTERS = {
    "w": "w", "h": "h", "u_umlaut": "ü", "o_umlaut": "ö", "e_acute": "é", "e_circumflex": "ê", "n_tilde": "ñ", "a_acute": "á",
}
LANGUAGES = ["de", "en", "es", "fr"]


def share(text, letter: str, size):
    """Share of one character; replacing a literal is the cheapest way to count it."""
    return (size - F.length(F.replace(text, F.lit(letter), F.lit("")))) / size


def quality_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    text = F.col("text")
    words = F.split(F.lower(F.trim(text)), r"\s+")
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    return docs.select(
        *keep,
        (F.size(F.array_distinct(words)) / F.size(words).cast("double")).alias("unique_share"),
        (F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / size).alias("letter_share"),
        share(text, " ", size).alias("space_share"),
        F.log(size).alias("log_chars"),
    )


def quality_table(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their features; ``label`` is the quality class.

    Texts are never shuffled: few labels go to the texts, many meet the features.
    """
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    if fits_broadcast(labels):
        return quality_features(docs.join(F.broadcast(labels), "doc_id"), ("doc_id", "label"))
    return quality_features(docs).join(labels, "doc_id")


def language_table(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with letter shares; ``label`` numbers the languages in order."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    text = F.lower("text")
    size = F.greatest(F.length("text"), F.lit(1)).cast("double")
    code = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")) - 1
    return docs.select(
        "doc_id",
        *[share(text, letter, size).alias(f"share_{name}") for name, letter in LETTERS.items()],
        code.cast("int").alias("label"),
    )


LANGUAGE_FEATURES = [f"share_{name}" for name in LETTERS]
