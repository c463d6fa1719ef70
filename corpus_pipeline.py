"""From raw documents to packed training sequences, in five written stages.

Each stage takes what the one before it wrote, decides about every row of it and returns the columns
of ``documents``; the last one returns the places of all pieces. Null texts are rejected by the first
stage, an empty table goes through as empty, and further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fitgrid.llm import langid, line_dedup, near_copies, packing, quality, simhash
from fitgrid.llm.batches import filter_computed
from fitgrid.llm.queries import PLAIN
from fitgrid.session import materialise


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator adds: columns of any name go through a stage."""
    return docs.toDF(*[f"_column{i}" for i in range(len(docs.columns))])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence."""
    held = aside(docs)
    text = held.columns[docs.columns.index("text")]
    found = langid.identify(held, langid.fit(docs), text)
    return found.filter(~F.col("rejected")).select(*held.columns).toDF(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like trusted text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = aside(docs)
    key, text = (held.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    trusted = quality.trusted_keys(labels, good="quality = 1 and toxic = 0").withColumnRenamed("doc_id", key)
    found = quality.assess(held, trusted, key, text)
    return filter_computed(found, F.col("kept")).select(*held.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of longer runs of lines; a document that was nothing else goes."""
    held = aside(docs)
    key, text = (held.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = line_dedup.dedup_lines(held, key, text)
    left = filter_computed(found, (F.col("n_deleted") == 0) | (line_dedup.word_count(F.col(text)) > 0))
    if "n_chars" in docs.columns:
        size = held.columns[docs.columns.index("n_chars")]
        changed = F.length(text).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn(size, F.when(F.col("n_deleted") > 0, changed).otherwise(F.col(size)))
    return left.select(*held.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: found by SimHash over shingles of five words, similarity 0.8 at least.

    Fingerprints are compared by ``simhash.links``, as in ``op10``; sets of shingles decide, and find the copies
    whose fingerprints are further apart.
    """
    held = aside(docs)
    key, text = (held.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    return near_copies.one_per_group(held, key, text, radius=simhash.RADIUS).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""

    def digest(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

    found = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(PLAIN), digest=digest, special=True)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: Tokenizing and training have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
