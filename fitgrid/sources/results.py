"""Result records as JSON: one array per file, one record per line, nested reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .tables import STAMP

DOCUMENT_BYTES = 64 << 20


def read_results(
    spark: SparkSession, path: str, lines: bool = True, schema: T.StructType | str | None = None
) -> DataFrame:
    """Records from JSON lines, or from files that each hold one array or object.

    With a schema nothing is inferred; fields a record lacks are null. Lines can
    be split over tasks, whole documents cannot, so large sets belong in lines.
    """
    reader = spark.read.option("timestampNTZFormat", STAMP).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("multiLine", not lines).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """One record per line."""
    df.write.option("timestampNTZFormat", STAMP).json(path)


def write_result_arrays(df: DataFrame, path: str, key: str, document_bytes: int = DOCUMENT_BYTES) -> None:
    """Files that each hold one JSON array of about ``document_bytes``, in one folder.

    A document is one row of one task, so it has to fit into memory; their number follows the
    table's size as text. Records are dealt by their key and all their fields, so a frequent key
    is spread.
    """
    options = {"timestampNTZFormat": STAMP}
    record = F.to_json(F.struct(*df.columns), options)
    size = df.agg(F.sum(F.octet_length(record))).first()[0] or 0
    files = max(1, math.ceil(size / document_bytes))
    document = F.pmod(F.xxhash64(key, *df.columns), F.lit(files)).alias("document")
    arrays = df.groupBy(document).agg(F.to_json(F.collect_list(F.struct(*df.columns)), options).alias("value"))
    # every file has to hold a single row: one array is one document
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def flatten_report(df: DataFrame, struct_col: str) -> DataFrame:
    """The fields of the nested metric struct next to the outer columns."""
    outer = [c for c in df.columns if c != struct_col]
    inner = df.schema[struct_col].dataType.fieldNames()
    return df.select(*outer, *[F.col(f"{struct_col}.{f}").alias(f) for f in inner])
