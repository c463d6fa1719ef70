"""Labelled tables in delimited text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class LabelledTable:
    frame: DataFrame
    target: str


def read_labelled_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", target: str | None = None
) -> LabelledTable:
    """Every row of a delimited file with a header; the last column is the target.

    The schema is explicit, so the files are read once and lines can be split
    over tasks. Column names with dots come back with underscores.
    """
    frame = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", STAMP)
        .schema(schema)
        .csv(path)
    )
    frame = frame.toDF(*[c.replace(".", "_") for c in frame.columns])
    return LabelledTable(frame, (target or frame.columns[-1]).replace(".", "_"))


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    (
        df.write.option("header", True)
        .option("sep", sep)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("timestampNTZFormat", STAMP)
        .csv(path)
    )


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of a parquet table that is one file or a folder of files.

    The file source takes a single file only from a pattern, hence the brackets.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
