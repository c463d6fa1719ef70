"""Sum of one small numeric block per partition, merged in two levels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

DIRECT = 16


def rows_as_matrix(column: pa.Array) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def partition_sums(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], partitions: int, rows: int | None = None) -> np.ndarray:
    """Add up ``block(batch)`` over all rows of ``df``.

    ``rows`` is the most that ``block`` gets at once; None: whatever Spark sends together.
    Tasks keep one running block each and emit it once. With many partitions the
    blocks are added in groups of about the square root of their number first,
    so neither one task nor the driver receives them all.
    """

    def partial(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows or batch.num_rows or 1):
                part = block(batch.slice(at, rows))
                total = part if total is None else total + part
        if total is not None:
            place = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["place", "block"]
            )

    parts = df.mapInArrow(partial, "place int, block array<double>")
    if partitions > DIRECT:
        vectors = parts.select("place", array_to_vector("block").alias("v"))
        fan = math.ceil(math.sqrt(partitions))
        grouped = vectors.groupBy(F.pmod("place", F.lit(fan))).agg(Summarizer.sum(F.col("v")).alias("v"))
        parts = grouped.agg(Summarizer.sum(F.col("v")).alias("v")).select(vector_to_array("v").alias("block"))
    return np.sum([np.asarray(r["block"]) for r in parts.select("block").collect()], axis=0)
