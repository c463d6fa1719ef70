"""Arrow batches inside tasks: bounded slices, added columns, a memo per worker process."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

SLICE_BYTES = 2 << 20


def memo(key, make: Callable):
    """``make()`` once per worker process, also across tasks.

    Functions of this package travel by value, so a module's globals last for one
    task only; tables and caches that are dear to build hang on a module of their own.
    """
    store = sys.modules.setdefault("fitgrid_worker_memo", types.ModuleType("fitgrid_worker_memo")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the column's bytes stay below ``limit``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, floor + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that would clash with the names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def add_columns(
    df: DataFrame, column: str, kernel: Callable[[list], list[pa.Array]], added: T.StructType, limit: int = SLICE_BYTES
) -> DataFrame:
    """Add the columns that ``kernel`` computes from the values of ``column``.

    ``kernel`` gets a bounded list of values (nulls included) and returns one Arrow
    array per added field. Every other column passes through; a column with the
    name of an added one is replaced.
    """
    df = without(df, added.names)
    keep = df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                found = kernel(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays(part.columns + found, names=keep + added.names)

    return df.mapInArrow(run, T.StructType(df.schema.fields + added.fields))


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by columns that were dear to compute.

    A plain filter is moved below the projections that made its columns, which are then
    computed once for the filter and once more for the result. A task's number is no fixed value
    to the optimiser, so a condition on it stays where it is.
    """
    placed = df.withColumn("_task", F.spark_partition_id())
    return placed.filter(condition & (F.col("_task") >= 0)).select(*df.columns)
