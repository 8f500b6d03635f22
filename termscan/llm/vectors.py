"""Vectors of Arrow batches as numpy arrays, and sums over the tasks of a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL_SCHEMA = "task int, part int, total binary"
# Partial sums of one part that are added up together, before those of all tasks are.
FAN_IN = 256


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entries = vector.cast("array<double>")
    return vector.isNotNull() & F.coalesce(
        F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


def common_length(vectors: DataFrame, name: str) -> int:
    """The most frequent length (of equally frequent ones the largest), 0 without rows."""
    counts = vectors.groupBy(F.size(name).alias("length")).count()
    first = counts.orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, every list of ``width`` entries, as rows of doubles."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)


def binaries(rows: np.ndarray, dtype: str) -> pa.Array:
    """A binary value for each row of a matrix."""
    data = np.ascontiguousarray(rows.astype(dtype))
    ends = np.arange(len(data) + 1, dtype=np.int64) * (data.dtype.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def from_binaries(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The reverse of ``binaries``."""
    if not len(column) or not width:
        return np.zeros((len(column), width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def partial_rows(total: np.ndarray) -> pa.RecordBatch:
    """A task's matrix of sums as rows of ``PARTIAL_SCHEMA``, one per matrix row."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    columns = [pa.array(np.full(len(total), task, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), binaries(total, total.dtype.str)]
    return pa.record_batch(columns, names=["task", "part", "total"])


def summed(partial: DataFrame, rows: int, width: int, dtype: str) -> np.ndarray:
    """The sum of the tasks' matrices; only rows x width values reach the driver.

    Each matrix row is added up on its own, first within groups of ``FAN_IN``
    tasks and in the order of tasks, so the sum of floats does not depend on
    the order in which tasks end.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        total = np.zeros(width, dtype)
        for value in frame["total"]:
            total += np.frombuffer(value, dtype)
        return pd.DataFrame({"task": [frame["task"].min()], "part": [frame["part"].iloc[0]], "total": [total.tobytes()]}).astype(
            {"task": "int32", "part": "int32"}
        )

    few = partial.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("_group")).applyInPandas(add, PARTIAL_SCHEMA)
    out = np.zeros((rows, width), dtype)
    for row in few.groupBy("part").applyInPandas(add, PARTIAL_SCHEMA).collect():
        out[row["part"]] = np.frombuffer(row["total"], dtype)
    return out


def batches_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
