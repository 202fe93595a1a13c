"""Small helpers for Arrow batches of texts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 21

_until_written: list[list[Broadcast]] = []


def share(spark: SparkSession, value: Any) -> Broadcast:
    """``value`` as a broadcast, which Spark frees when no result that uses it is left.

    Within ``freed_when_left`` it is freed at the end of that.
    """
    sent = spark.sparkContext.broadcast(value)
    if _until_written:
        _until_written[-1].append(sent)
    return sent


@contextmanager
def freed_when_left() -> Iterator[None]:
    """Free what is shared meanwhile, on the driver and on all executors.

    Results that use it must have been written by then.
    """
    sent: list[Broadcast] = []
    _until_written.append(sent)
    try:
        yield
    finally:
        _until_written.pop()
        for one in sent:
            one.destroy()


def tidy_driver(spark: SparkSession) -> None:
    """Give back what finished jobs left on the driver: their plans, results and spare heap.

    A long session would otherwise keep all that until its heap is full.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def tidy_executors(spark: SparkSession) -> None:
    """Have the executors give back the heap that finished jobs left unused.

    Beside a heap that has grown to its limit there is little room for Python's arrays.
    """
    slots = spark.sparkContext.defaultParallelism
    collected = spark.range(0, slots, 1, slots).selectExpr("java_method('java.lang.System', 'gc') as done")
    collected.write.format("noop").mode("overwrite").save()


@contextmanager
def smaller_batches(spark: SparkSession, limit: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of about ``limit`` bytes, not 64 MB, in jobs that start meanwhile."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(limit))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and their n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if data is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces with about ``limit`` bytes in ``column``, one row at least."""
    if batch.num_rows:
        _, offsets = text_bytes(batch.column(column))
        for start, end in row_chunks(offsets, limit):
            yield batch.slice(start, end - start)


def aside(docs: DataFrame, used: Collection[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but those used renamed, and what renames them back.

    Columns that an operator adds can't clash with the renamed ones.  The way
    back returns the columns of ``docs`` and drops all others.
    """
    names = docs.columns
    moved = [n if n in used else f"__{i}" for i, n in enumerate(names)]

    def back(result: DataFrame) -> DataFrame:
        return result.select(*moved).toDF(*names)

    return docs.toDF(*moved), back
