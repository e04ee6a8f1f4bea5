"""What Python workers keep and give back.

A worker process serves many tasks, one operator's after another's, and beside
it stands an executor whose heap is bounded.  ``lean`` wraps the function of a
task: what other operators left in the worker goes first, and freed memory
returns to the system when the task ends.  ``rested`` has the executors collect
their garbage, so that a stage does not begin with the heap, the generated
classes and the buffers that the stage before it has grown.  ``small_batches`` bounds the bytes of
the Arrow batches that a session sends to its workers, so that long texts do
not make large batches.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_kept: dict[tuple, object] = {}


def keep(key: tuple, make: Callable[[], object]) -> object:
    """An object that later tasks of the same operator find again."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library has no such call


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """keeps: first part of the keys that this operator's tasks share."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _kept if k[0] != keeps]:
            del _kept[key]
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def rested(spark: SparkSession) -> None:
    """A full collection in every executor, by a task for each core: memory that is free then returns to the system."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the bound of bytes for each Arrow batch to ``most``, unless it is lower."""
    now = spark.conf.get(_BYTES).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(_BYTES, str(most))
