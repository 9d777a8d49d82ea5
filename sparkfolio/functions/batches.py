"""Arrow batches of bounded size, whatever the length of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that an operator works on at a time; its arrays take many times as much.
SLICE = 1 << 20
#: Bounds on what stands in a Python worker and its queue at a time, where the session has no settings of its own.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def small_batches(spark: SparkSession) -> None:
    for key in BATCHES.keys() - dict(spark.conf.getAll).keys():
        spark.conf.set(key, BATCHES[key])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` has about ``limit`` bytes at most (a longer text comes alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < len(size):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` over the batches of a task, after which the worker gives the memory it no longer needs back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
