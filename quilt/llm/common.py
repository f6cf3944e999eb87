"""Tables, columns and Arrow batching for the corpus operators; what is written in between goes through the store."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.operators.store import cut as materialise
from quilt.operators.store import discard, new_path

__all__ = ["WORD", "by_bytes", "discard", "kept", "lean", "materialise", "new_path", "picked", "table"]

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What a Python worker keeps between tasks, under one key at a time.
_kept: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names; other columns, whatever their names, stay out of the way."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about ``limit`` bytes of text each; one longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def kept(key: Hashable, make: Callable):
    """make(), kept between a worker's tasks until it works under another key or on a lean function."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _let_go() -> None:
    """Drop what the worker keeps. A function of its own: one that is sent to workers gets a copy of the module's dictionary."""
    _kept.clear()


def _give_back() -> None:
    """Return freed memory to the system: Arrow's pool and, with glibc, the C heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda n: 0)(0)


def lean(run: Callable) -> Callable:
    """run, a function of batches that needs its worker's memory: what the worker keeps goes first, what run frees is given back after it."""

    @wraps(run)
    def alone(batches):
        _let_go()
        _give_back()
        yield from run(batches)
        _give_back()

    return alone
