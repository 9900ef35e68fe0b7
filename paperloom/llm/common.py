"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, importable, materialize, shared_dir

__all__ = ["SPACES", "discard", "give_back", "giving_back", "importable", "materialize", "remainder", "shared_dir", "table"]

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java character class.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any file system works."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and malloc keep it for later, and a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def giving_back(batches: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``batches``, for mapInArrow, whose worker keeps no freed memory after the task: other stages have the rest of the executor."""

    def whole(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(source)
        give_back()

    return whole
