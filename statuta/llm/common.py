"""Helpers that the corpus operators share: tables in the shared folder, words, stable ids."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from statuta.common import drop_path, drop_stashes, fresh_path, internal, scratch, shared_dir, small, stash  # noqa: F401  shared with the rest of the engine

#: The words of every contract: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of at most `rows` rows for the session's Python workers: Spark's 10,000 whole texts, with what is made of them, fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def give_back() -> None:
    """Free memory of a Python worker goes back to the machine; workers live on and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without the call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
