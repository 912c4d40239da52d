"""What the operators share: tables written to the shared folder, process-wide caches, ids as text."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.store import new_path, written

__all__ = ["crc_mod", "new_path", "process_cache", "release", "slices", "table", "written"]

#: Rows that a Python worker makes results of at once.
SLICE_ROWS = 512


def process_cache(name: str) -> dict:
    """A dict that lives as long as this Python process: code pickled by value has fresh globals in each task."""
    return sys.__dict__.setdefault("_affinis_caches", {}).setdefault(name, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32 of an id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def release() -> None:
    """Gives freed memory back to the system: workers are used again by other stages, which have no use for it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches, rows: int = SLICE_ROWS):
    """The same rows in smaller batches without a copy, so that what is made of them stays small.

    For operators that keep nothing in the process: frees what other operators kept there, as a worker outlives its stage.
    """
    sys.__dict__.get("_affinis_caches", {}).clear()
    release()
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
