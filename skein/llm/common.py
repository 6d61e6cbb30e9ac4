"""Pieces shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.lineage import cut, release, remove, shared_folder

__all__ = ["cut", "release", "remove", "shared_folder", "table", "small_batches", "pieces", "join_ids", "crc32_of_id", "resident", "Interned", "offsets"]

#: Rows of text handed to Python at once.  Long texts are bounded by bytes too.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches to at most ``rows`` rows and about BATCH_BYTES bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = int(max(1, min(rows, BATCH_BYTES // per_row)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Ids that may be sent to every executor (some 24 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000


def join_ids(rows: DataFrame, ids: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of ids and little else, sent to all executors if it is counted to be small.

    ``ids`` is read twice: write it down first.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, keys, how)


def crc32_of_id(col: str = "doc_id"):
    """Unsigned crc32 of the id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


_RESIDENT: dict = {}


def give_back() -> None:
    """Return freed memory to the system, which else stays with this worker for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def resident(key: tuple, make):
    """What ``make`` builds, kept in this Python worker for later tasks; one thing at a time, so memory stays bounded."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


#: Longer words are computed anew each time, so that the bytes remembered are bounded too.
LONGEST_KEPT = 128


class Interned(dict):
    """word -> value, computed by ``make`` on first sight, emptied when it grows
    beyond ``most`` entries (call ``trim`` between batches)."""

    def __init__(self, make, most: int = 150_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def offsets(lengths) -> np.ndarray:
    """Start of each run when runs of these lengths lie end to end (n+1 values)."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
