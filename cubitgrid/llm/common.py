"""What several operators share: reading, Arrow mapping, a worker's memory, labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubitgrid.plans.shipping import ship

#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over slices of Arrow batches, so that a worker holds SLICE_ROWS rows as Python objects."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what this worker no longer uses to the system: a worker lives through many tasks of many operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its free pages
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict = {}


def held(key, make: Callable):
    """What make() returns, kept in this worker until another key is asked for: one operator's memory at a time."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def held_out() -> "F.Column":
    """Fold 0 of 5 by the checksum of doc_id as text; a null id is in no training fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of the training fold: at most max_rows labelled rows, those with the smallest hash of
    doc_id. Repeated ids count once, with the larger label; null labels and ids are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows rows of 12 bytes: small enough to broadcast
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
