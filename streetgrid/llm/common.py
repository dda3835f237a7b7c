"""Shared helpers: shared-folder checkpoints and column-wise work on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.shared import cut, new_path, shared_dir

__all__ = ["cut", "cut_clean", "new_path", "shared_dir"]

#: Spark's setting by which shuffle files go when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Python holds at once; whole texts are long, so few.
SLICE_ROWS = 256
#: A slice is cut earlier when its strings reach this many bytes.
SLICE_BYTES = 8 << 20


def cut_clean(df: DataFrame) -> DataFrame:
    """As ``cut``; the shuffle files behind the rows go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        # A plan of its own, which takes the setting and is run once.
        return cut(df.select("*"))
    finally:
        conf.set(CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of bounded rows and, single long rows aside, bounded bytes."""
    start, total = 0, batch.num_rows
    while start < total:
        rows = min(SLICE_ROWS, total - start)
        while rows > 1 and batch.slice(start, rows).get_total_buffer_size() and _bytes(batch, start, rows) > SLICE_BYTES:
            rows //= 2
        yield batch.slice(start, rows)
        start += rows


def _bytes(batch: pa.RecordBatch, start: int, rows: int) -> int:
    return sum(c.slice(start, rows).nbytes for c in batch.columns)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., list]],
    inputs: list[str],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole Arrow columns.

    ``make()`` runs once in each task and returns a function of the input columns (Arrow arrays) that returns one array
    for each of ``fields``. Columns of ``keep`` (default: all) stay; one of the same name as a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    needed = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        names = [*kept, *(f.name for f in fields)]
        for batch in batches:
            for part in slices(batch):
                made = work(*(part.column(needed.index(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(part.column(needed.index(c)) for c in kept), *made], names=names)
        del work
        release()

    return df.select(*(df[c] for c in needed)).mapInArrow(run, schema)


def release() -> None:
    """Give free memory back to the system: Python's workers live on after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def lists(parts: list[bytes], dtype: pa.DataType, width: int) -> pa.ListArray:
    """A list column whose rows are given as raw little-endian values."""
    offsets, at = [0], 0
    for p in parts:
        at += len(p) // width
        offsets.append(at)
    values = pa.Array.from_buffers(dtype, at, [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
