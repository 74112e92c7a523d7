"""Shared tables, Arrow batch sizes and key-run iteration for the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship

#: Bytes handed to a Python worker at once, and rows worked on together: they bound a worker's memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000

_open = threading.local()


def prepare(spark: SparkSession) -> None:
    """Make this package known to Python workers and bound the bytes of an Arrow batch: the same for every operator, as
    results are lazy and share the session."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in the block go when it ends; what it returns has to be written with keep."""
    outer = getattr(_open, "paths", None)
    _open.paths = own = []
    try:
        yield
    finally:
        _open.paths = outer
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_table(df: DataFrame, name: str, outer: list | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from committed files.

    The files go with the scratch block they are written in, or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridcast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths = getattr(_open, "paths", None) if outer is None else outer
    if paths is not None:
        paths.append(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def around() -> list:
    """The tables of the scratch block that is open now, for write_table(..., outer) from blocks within; a list that
    nothing deletes where none is."""
    paths = getattr(_open, "paths", None)
    return [] if paths is None else paths


def _give_back() -> None:
    """Return freed memory to the system: an idle worker stays beside the JVM in the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function for mapInArrow, with the worker's memory given back when a task ends."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return ended


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null gives no bytes."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut sorted batches at key changes: yields tables of whole runs and the run starts (with the end) in each.

    A run longer than a batch is gathered before it is yielded, so callers split hot keys beforehand.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        n = table.num_rows
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(change), n)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
        held = table.slice(at[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)
