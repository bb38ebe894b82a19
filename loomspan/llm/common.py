"""Shared helpers of the training-data operators: Arrow batches, text buffers, durable tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.workspace import new_path

#: Text bytes that a Python worker handles at once; memory follows this, not the table.
SLICE_BYTES = 4 << 20
#: Rows of a record batch between the JVM and Python.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. The tables of a driver go when it ends."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that came from them is stored itself or has reached the driver."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_FOLDERS: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """This driver's folder in the shared one; it is deleted when Python ends, if Spark still runs then."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = folder = new_path(spark, app)

        def clear() -> None:
            with contextlib.suppress(Exception):  # a stopped session has nothing to delete with
                if spark.sparkContext._jsc is not None:
                    _delete(spark, folder)

        atexit.register(clear)
    return _FOLDERS[app]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(int(np.searchsorted(ends, base + limit, side="right")), at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    """Give free memory back to the system. Python workers live on from stage to stage, so what one stage has freed would count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, after which each task releases its memory. Batches are kept small, as the JVM and Python each hold one: the session's limit, read when the plan runs, is
    lowered to BATCH_ROWS where it is above."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(limit)) <= BATCH_ROWS:
        conf.set(limit, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def batch_of(**columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    heads = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(heads - starts, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads polynomial hashes over all bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
