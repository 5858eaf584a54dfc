"""Helpers shared by the corpus operators: shared storage, Arrow buffers and grouped batches."""

from __future__ import annotations

import atexit
import contextvars
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a vectorised step holds at a time; its temporary arrays are some 40 times this.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch in steps that write a table.
BATCH_ROWS = 2000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="halyard-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def written() -> list[str]:
    """Folders that ``materialize`` has written in this context (a thread has its own) and nobody has deleted."""
    if (mine := _written.get()) is None:
        _written.set(mine := [])
    return mine


def materialize(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, bucket_by: str | None = None, split_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive executors.

    Arrow batches of Python steps hold at most ``batch_rows`` meanwhile; the session's setting is put back.  With ``bucket_by``
    (and folders by ``split_by``) later joins on that column needn't move the table; that is for tasks that write few, large rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/halyard-{name}-{uuid.uuid4().hex}"
    own = path.rpartition("/")[2].replace("-", "_")
    before = spark.conf.get(BATCH_KEY)
    if not 0 < int(before) <= batch_rows:
        spark.conf.set(BATCH_KEY, batch_rows)
    written().append(path)
    try:
        if bucket_by:
            df.write.format("parquet").option("path", path).partitionBy(split_by).bucketBy(partitions(spark), bucket_by).saveAsTable(own)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, before)
    out = spark.table(own).select(df.columns) if bucket_by else spark.read.schema(df.schema).parquet(path)
    out._halyard_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames from ``materialize`` that no later plan will read, and shuffle files of plans that are gone."""
    for df in frames:
        delete(df.sparkSession, df._halyard_path)
    if frames:
        collect_garbage(frames[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Spark removes the shuffle files of a plan when the driver's objects for it are collected."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    if path in written():
        spark.sql(f"DROP TABLE IF EXISTS {path.rpartition('/')[2].replace('-', '_')}")  # of those with buckets
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in written():
        written().remove(path)


def clean_up(spark: SparkSession) -> None:
    """Delete what operators called in this context have left, once their results have been written or are not wanted any more."""
    for path in list(written()):
        delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of the packed shuffles: the session's setting, which is sized with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory that a finished task used back to the system; Python workers stay and would hold it.

    No garbage is collected here: that would touch, and so copy, what workers share with the process they come from.
    """
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_libc, "malloc_trim", None)) is not None:  # of glibc
        trim(0)


def releasing(run):
    """A batch function that gives its memory back when its task ends."""

    @functools.wraps(run)
    def whole_task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole_task


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows, from 0) of a string or binary array; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``most`` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``least`` rows or more but for the last, from rows sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = last_group_start(whole, key)
        if cut:
            yield whole.slice(0, cut)
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
        least = max(least, 1)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def last_group_start(whole: pa.Table, key: list[str]) -> int:
    """Row at which the last group of a table sorted by ``key`` begins (binary search by equality)."""
    last = [whole.column(k)[whole.num_rows - 1] for k in key]
    low, high = 0, whole.num_rows - 1
    while low < high:
        middle = (low + high) // 2
        if all(whole.column(k)[middle].as_py() == x.as_py() for k, x in zip(key, last, strict=True)):
            high = middle
        else:
            low = middle + 1
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), in place on uint64."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start..start+length-1 of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
