"""Helpers of the training-data operators: durable intermediate tables and Arrow slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return memory that a Python worker holds but does not use, as idle workers stay for a while."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs on one machine, a local folder is set instead.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def bounded_batches(spark: SparkSession, size: str = "2m") -> None:
    """Have Spark hand texts to Python in batches of about size, so a worker holds little at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def durable_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tapeloom/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = durable_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def discard(*frames: DataFrame) -> None:
    """Remove the files behind frames that durable() made, when nothing reads them any more."""
    for df in frames:
        if where := df.__dict__.get("_durable_path"):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def byte_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column holds about limit bytes in each; a longer value goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = size = 0
        for row, n in enumerate(sizes):
            if row > start and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        yield batch.slice(start)
    give_back()


def crc32_of(column: str | F.Column) -> F.Column:
    """crc32 of a column's text, as the splits into learnt and held-out rows use it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary"))


def spread_int(columns: list, buckets: int) -> F.Column:
    """A stable bucket of 0..buckets-1 for a row."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of complete groups, and where the groups begin and end in them.

    batches must be sorted by key (an integer), as repartition(key).sortWithinPartitions(key) does.
    """

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = table.column(key).to_numpy()
        return table, [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield cut(held)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield cut([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield cut(held)
    held = []
    give_back()
