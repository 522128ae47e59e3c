"""Shared helpers of the text operators: durable cut points, bounded batches, joins with hot keys, folds."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a frame of a few narrow columns is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Parts into which the rows of one key are dealt where a key may be hot.
SALTS = 64
_scratch: list[list[str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of its own only in local mode.

    Raises where executors run on other machines and no shared folder is named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(named or f"/tmp/checkpoints/quillboard-{uuid.uuid4().hex[:12]}")
        have = spark.sparkContext.getCheckpointDir()
    return named or have


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    if _scratch:
        file = written._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            _scratch[-1].append(file.get())
    return written


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what `cut` wrote inside: for work whose result is written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def maybe_broadcast(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Broadcast a frame whose row count was measured and is small; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def join_hot(df: DataFrame, few: DataFrame, key: str, by: str | list[str], rows: int, how: str = "inner") -> DataFrame:
    """`df` joined with `few`, one row for each key, where a key of `df` may be hot.

    A measured small `few` is broadcast. Otherwise the rows of each key are dealt into SALTS parts by a
    hash of the columns `by`, and `few` is sent to each part.
    """
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(few), key, how)
    salt = "__qb_salt"
    left = df.withColumn(salt, F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(SALTS)).cast("int"))
    right = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, salt], how).drop(salt)


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose values of one column (text, bytes or lists) take about `most_bytes`.

    A single longer value is a slice of its own. Who iterates should drop a slice before the next: each keeps
    its whole batch alive.
    """
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        values = batch.column(column)
        if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
            sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False) * 8
        else:
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, values


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_fold(id_column: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % F.lit(buckets), F.lit(0).cast("bigint"))
