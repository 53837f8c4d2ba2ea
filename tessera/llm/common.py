"""Shared helpers: tables in the cluster's shared folder, and Arrow batches cut by bytes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir


#: What a worker process keeps from task to task, by name. Tasks of other operators let go of it.
KEPT: dict[str, object] = {}


def trim() -> None:
    """Gives memory that is free back to the machine: worker processes live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def work_path(spark: SparkSession, tag: str, under: str | None = None) -> str:
    """A new path in the shared folder, never used twice. under: a path that it goes with."""
    return f"{under or shared_dir(spark) + '/tessera'}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back: the lineage ends there, and what is
    written outlives any executor."""
    path = path or work_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of finished jobs, which it does when the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices with about `max_bytes` of `column` each; a larger row stays whole. keeps: what the
    task uses of KEPT; the rest is let go."""
    if others := [n for n in KEPT if n != keeps]:
        for name in others:
            del KEPT[name]
        trim()
    yield from _cut(batches, column, max_bytes)
    trim()


def _cut(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        per_row = max(1, col.nbytes // n)
        if col.nbytes <= max_bytes:
            yield batch
            continue
        sizes = [len(x) if x is not None else 0 for x in col.to_pylist()] if per_row * 64 > max_bytes else None
        if sizes is None:
            step = max(1, max_bytes // per_row)
            for i in range(0, n, step):
                yield batch.slice(i, min(step, n - i))
            continue
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
