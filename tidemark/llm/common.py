"""Shared pieces of the training-data operators: shared storage, word rules, size-checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast once it has been counted; larger sides are joined by a shuffle.
BROADCAST_ROWS = 20_000


def materialize(df: DataFrame, kind: str = "table", *, one_file: bool = False) -> DataFrame:
    """Write a (narrow) result to the shared folder and read it back: it cuts the lineage and survives lost executors.

    one_file: for tables of a row a file or task, which pass through one last small task.
    """
    df = df.repartition(1) if one_file else df
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side that was counted and found small; otherwise leave the join to a shuffle that AQE may split."""
    return F.broadcast(df) if rows <= limit else df


def column(name: str) -> Column:
    """A column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], kind: str) -> DataFrame:
    """df with running sums over all its rows in an order that has no ties, each row's own value included.

    Rows are dealt by ranges of the order and written; a window inside each range adds to the sums of the ranges before it,
    a table of one row for each range. No task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.withColumns({f"__v_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), kind)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    ranges = dealt.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__v_{k}") for k in sums])
    offsets = ranges.select(F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return out.select(*df.columns, *[(F.col(f"__b_{k}") + F.sum(f"__v_{k}").over(inside)).alias(k) for k in sums])


def open_output(uri: str):
    """A binary stream on the shared storage (file, hdfs, s3, gs URIs that Arrow knows)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable binary stream on the shared storage."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def tidy(batches: Iterator) -> Iterator:
    """The batches; afterwards memory that is free goes back to the system, as workers live on between stages."""
    yield from batches
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_parts(batches: Iterator, rows: int, size_column: str, most_bytes: int) -> Iterator:
    """Arrow batches cut so that each holds at most `rows` rows and about `most_bytes` of one column, one row at least."""
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index(size_column))
        total = batch.num_rows
        while at < total:
            n = min(rows, total - at)
            while n > 1 and column.slice(at, n).nbytes > most_bytes:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n
