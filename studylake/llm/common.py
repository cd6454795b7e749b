"""What the operators share: stored intermediates and small column helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.functions.stage import remove_stored, stage_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Stored(NamedTuple):
    """An intermediate table in the shared folder: survives lost executors, has a known size, so
    that Spark itself decides between a broadcast and a shuffled join when it is read back."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Frees the files; only after every job that reads them has ended."""
        remove_stored(self.df.sparkSession, self.path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs started inside pass at most ``rows`` rows at once to Python, so that long texts need little memory."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def store(df: DataFrame) -> Stored:
    spark, path = df.sparkSession, stage_path(df.sparkSession)
    with small_batches(spark):
        df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


NAMED_ROWS = 500_000  # at most so many rows of up to three longs are broadcast


def named(rows: DataFrame) -> DataFrame:
    """``rows`` stored, with a broadcast hint if their count allows it; else joins with them are shuffled."""
    kept = store(rows).df
    return F.broadcast(kept) if kept.count() <= NAMED_ROWS else kept


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (one column); rows without doc_id stay."""
    name = unused(docs, "gone")
    gone = named(gone.toDF(name).filter(F.col(name).isNotNull()).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def partitions_of(df: DataFrame) -> int:
    """Number of input partitions by the plan; no job runs."""
    return max(1, df.rdd.getNumPartitions())


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(rows: Rows) -> Rows:
    """``rows`` for ``mapInArrow``; a task gives the memory it has freed back to the system, so that a worker
    process that later stages use again starts small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run
