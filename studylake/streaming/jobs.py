"""Jobs on arriving data: new study rows, idle sessions, landed documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from studylake.sources.sinks import append_new

IDLE = "6 hours"


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they land in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_append_new(rows: DataFrame, target: str, checkpoint: str, key: str = "alias", first_by: Sequence[str] = ()) -> DataStreamWriter:
    """Appends rows with unseen keys from each batch, of one key's rows in a batch the first by ``first_by``. The stored
    table decides what is new, so a batch that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, target, key, first_by=first_by)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def last_activity(events: DataFrame, now: str, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """``(key, last_ts, expired)``: newest event per key, and whether it is older than ``gap`` at
    ``now``. The maximum combines map-side, so hot keys are cheap."""
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"interval {gap}")
    return events.groupBy(key).agg(F.max(ts).alias("last_ts")).withColumn("expired", F.col("last_ts") < limit)


def session_slices(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """``(key, slice, first, last, events)``: events of a key in one slice of time as long as the gap. Two events of a slice
    are closer than the gap, so a slice belongs to one session, whatever its events are. Slices combine map-side and
    may be merged again with :func:`merge_slices`; a hot key is as many groups as it has slices."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = F.floor(at / F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00Z' + interval {gap})"))
    timed = events.where(F.col(ts).isNotNull()).select(key, cut.alias("slice"), F.col(ts).cast("timestamp").alias("_t"))
    return timed.groupBy(key, "slice").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("events"))


def merge_slices(slices: DataFrame, key: str = "user_id") -> DataFrame:
    """Slices of several batches put together."""
    return slices.groupBy(key, "slice").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))


def sessions_of(slices: DataFrame, key: str = "user_id", gap: str = IDLE, now: Column | None = None) -> DataFrame:
    """``(key, started, ended, events, open)`` out of merged slices: a slice opens a session where it begins ``gap`` or
    more after the one before it. ``open`` tells that the session may still grow at ``now`` (default: the newest event)."""
    pause = F.expr(f"interval {gap}")
    places = Window.partitionBy(key).orderBy("slice")
    before = F.lag("last").over(places)
    fresh = F.when(before.isNull() | (F.col("first") >= before + pause), 1).otherwise(0)
    numbered = slices.withColumn("_fresh", fresh).withColumn("_n", F.sum("_fresh").over(places))
    sessions = numbered.groupBy(key, "_n").agg(F.min("first").alias("started"), (F.max("last") + pause).alias("ended"), F.sum("events").alias("events"))
    until = slices.agg(F.max("last")).scalar() if now is None else now
    return sessions.select(key, "started", "ended", "events", (F.col("ended") > until).alias("open"))


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """``(key, started, ended, events)`` of sessions: runs of events closer than ``gap``."""
    slices = session_slices(events, key, ts, gap)
    return sessions_of(slices, key, gap, F.lit(None).cast("timestamp")).drop("open")


def stream_sessions(events: DataFrame, target: str, checkpoint: str, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataStreamWriter:
    """Keeps the slices of arriving events at ``target``, a partition a batch; a batch that is run again replaces its
    partition. No event is ever too late, and sessions that are open at the end are there too: :func:`stored_sessions`
    puts them together."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session_slices(batch, key, ts, gap).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stored_sessions(spark: SparkSession, target: str, key: str = "user_id", gap: str = IDLE, now: Column | None = None) -> DataFrame:
    """``(key, started, ended, events, open)`` of all batches so far."""
    return sessions_of(merge_slices(spark.read.parquet(target), key), key, gap, now)


def stream_documents(
    docs: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> DataStreamWriter:
    """Runs a document job on each batch of landed documents. Whole documents arrive in a batch, so
    the job may use ordered windows. Each batch goes to its own partition and replaces it when it
    is run again, so that a restart leaves no row twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
