"""Structured Streaming front end: totals, windows with late data, and idempotent appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.session import ensure_checkpoint_dir
from corvina.sources.tables import path_kind


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of a Parquet table as it grows; the schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    folder, _, name = (path, "", "") if path_kind(spark, path) == "folder" else path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if folder != path:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def type_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as an instant, as watermarks need it."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windows(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts per type in tumbling windows of event time; rows later than ``late`` are left out, none without it."""
    timed = with_time(events)
    return (
        (timed.withWatermark("ts", late) if late else timed)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "event_type", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: a gap without events ends one."""
    return (
        with_time(events)
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def first_seen(stream: DataFrame, keys: list[str], time: str, keep_for: str) -> DataFrame:
    """The first row of each key within ``keep_for``; state older than that is dropped."""
    return with_time(stream, time).withWatermark(time, keep_for).dropDuplicatesWithinWatermark(keys)


def append_new(stream: DataFrame, target: str, key: str, order: list, checkpoint: str, done: Callable[[], None] | None = None):
    """Starts a query that appends rows whose key the Parquet table ``target`` lacks, once per key; a repeated batch adds nothing."""
    from corvina.operators.ranking import append_once

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(target) if path_kind(spark, target) else batch.limit(0)
        append_once(old, batch, key, order).write.mode("append").parquet(target)
        if done:
            done()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives until its present input is used up, from an in-memory table of the driver.

    For aggregates that are small; a large result belongs in a table of its own.
    """
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark)}/{name}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def windowed_counts(spark: SparkSession, path: str) -> DataFrame:
    """Whole counts of each window once, however many files and batches there are: all state is kept, as no row is too late."""
    return drained(windows(event_stream(spark, path), late=None), "complete")
