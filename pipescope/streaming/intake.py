"""Streaming run log: append events, keep the latest state, deduplicate results, count statuses.

Every sink here is a folder in the shared directory written per micro-batch under its batch number, so
a batch that is run again after a failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.operators.experiments import latest_state
from pipescope.session import scratch_path

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """Run events (event_id, event_ts, hash, seed, status) from event files as they arrive."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return as_run_events(reader.parquet(folder))


def as_run_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("event_ts"),
        F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("hash"),
        F.col("user_id").alias("seed"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )


def run_to_end(stream: DataFrame, name: str, mode: str = "append",
               each: Callable[[DataFrame], DataFrame] = lambda batch: batch, folder: str | None = None) -> DataFrame:
    """Process everything available; returns the batches written, tagged with `batch_id`.

    `folder` keeps the batches and the state of the stream between runs: a later call with the same folder goes
    on where the last one ended, also after a driver was lost. Without it a new folder is used once.
    """
    spark = stream.sparkSession
    base = folder.rstrip("/") if folder else scratch_path(spark, name)
    target, state = f"{base}/{name}", f"{base}/{name}_state"
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema.add("batch_id", T.LongType())).parquet(target)


def upsert_log(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Append run events batch by batch (one row per hash and batch), read as the state per hash."""
    written = run_to_end(stream, "run_log", each=latest_state, folder=folder)
    return latest_state(written).drop("batch_id")


def first_per_hash(stream: DataFrame, delay: str = "1 hour", folder: str | None = None) -> DataFrame:
    """At most one result per configuration hash within the watermark delay."""
    unique = stream.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["hash"])
    return run_to_end(unique, "unique_results", folder=folder)


def status_counts(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Running counts per (seed, status): updates are written per batch, the newest one counts."""
    counts = stream.groupBy("seed", "status").agg(F.count(F.lit(1)).alias("n"))
    written = run_to_end(counts, "status_counts", mode="update", folder=folder)
    return written.groupBy("seed", "status").agg(F.max_by("n", "batch_id").alias("n"))
