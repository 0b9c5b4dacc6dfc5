"""The work queue as a stream: event logs folded to job states, polling times and branch states."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds of the polling schedule.
DEADLINE, EARLY, SOON, LATER = 300, 60, 2, 30


def fold(events: DataFrame) -> DataFrame:
    """State of each job from its whole log: events, attempts and the newest event (STM-01, STM-18). Combines before the shuffle."""
    newest = F.max(F.struct("at", "id", "type")).alias("newest")
    return events.groupBy("job").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "signup").alias("attempts"), newest).select("job", "events", "attempts", F.col("newest.at").alias("last_at"), F.col("newest.id").alias("last_id"), F.col("newest.type").alias("last_type"))


def fold_stream(events: DataFrame) -> DataFrame:
    """The same state, kept by Structured Streaming in update mode; a job is emitted whenever it changes.

    Events may come in any order: late ones count, but never displace a newer
    one (STM-05, STM-17).  State is one row a job; it must outlive any pause of the job, so it has no time-out.
    """

    return fold(events)


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Events by window and type, for batches and streams; ``at`` must be a timestamp with time zone."""
    return events.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def drain(stream: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over what there is now and return all rows it emitted, with their batch number."""
    out, spark = f"{folder}/stream-{uuid.uuid4().hex}", stream.sparkSession
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/part={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("part")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_events(raw)


def as_events(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("type"))


def next_poll(submitted: Column, now: Column, had_error: Column) -> Column:
    """When to ask again: after 2 s in the first minute, then 30 s, at least 30 s after an error, never past the deadline (STM-08)."""
    elapsed = (F.unix_micros(now) - F.unix_micros(submitted)) / 1e6
    delay = F.when(F.coalesce(had_error, F.lit(False)) | (elapsed >= EARLY), LATER).otherwise(SOON)
    return F.least(now + F.make_dt_interval(secs=delay), submitted + F.make_dt_interval(secs=F.lit(DEADLINE)))


def timed_out(submitted: Column, now: Column) -> Column:
    """Whether the deadline has passed (STM-09)."""
    return (F.unix_micros(now) - F.unix_micros(submitted)) / 1e6 >= DEADLINE


# Branch states, the first that any branch has is the job's.
BRANCH_ORDER = ("queued", "waiting", "timeout", "unknown", "failed", "received")


def branch_state(branches: DataFrame, key: str, status: str, due: str) -> DataFrame:
    """State of a remote job from its branches, and when the next is due (STM-11)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BRANCH_ORDER)), F.coalesce(status, F.lit("unknown"))), F.lit(0)), F.lit(4)).cast("int")
    return branches.groupBy(key).agg(F.min(place).alias("p"), F.min(due).alias("due")).select(key, F.element_at(F.array(*map(F.lit, BRANCH_ORDER)), F.col("p")).alias("status"), "due")
