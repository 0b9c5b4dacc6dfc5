"""Work-queue queries: the fold of the event log as a batch and as a stream, polling and branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.latest import newest_by
from ..scratch import scratch_dir
from ..sources.tables import table
from ..streaming import queue


def _shown(df):
    return df.select("job", "events", "attempts", "last_id", "last_type")


def job_fold_batch(spark, sf_dir):
    return _shown(queue.fold(queue.as_events(table(spark, sf_dir, "events"))))


def job_fold_stream(spark, sf_dir):
    """The same states by Structured Streaming: the last that each job emitted."""
    rows = queue.drain(queue.fold_stream(queue.event_stream(spark, sf_dir)), scratch_dir(spark))
    return newest_by(rows, ["job"], ["events", "attempts", "last_id", "last_type"], ["batch"])


def daily_windows(spark, sf_dir):
    """Events by day and type in windows of a stream that is run to its end: the last that each emitted, so the watermark can drop closed ones."""
    rows = queue.drain(queue.windowed_counts(queue.event_stream(spark, sf_dir)), scratch_dir(spark))
    return newest_by(rows.withColumn("day", F.col("start").cast("date").cast("string")), ["day", "type"], ["n"], ["batch"])


def polling(spark, sf_dir):
    """Seconds until each event's job is polled again, asked ``event_id % 400`` seconds after its submission (STM-08, STM-09)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("sent"), (F.col("event_type") == "error").alias("error"))
    now = F.col("sent") + F.make_dt_interval(secs=F.col("event_id") % 400)
    due = queue.next_poll(F.col("sent"), now, F.col("error"))
    return e.select("event_id", ((F.unix_micros(due) - F.unix_micros("sent")) / 1000000).cast("long").alias("due_after"), queue.timed_out(F.col("sent"), now).alias("timed_out"))


def branches(spark, sf_dir):
    """Events of a user and day as branches of one remote job (STM-11)."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "received").when(F.col("event_type") == "view", "waiting").when(F.col("event_type") == "click", "timeout")
    b = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.col("ts").cast("date").cast("string")).alias("remote"), status.alias("status"), (F.col("event_id") % 1000).alias("due"))
    return queue.branch_state(b, "remote", "status", "due")


_FNS = [job_fold_batch, job_fold_stream, daily_windows, polling, branches]
QUERIES = {f.__name__: f for f in _FNS}
_FOLD = "SELECT user_id AS job, count(*) AS events, count(*) FILTER (event_type = 'signup') AS attempts, arg_max(event_id, r) AS last_id, arg_max(event_type, r) AS last_type FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) GROUP BY 1"
ORACLE_SQL = {
    "job_fold_batch": _FOLD,
    "job_fold_stream": _FOLD,
    "daily_windows": "SELECT ts::DATE::VARCHAR AS day, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
    "polling": "SELECT event_id, least(event_id % 400 + CASE WHEN event_type = 'error' OR event_id % 400 >= 60 THEN 30 ELSE 2 END, 300)::BIGINT AS due_after, event_id % 400 >= 300 AS timed_out FROM events",
    "branches": "SELECT user_id || '/' || ts::DATE::VARCHAR AS remote, ['queued', 'waiting', 'timeout', 'unknown', 'failed', 'received'][min(CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END)] AS status, min(event_id % 1000) AS due FROM events GROUP BY 1",
}
