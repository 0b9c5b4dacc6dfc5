"""Queries of the queue under control, as a batch and as a stream of several micro-batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..scratch import Held, delete, new_folder
from ..sources.tables import table
from ..streaming import control

CYCLE = ("submit", "upload", "start", "prioritize", "claim", "progress", "fail", "retry", "claim", "finish", "remote", "edit", "remote")
OTHERS = ("withdraw", "recover", "claim", "remove", "delete", "retry")
KEEP_SECONDS, DELAY_SECONDS = 86_400, 7_200
_EVENT = "job long, at timestamp, id long, kind string, attempt int, revision int, paused boolean"


def _events(spark, sf_dir):
    """Events as a log of jobs: users' events go through a job's life, every seventh out of turn."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    turn = F.row_number().over(Window.partitionBy("job").orderBy("at", "id")) - 1
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names)).cast("int") + 1)
    kind = F.when(F.col("id") % 7 == 0, of(OTHERS, F.floor(F.col("id") / 7))).otherwise(of(CYCLE, turn))
    return e.select("job", "at", "id", kind.alias("kind"), F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("attempt"), (F.col("id") % 3).cast("int").alias("revision"), (F.hour("at") % 6 == 0).alias("paused"))


def control_log(spark, sf_dir):
    """What each event made of its job, or why it was refused (STM-01, STM-02, STM-06, STM-20)."""
    return control.fold_log(_events(spark, sf_dir), KEEP_SECONDS)


def _arriving(events, folder: str, batches: int = 4):
    """The events as a stream of micro-batches, each event up to 90 minutes after its time."""
    arrival = F.unix_seconds("at") + F.col("id") * 7919 % 5400
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    numbered = Held(events.withColumn("__batch", F.least(F.floor((arrival - F.lit(first)) * batches / F.lit(last - first + 1)), F.lit(batches - 1))))  # worked out once, by all tasks
    for n in range(batches):  # in this order
        numbered.rows.filter(F.col("__batch") == n).drop("__batch").coalesce(1).write.mode("append").parquet(folder)
    numbered.drop()
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def control_stream(spark, sf_dir):
    """The same log from shuffled micro-batches; one event far ahead moves the watermark past all others."""
    folder = new_folder(spark, "events")
    stream = _arriving(_events(spark, sf_dir), folder)
    spark.createDataFrame([(-1, 0, "submit", 1, 0, False)], "job long, id long, kind string, attempt int, revision int, paused boolean").select(
        "job", F.lit("2100-01-01").cast("timestamp").alias("at"), "id", "kind", "attempt", "revision", "paused"
    ).coalesce(1).write.mode("append").parquet(folder)
    rows, _ = control.drain(control.fold_stream(stream, f"{DELAY_SECONDS} seconds", KEEP_SECONDS))
    delete(spark, folder)
    return rows


def late_events(spark, sf_dir):
    """Events that come more than ten minutes behind the latest of the micro-batches before them."""
    folder = new_folder(spark, "events")
    rows, _ = control.late_rows(_arriving(_events(spark, sf_dir).select("job", "at", "id"), folder), "at", 600)
    delete(spark, folder)
    return rows.select("job", "id")


def admitted_once(spark, sf_dir):
    """Requests of each user and day, admitted once however often they come within two days (STM-16)."""
    folder = new_folder(spark, "events")
    stream = _arriving(_events(spark, sf_dir).select("job", "at", "id"), folder).withColumn("day", F.col("at").cast("date").cast("string"))
    rows, _ = control.drain(control.admit_once(stream, ["job", "day"], "at", "2 days").select("job", "day"))
    delete(spark, folder)
    return rows


def admitted_retries(spark, sf_dir):
    """Retries of customers' orders, as a whole or not at all (STM-16, STM-21)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    requests = o.select(F.col("o_custkey").alias("request"), F.explode(F.when(k % 17 == 0, F.array(k, k)).when(k % 19 == 0, F.array(-k)).otherwise(F.array(k))).alias("target"))
    results = o.select(k.alias("target"), F.when(k % 13 != 0, "file").alias("source"))
    return control.admit_batch(requests, results, o.filter("o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0").select(k.alias("target")), "request", "target")


def claimed_next(spark, sf_dir):
    """The order of each priority class that is claimed next, and none where the queue is paused (STM-02)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), (F.col("o_custkey") % 7).alias("priority"), F.col("o_orderdate").alias("uploaded"))
    paused = spark.createDataFrame([(1, True), (2, False)], "at int, paused boolean")
    off = spark.createDataFrame([(1, False), (3, True)], "at int, paused boolean")
    return control.next_claim(o, paused).union(control.next_claim(o, off)).select("job", "priority")


def upgraded_branches(spark, sf_dir):
    """Branches of remote tasks that are taken up again, one for each line (STM-10)."""
    states = ("queued", "uploading", "submitting", "waiting", "completed", "failed", "skipped")
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    p = F.col("p")
    state = F.element_at(F.array(*map(F.lit, states)), (p % 7).cast("int") + 1)
    to = control.upgraded_branch(state, F.when(p % 3 == 0, "u"), p % 4 == 0, p % 5 == 0, F.when(p % 11 == 0, "result_timeout"), F.col("l_linenumber") % 2 == 0)
    return i.select("l_orderkey", "l_linenumber", to.alias("state"))


_FNS = [control_log, control_stream, late_events, admitted_once, admitted_retries, claimed_next, upgraded_branches]
QUERIES = {f.__name__: f for f in _FNS}


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_MOVES = ", ".join(f"('{k}', '{a}', '{b}')" for k, t in control.MOVES.items() for a, b in t.items())
_KEPT = " OR ".join(f"kind = '{k}' AND before IN ({', '.join(map(repr, s))})" for k, s in control.KEPT.items())
_E = f"""n AS (SELECT user_id AS job, ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
e AS (SELECT job, r, id, epoch_us(ts) AS t, CASE WHEN id % 7 = 0 THEN {_list(OTHERS)}[1 + (id // 7) % {len(OTHERS)}] ELSE {_list(CYCLE)}[1 + (r - 1) % {len(CYCLE)}] END AS kind, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS of_attempt, id % 3 AS of_revision, hour(ts) % 6 = 0 AS paused FROM n)"""
_LOG = f"""
WITH RECURSIVE {_E}, moves(kind, status, next) AS (VALUES {_MOVES}),
walk AS (SELECT DISTINCT job, 0::BIGINT AS r, NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::VARCHAR AS before, ''::VARCHAR AS status, NULL::VARCHAR AS outcome, 0::BIGINT AS attempt, 0::BIGINT AS priority, 0::BIGINT AS revision, 0::BIGINT AS t FROM e
UNION ALL SELECT job, r, id, kind, before, CASE WHEN outcome = 'ok' THEN next ELSE before END, outcome, attempt + CASE WHEN outcome = 'ok' AND kind = 'claim' THEN 1 ELSE 0 END, CASE WHEN outcome = 'ok' AND kind = 'prioritize' THEN id WHEN outcome = 'ok' AND kind = 'withdraw' THEN 0 ELSE priority END,
  revision + CASE WHEN outcome = 'ok' AND kind IN ('finish', 'edit', 'remote') THEN 1 ELSE 0 END, CASE WHEN outcome = 'ok' THEN moment ELSE t END FROM (
  SELECT *, CASE WHEN kind = 'remote' AND before IN ('awaiting', 'ready', 'queued', 'running') THEN 'waiting' WHEN next IS NULL THEN CASE WHEN {_KEPT} THEN 'kept' ELSE 'illegal' END WHEN kind = 'claim' AND paused THEN 'paused'
    WHEN kind IN ('progress', 'finish', 'fail') AND of_attempt <> attempt THEN 'stale' WHEN kind = 'remote' AND of_revision <> revision THEN 'conflict' ELSE 'ok' END AS outcome FROM (
    SELECT g.*, m.next FROM (SELECT w.job, e.r, e.id, e.kind, e.t AS moment, e.of_attempt, e.of_revision, e.paused, w.t, CASE WHEN old THEN '' ELSE w.status END AS before, CASE WHEN old THEN 0 ELSE w.attempt END AS attempt, CASE WHEN old THEN 0 ELSE w.priority END AS priority, CASE WHEN old THEN 0 ELSE w.revision END AS revision
      FROM (SELECT w.*, e.t AS now FROM walk w JOIN e ON w.job = e.job AND e.r = w.r + 1) w JOIN e ON w.job = e.job AND e.r = w.r + 1, LATERAL (SELECT w.status IN ('succeeded', 'failed', 'removed') AND w.now >= w.t + {KEEP_SECONDS}::BIGINT * 1000000 AS old)) g
    LEFT JOIN moves m ON g.kind = m.kind AND g.before = m.status)))
SELECT job, id, kind, before, status AS after, outcome, attempt::INTEGER AS attempt, priority, revision::INTEGER AS revision FROM walk WHERE r > 0"""
ORACLE_SQL = {
    "control_log": _LOG,
    "control_stream": _LOG,
    "late_events": """
WITH a AS (SELECT user_id AS job, event_id AS id, epoch_us(ts) AS t, epoch_us(ts) // 1000000 + event_id * 7919 % 5400 AS arrival FROM events),
b AS (SELECT *, least((arrival - min(arrival) OVER ()) * 4 // (max(arrival) OVER () - min(arrival) OVER () + 1), 3) AS n FROM a)
SELECT job, id FROM b WHERE t < (SELECT max(t) FROM b p WHERE p.n < b.n) - 600 * 1000000""",
    "admitted_once": "SELECT DISTINCT user_id AS job, ts::DATE::VARCHAR AS day FROM events",
    "admitted_retries": """
WITH q AS (SELECT o_custkey AS request, o_orderkey AS k, o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 AS busy FROM orders)
SELECT request, sum(CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END)::BIGINT AS targets, CASE WHEN bool_or(k % 17 = 0) THEN 'repeated' WHEN bool_or(k % 19 = 0 AND k % 17 <> 0 AND k <> 0) THEN 'unknown' WHEN bool_or(k % 13 = 0 AND (k % 19 <> 0 OR k = 0)) THEN 'no source' WHEN bool_or(busy AND (k % 19 <> 0 OR k = 0)) THEN 'active' END AS refused FROM q GROUP BY 1""",
    "claimed_next": "SELECT o_orderkey AS job, o_custkey % 7 AS priority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey % 7 DESC, o_orderdate, o_orderkey LIMIT 1",
    "upgraded_branches": """
WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, ['queued', 'uploading', 'submitting', 'waiting', 'completed', 'failed', 'skipped'][1 + p % 7] AS s FROM i),
f AS (SELECT *, CASE WHEN p % 11 = 0 THEN 'failed' WHEN p % 3 = 0 AND s NOT IN ('completed', 'received', 'skipped') THEN CASE WHEN p % 4 = 0 THEN 'completed' ELSE 'waiting' END WHEN p % 3 <> 0 AND (s = 'waiting' OR s IN ('queued', 'uploading') AND p % 5 = 0) THEN 'unknown' ELSE s END AS f FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND f = 'uploading' THEN 'queued' WHEN l_linenumber % 2 = 0 AND f = 'submitting' AND p % 3 <> 0 THEN 'unknown' ELSE f END AS state FROM f""",
}
