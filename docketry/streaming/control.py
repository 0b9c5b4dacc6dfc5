"""The work queue under control: legal moves of jobs, refused ones, and what comes twice or late; as batches and as streams.

One table of moves serves both.  A batch folds each job's log in order.  A
stream gets the log in any order: it holds events back until the watermark has
passed them, applies them in order, and forgets closed jobs after a while.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..scratch import new_folder

#: What each kind of event makes of a job; "" is no job.  Anything else is illegal.
MOVES = {
    "submit": {"": "awaiting"}, "upload": {"awaiting": "ready"}, "start": {"ready": "queued"}, "withdraw": {"queued": "ready"}, "prioritize": {"queued": "queued"},
    "remove": {"awaiting": "removed", "ready": "removed"}, "delete": {"awaiting": "removed", "ready": "removed", "queued": "removed", "running": "removed"}, "claim": {"queued": "running"},
    "progress": {"running": "running"}, "finish": {"running": "succeeded"}, "fail": {"running": "failed"}, "recover": {"running": "queued"}, "retry": {"failed": "queued"},
    "edit": {"succeeded": "succeeded", "failed": "failed"}, "remote": {"succeeded": "succeeded", "failed": "succeeded"},
}
#: Asked again where there is nothing to do: the job stays as it is.
KEPT = {"retry": ("ready", "queued", "running"), "delete": ("succeeded", "failed", "removed")}
#: These tell of one attempt of a job and are stale in another.
OF_ATTEMPT = ("progress", "finish", "fail")
#: A remote answer belongs to a result of one revision, which these raise.
REVISES = ("finish", "edit", "remote")
CLOSED = ("succeeded", "failed", "removed")
_LOG = "job long, id long, kind string, before string, after string, outcome string, attempt int, priority long, revision int"
_EVENT = "id long, t long, kind string, attempt int, revision int, paused boolean"


def _literal(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def fold_log(events: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """Every event of each job with the job before and after, and the outcome (STM-01, STM-02, STM-06, STM-20, STM-21).

    ``events`` has job, at (a timestamp), id, kind, attempt, revision and
    paused: the attempt or revision that it tells of, and whether the queue
    was paused.  Outcomes: ok; illegal; kept (nothing to do); paused (no claim
    while the queue is); stale (of another attempt); waiting (a remote answer
    to a job that runs); conflict (to a result that has changed since, which
    stays).  A job that was closed ``keep_seconds`` before an event is
    forgotten.  Events of one instant go by id.  A group is one job's log.
    """
    moves = _literal({f"{k}:{a}": b for k, table in MOVES.items() for a, b in table.items()})
    kept = F.array(*[F.lit(f"{k}:{a}") for k, states in KEPT.items() for a in states])
    t = F.unix_micros("at").alias("t")
    held = F.array_sort(F.collect_list(F.struct(t, "id", "kind", "attempt", "revision", "paused")))

    def step(s: Column, e: Column) -> Column:
        # What is said of the job before the event is worked out once, as a lambda's variable.
        old = F.lit(False) if keep_seconds is None else s["status"].isin(*CLOSED) & (e["t"] >= s["t"] + keep_seconds * 1_000_000)
        now = F.struct(
            F.when(old, F.lit("")).otherwise(s["status"]).alias("status"), F.when(old, F.lit(0)).otherwise(s["attempt"]).alias("attempt"),
            F.when(old, F.lit(0).cast("long")).otherwise(s["priority"]).alias("priority"), F.when(old, F.lit(0)).otherwise(s["revision"]).alias("revision"),
        )
        return F.element_at(F.transform(F.array(now), lambda n: moved(s, n, e)), 1)

    def moved(s: Column, n: Column, e: Column) -> Column:
        named = F.concat(e["kind"], F.lit(":"), n["status"])
        to = F.try_element_at(moves, named)
        outcome = (
            F.when((e["kind"] == "remote") & n["status"].isin("awaiting", "ready", "queued", "running"), "waiting").when(to.isNull(), F.when(F.array_contains(kept, named), "kept").otherwise("illegal"))
            .when((e["kind"] == "claim") & F.coalesce(e["paused"], F.lit(False)), "paused").when(e["kind"].isin(*OF_ATTEMPT) & ~e["attempt"].eqNullSafe(n["attempt"]), "stale")
            .when((e["kind"] == "remote") & ~e["revision"].eqNullSafe(n["revision"]), "conflict").otherwise("ok")
        )
        return F.element_at(F.transform(F.array(outcome), lambda o: after(s, n, e, o, F.when(o == "ok", to).otherwise(n["status"]))), 1)

    def after(s: Column, n: Column, e: Column, outcome: Column, to: Column) -> Column:
        ok = outcome == "ok"
        attempt = n["attempt"] + F.when(ok & (e["kind"] == "claim"), 1).otherwise(0)
        priority = F.when(ok & (e["kind"] == "prioritize"), e["id"]).when(ok & (e["kind"] == "withdraw"), F.lit(0).cast("long")).otherwise(n["priority"])
        revision = n["revision"] + F.when(ok & e["kind"].isin(*REVISES), 1).otherwise(0)
        row = F.struct(e["id"].alias("id"), e["kind"].alias("kind"), n["status"].alias("before"), to.alias("after"), outcome.alias("outcome"), attempt.alias("attempt"), priority.alias("priority"), revision.alias("revision"))
        return F.struct(to.alias("status"), attempt.alias("attempt"), priority.alias("priority"), revision.alias("revision"), F.when(ok, e["t"]).otherwise(s["t"]).alias("t"), F.concat(s["log"], F.array(row)).alias("log"))

    none = F.array().cast("array<struct<id: long, kind: string, before: string, after: string, outcome: string, attempt: int, priority: long, revision: int>>")
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("attempt"), F.lit(0).cast("long").alias("priority"), F.lit(0).alias("revision"), F.lit(0).cast("long").alias("t"), none.alias("log"))
    folded = events.groupBy("job").agg(held.alias("held"))
    return folded.select("job", F.explode(F.aggregate("held", start, step, lambda s: s["log"])).alias("r")).select("job", "r.*")


class _Fold(StatefulProcessor):
    """One job of the stream: its state, and the events that the watermark hasn't passed."""

    def __init__(self, keep_seconds: int):
        self.keep = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempt int, priority long, revision int, t long")
        self.held = handle.getListState("held", _EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.id, r.t, r.kind, r.attempt, r.revision, r.paused) for r in rows]
        if came:  # one write and one timer, the first, for all: each is a round trip; what isn't due then sets the next timer
            self.held.appendList(came)
            self.handle.registerTimer(min(e[1] for e in came) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(self.held.get(), key=lambda e: (e[1], e[0]))
        due = [e for e in events if e[1] // 1000 < passed]
        status, attempt, priority, revision, t = self.job.get() or ("", 0, 0, 0, 0)
        out = []
        for id_, at, kind, of_attempt, of_revision, paused in due:
            if status in CLOSED and at >= t + self.keep * 1000:
                status, attempt, priority, revision = "", 0, 0, 0
            to, before = MOVES.get(kind, {}).get(status), status
            if kind == "remote" and status in ("awaiting", "ready", "queued", "running"):
                outcome = "waiting"
            elif to is None:
                outcome = "kept" if status in KEPT.get(kind, ()) else "illegal"
            elif kind == "claim" and paused:
                outcome = "paused"
            elif kind in OF_ATTEMPT and of_attempt != attempt:
                outcome = "stale"
            elif kind == "remote" and of_revision != revision:
                outcome = "conflict"
            else:
                outcome, status, t = "ok", to, at
                attempt += kind == "claim"
                priority = id_ if kind == "prioritize" else 0 if kind == "withdraw" else priority
                revision += kind in REVISES
            out.append(Row(job=key[0], id=id_, kind=kind, before=before, after=status, outcome=outcome, attempt=attempt, priority=priority, revision=revision))
        if due:
            if rest := events[len(due) :]:
                self.held.put(rest)
                self.handle.registerTimer(rest[0][1] // 1000 + 1)
            else:
                self.held.clear()
        over = t // 1000 + self.keep
        if status == "" or status in CLOSED and over < passed and len(due) == len(events):
            self.job.clear()
        else:
            self.job.update((status, attempt, priority, revision, t))
            if status in CLOSED and due:
                self.handle.registerTimer(over + 1)
        return iter(out)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str, keep_seconds: int) -> DataFrame:
    """The same log from a stream, each event once the watermark has passed it; needs the RocksDB state store.

    Events later than ``late`` are dropped (see ``late_rows``).  A job's state
    goes ``keep_seconds`` after it was closed.
    """
    rows = events.withWatermark("at", late).select("job", "at", "id", F.unix_micros("at").alias("t"), "kind", "attempt", "revision", "paused")
    return rows.groupBy("job").transformWithState(_Fold(keep_seconds), _LOG, "Append", "EventTime")


def drain(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, str]:
    """Run a stream over what there is now; return what it emitted, and the folder to delete.  Keeps state in RocksDB."""
    spark = stream.sparkSession
    folder, key = new_folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), folder


def late_rows(stream: DataFrame, at: str, late_seconds: int) -> tuple[DataFrame, str]:
    """The rows of a stream that come after its watermark: earlier than the latest of all batches before, less the delay.

    Spark drops such rows without a word.  Each batch leaves its latest time in
    the shared folder, so a batch that runs again finds the same rows.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "late")

    def batch(rows: DataFrame, n: int) -> None:
        s = rows.sparkSession
        seen = s.read.schema("n long, top long").parquet(f"{folder}/marks").filter(F.col("n") < n).agg(F.max("top")).first()[0] if n else None
        t = F.unix_micros(F.col(at).cast("timestamp"))
        out = rows.filter(t < (seen if seen is not None else -(2**62)) - late_seconds * 1_000_000)
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        rows.agg(F.max(t).alias("top")).select(F.lit(n).cast("long").alias("n"), "top").write.mode("overwrite").parquet(f"{folder}/marks/batch={n}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), folder


def admit_once(requests: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first request of each key of a stream; more within the watermark's delay are dropped (STM-16). State is one row a key until then."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def admit_batch(requests: DataFrame, results: DataFrame, active: DataFrame, request: str, target: str, most: int = 2000) -> DataFrame:
    """Retry requests, each a list of targets, with ``refused``: why none of it is admitted, or null (STM-16, STM-21).

    A request is admitted as a whole or not at all: it has at least one and at
    most ``most`` targets, no two alike, each with a result whose ``source`` is
    there, and none with an active job.  ``requests`` has a row for each target;
    ``results`` has target and source, ``active`` the targets with active jobs.
    """
    known = results.groupBy(target).agg(F.bool_or(F.coalesce("source", F.lit("")) != "").alias("__source"))
    busy = active.select(target).distinct().withColumn("__busy", F.lit(True))
    each = requests.join(known, target, "left").join(busy, target, "left")
    n = F.count(target)
    why = (
        F.when(n == 0, "empty").when(n > most, "too many").when(F.count_distinct(target) < n, "repeated").when(F.count_if(F.col(target).isNotNull() & F.col("__source").isNull()) > 0, "unknown")
        .when(F.count_if(~F.col("__source")) > 0, "no source").when(F.count("__busy") > 0, "active")
    )
    return each.groupBy(request).agg(n.alias("targets"), why.alias("refused"))


def next_claim(states: DataFrame, paused: DataFrame) -> DataFrame:
    """The queued job that is claimed next: highest priority, then first uploaded, then smallest id; none while the queue is paused (STM-02).

    ``states`` has job, status, priority and uploaded; ``paused`` is a log of
    at and paused, of which the newest row holds.
    """
    held = paused.agg(F.max_by("paused", "at").alias("__paused"))
    top = states.filter(F.col("status") == "queued").orderBy(F.desc("priority"), F.asc_nulls_last("uploaded"), "job").limit(1)
    return top.join(held, ~F.coalesce("__paused", F.lit(False)), "inner").drop("__paused")


def upgraded_branch(status: Column, uuid: Column, has_result: Column, uncertain: Column, failure: Column, recover: Column) -> Column:
    """State of a branch of a remote task that is taken up again (STM-10): nothing that may have been sent is sent twice."""
    sent = F.coalesce(uuid, F.lit("")) != ""
    done = status.isin("completed", "received", "skipped")
    first = (
        F.when(failure == "result_timeout", "failed").when(sent & ~done, F.when(has_result, "completed").otherwise("waiting"))
        .when(~sent & status.isin("queued", "uploading", "waiting") & (uncertain | (status == "waiting")), "unknown").otherwise(status)
    )
    return F.when(recover & (first == "uploading"), "queued").when(recover & (first == "submitting") & ~sent, "unknown").otherwise(first)
