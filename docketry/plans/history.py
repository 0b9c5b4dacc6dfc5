"""Queries of reviewed writes: versions, the state at a time, the audit, and standards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import history
from ..sources.tables import table

ACTIONS = ("create", "review", "rerun", "remote", "restore", "repair", "review", "delete")
AS_OF = "2024-01-15 12:00:00"


def _writes(spark, sf_dir):
    """Events as writes to users' records, every fourth based on a version that may be gone."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.floor(i * 31 / 7) % len(ACTIONS)).cast("int") + 1)
    status = F.element_at(F.array(*map(F.lit, (*history.REVIEW_STATUSES, "?"))), (i % 4).cast("int") + 1)
    return e.select(
        F.col("user_id").alias("record"), F.col("ts").cast("timestamp").alias("at"), i.alias("seq"), action.alias("action"), F.concat(F.lit("p"), i.cast("string")).alias("payload"), status.alias("review_status"), F.col("event_type").alias("final_result"),
        F.concat(F.lit("n"), i.cast("string")).alias("note"), F.when(i % 3 == 0, "e").alias("error_type"), F.when(i % 2 == 0, F.concat(F.lit("o"), i.cast("string"))).alias("original"), F.when(i % 4 == 3, (i % 5).cast("int")).alias("based_on"),
    )


def _shown(df):
    return df.select("record", "seq", "version", "payload", "baseline", "review_status", "final_result", "note", "error_type", "attempt", F.unix_seconds("updated").alias("updated"))


def write_history(spark, sf_dir):
    """Every write with its outcome and what it found and left (SNK-01, SNK-03, SNK-04, SNK-05)."""
    v = history.versions(_writes(spark, sf_dir), "record")
    return v.select("record", "seq", "action", "outcome", "before", "version", "payload", "baseline", "review_status", "final_result", "note", "error_type", "attempt", F.unix_seconds("updated").alias("updated"), "audited", F.unix_seconds("valid_to").alias("valid_to"))


def records_as_of(spark, sf_dir):
    """The records as they were on one day at noon."""
    return _shown(history.as_of(history.versions(_writes(spark, sf_dir), "record"), F.lit(AS_OF).cast("timestamp")))


def write_audit(spark, sf_dir):
    """Before and after images of all audited writes (SNK-03)."""
    return history.audit(history.versions(_writes(spark, sf_dir), "record"), "record").select("record", "seq", "action", "before", "after")


def stamp_standards(spark, sf_dir):
    """The newest standard of each requirement and how often it was changed (SNK-08)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("（ a )"))).otherwise(F.concat("p_brand", F.lit(" a"))).alias("requirement"), F.col("p_size").alias("shape"))
    return history.standards(p, "requirement", "p_partkey", ["p_partkey", "shape"])


_FNS = [write_history, records_as_of, write_audit, stamp_standards]
QUERIES = {f.__name__: f for f in _FNS}
_STATUSES = ", ".join(f"'{s}'" for s in history.REVIEW_STATUSES)
_FOLD = f"""
WITH RECURSIVE e AS (SELECT user_id AS record, ts AS moment, event_id AS seq, {list(ACTIONS)}[1 + (event_id * 31 // 7) % {len(ACTIONS)}] AS action, 'p' || event_id AS payload, [{_STATUSES}, '?'][1 + event_id % 4] AS status, event_type AS final_result, 'n' || event_id AS note,
  CASE WHEN event_id % 3 = 0 THEN 'e' ELSE '' END AS error, CASE WHEN event_id % 2 = 0 THEN 'o' || event_id END AS original, CASE WHEN event_id % 4 = 3 THEN event_id % 5 END AS based_on, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
walk AS (SELECT DISTINCT record, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::TIMESTAMP AS moment, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, NULL::VARCHAR AS before, NULL::INTEGER AS version, NULL::VARCHAR AS payload, NULL::VARCHAR AS baseline, NULL::VARCHAR AS review_status, NULL::VARCHAR AS final_result, NULL::VARCHAR AS note, NULL::VARCHAR AS error_type, NULL::INTEGER AS attempt, NULL::TIMESTAMP AS updated FROM e
UNION ALL SELECT record, r, seq, moment, action, outcome, before, CASE WHEN gone THEN NULL WHEN outcome = 'ok' THEN coalesce(version, 0) + 1 ELSE version END, CASE WHEN gone THEN NULL WHEN outcome = 'ok' THEN new_payload ELSE before END,
  CASE WHEN gone THEN NULL WHEN outcome <> 'ok' THEN baseline WHEN action IN ('create', 'remote') THEN new_payload WHEN action = 'repair' AND original IS NOT NULL THEN original ELSE baseline END, CASE WHEN gone THEN NULL WHEN outcome = 'ok' THEN status ELSE review_status END, CASE WHEN gone THEN NULL WHEN outcome = 'ok' THEN new_result ELSE final_result END,
  CASE WHEN gone THEN NULL WHEN outcome = 'ok' AND action IN ('create', 'review') THEN new_note ELSE note END, CASE WHEN gone THEN NULL WHEN outcome = 'ok' AND action IN ('rerun', 'remote') THEN '' WHEN outcome = 'ok' AND action IN ('create', 'review') THEN error ELSE error_type END,
  CASE WHEN gone THEN NULL WHEN outcome = 'ok' AND action IN ('create', 'rerun') THEN coalesce(attempt, 0) + 1 ELSE attempt END, CASE WHEN gone THEN NULL WHEN outcome = 'ok' AND action <> 'restore' THEN moment ELSE updated END FROM (SELECT *, outcome = 'ok' AND action = 'delete' AS gone FROM (
    SELECT w.record, e.r, e.seq, e.moment, e.action, CASE WHEN e.action = 'create' AND w.version IS NOT NULL THEN 'exists' WHEN e.action <> 'create' AND w.version IS NULL THEN 'missing' WHEN e.based_on <> coalesce(w.version, 0) THEN 'stale' WHEN e.action = 'review' AND e.status = '?' THEN 'status' ELSE 'ok' END AS outcome,
      w.payload AS before, w.version, w.baseline, w.review_status, w.final_result, w.note, w.error_type, w.attempt, w.updated, e.payload AS new_payload, e.status, e.final_result AS new_result, e.note AS new_note, e.error, e.original FROM walk w JOIN e ON w.record = e.record AND e.r = w.r + 1))),
v AS (SELECT *, outcome = 'ok' AND action IN ('rerun', 'review', 'remote', 'repair') AS audited, CASE WHEN outcome = 'ok' THEN lead(moment) OVER (PARTITION BY record, outcome = 'ok' ORDER BY r) END AS valid_to FROM walk WHERE r > 0)"""
_COLUMNS = "version, payload, baseline, review_status, final_result, note, error_type, attempt, epoch_us(updated) // 1000000 AS updated"
ORACLE_SQL = {
    "write_history": f"{_FOLD} SELECT record, seq, action, outcome, before, {_COLUMNS}, audited, epoch_us(valid_to) // 1000000 AS valid_to FROM v",
    "records_as_of": f"{_FOLD} SELECT record, seq, {_COLUMNS} FROM v WHERE outcome = 'ok' AND version IS NOT NULL AND moment <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')",
    "write_audit": f"{_FOLD} SELECT record, seq, action, before, payload AS after FROM v WHERE audited",
    "stamp_standards": "SELECT p_brand || 'a' AS requirement_key, count(*)::INTEGER AS revision, arg_max(CASE WHEN p_partkey % 2 = 0 THEN p_brand || '（ a )' ELSE p_brand || ' a' END, p_partkey) AS requirement, max(p_partkey) AS p_partkey, arg_max(p_size, p_partkey) AS shape FROM part GROUP BY p_brand",
}
