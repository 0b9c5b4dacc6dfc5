"""Queries of replays: saved checks of orders after some requirements and readings changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PARTIAL, UNDECIDABLE, UNREAD
from ..operators import replay as ops
from ..sources.tables import table

_TEXTS = ("AB CD", "ABCD", "ABC", "X", "")


def _plan(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p") % len(_TEXTS)).cast("int") + 1)
    readings = i.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("pos"), text.alias("text"), (F.col("p") % 7 != 0).alias("active"))
    need = lambda d: F.when((k + d) % 3 == 0, "ABCD").when((k + d) % 3 == 1, "（AB）CD").otherwise("")
    requirements = o.filter(k % 23 != 0).select("o_orderkey", F.when(k % 4 == 0, need(1)).otherwise(need(0)).alias("requirement"))
    # What was saved before every fourth requirement changed.
    before = o.select("o_orderkey", need(0).alias("requirement"))
    empty = o.select("o_orderkey", F.lit("").alias("status"), F.lit("").alias("reading"), F.lit("").alias("revision"), F.lit(False).alias("human"), F.lit(False).alias("busy"))
    first = ops.replay(ops.planned(empty, before, readings, "o_orderkey"), "o_orderkey")
    saved = first.select("o_orderkey", "status", "reading", "revision", (k % 10 == 0).alias("human"), (k % 14 == 0).alias("busy"))
    return ops.planned(saved, requirements, readings, "o_orderkey")


def replayed_checks(spark, sf_dir):
    """Every order's check after the replay (MCH-41, MCH-43, REC-14)."""
    return ops.replay(_plan(spark, sf_dir), "o_orderkey").select("o_orderkey", "status", "reading", "outcome")


def replay_counts(spark, sf_dir):
    """What the replay would do, as counts (REC-14)."""
    return ops.dry_run(_plan(spark, sf_dir), "o_orderkey")


_FNS = [replayed_checks, replay_counts]
QUERIES = {f.__name__: f for f in _FNS}


def _best(need: str, name: str) -> str:
    rank = f"CASE WHEN {need} = '' THEN 0 WHEN t = '' THEN 0 WHEN t = 'ABCD' THEN 3 WHEN t = 'ABC' THEN 2 ELSE 1 END"
    status = f"CASE WHEN {need} = '' THEN '{UNDECIDABLE}' WHEN t = '' THEN '{UNREAD}' WHEN t = 'ABCD' THEN '{MATCH}' WHEN t = 'ABC' THEN '{PARTIAL}' ELSE '{MISMATCH}' END"
    return f"{name} AS (SELECT k, {status} AS status, text AS reading FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY {rank} DESC, pos) = 1)"


_REPLAY = f"""
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, pos, {list(_TEXTS)}[1 + p % {len(_TEXTS)}] AS text FROM i WHERE p % 7 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'ABCD' END AS old, CASE WHEN (o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 3 = 2 THEN '' ELSE 'ABCD' END AS new FROM orders),
j AS (SELECT n.*, r.pos, r.text, replace(r.text, ' ', '') AS t FROM n JOIN r USING (k)), {_best('old', 'b')}, {_best('new', 'a')},
s AS (SELECT n.k, old, new, coalesce(b.status, CASE WHEN old = '' THEN '{UNDECIDABLE}' ELSE '{UNREAD}' END) AS status, b.reading, coalesce(a.status, CASE WHEN new = '' THEN '{UNDECIDABLE}' ELSE '{UNREAD}' END) AS new_status, a.reading AS new_reading FROM n LEFT JOIN b USING (k) LEFT JOIN a USING (k)),
o AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'gone' WHEN old = new THEN 'same' WHEN k % 10 = 0 THEN 'human' WHEN k % 14 = 0 THEN 'busy' WHEN status = new_status AND reading IS NOT DISTINCT FROM new_reading THEN 'confirmed' ELSE 'updated' END AS outcome FROM s)"""
ORACLE_SQL = {
    "replayed_checks": f"{_REPLAY} SELECT k AS o_orderkey, CASE WHEN outcome = 'updated' THEN new_status ELSE status END AS status, CASE WHEN outcome = 'updated' THEN new_reading ELSE reading END AS reading, outcome FROM o",
    "replay_counts": f"{_REPLAY} SELECT outcome, count(*) AS n FROM o GROUP BY 1",
}
