"""Queries of several providers' readings: fields, stamp channels and samples' decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PARTIAL, UNCONFIRMED
from ..operators import providers
from ..sources.tables import table

_DATES = ("2025年3月4日", "2025-03-04", "2025/3/5", "soon", " ")
_STATUSES = (MATCH, PARTIAL, MISMATCH, "?")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("p"))


def _of(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def printed_fields(spark, sf_dir):
    """The due date of each order from its lines as readings, a valid one before others (MCH-20, STR-11)."""
    r = _lines(spark, sf_dir).select(
        "k", F.lit(providers.DUE).alias("field"), "pos", F.concat(F.lit("m"), F.col("pos").cast("string")).alias("method"), F.when(F.col("pos") == 1, "q").otherwise("p").alias("provider"), _of(_DATES, F.col("p")).alias("value"), F.lit(None).cast("double").alias("conf"), F.lit(True).alias("low"),
        F.lit(None).cast("string").alias("known"), (F.col("p") % 11 == 0).alias("inactive"),
    )
    return providers.select_fields(r, ["k"], "q").select("k", "value", "method", "rule", "disputed")


def channel_checks(spark, sf_dir):
    """One stamp check of each order from its lines as channels, by two policies (MCH-24, WIN-15)."""
    p = F.col("p")
    c = _lines(spark, sf_dir).select(
        "k", "pos", _of(("local", "qingtong", "danzhengtong"), F.col("pos")).alias("provider"), F.concat(F.lit("s"), F.col("pos").cast("string")).alias("source"), F.when(p % 9 != 0, F.concat(F.lit("t"), (p % 4).cast("string"))).alias("recognized"), _of(_STATUSES, p).alias("status"),
        (p % 7 / 8).alias("coverage"), F.lit(0.5).alias("similarity"), (p % 5 != 0).alias("reliable"), (p % 13 == 0).alias("simulated"),
    )
    one = lambda policy, mode: providers.combine_channels(c, ["k"], policy, mode).select("k", "source", "status", "reliable", F.array_join("all_recognized", ",").alias("recognized"), F.lit(mode).alias("mode"))
    return one("any_exact", "any").union(one("qingtong_exact", "all"))


def sample_decisions(spark, sf_dir):
    """Decisions of parts as samples (MCH-27)."""
    k = F.col("p_partkey")
    status = _of((MATCH, PARTIAL, MISMATCH, UNCONFIRMED, "", "?"), k)
    d = providers.sample_decision(status, F.when(k % 11 == 0, k % 2 == 0), k % 5 == 0, k % 7 == 0, F.when(k % 8 != 0, F.lit("（AB）")), _of(("AB", "A", "XY", " "), F.floor(k / 6)))
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("decision"))


_FNS = [printed_fields, channel_checks, sample_decisions]
QUERIES = {f.__name__: f for f in _FNS}
_L = "l AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"


def _channels(mode: str, preferred: str) -> str:
    shown = "CASE WHEN NOT every AND one THEN '" + PARTIAL + "' ELSE status END" if mode == "all" else "status"
    firm = "every AND " if mode == "all" else ""
    return f"""SELECT k, source, {shown} AS status, {firm}(CASE WHEN status = '{MATCH}' THEN reliable AND real ELSE status = '{MISMATCH}' AND firm END) AS reliable, read AS recognized, '{mode}' AS mode FROM (
  SELECT * FROM c JOIN g USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY {preferred}, r DESC, coverage DESC, pos) = 1)"""


ORACLE_SQL = {
    "printed_fields": f"""
WITH {_L}, r AS (SELECT k, pos, {list(_DATES)}[1 + p % 5] AS value, CASE p % 5 WHEN 3 THEN 'soon' WHEN 2 THEN '2025-03-05' ELSE '2025-03-04' END AS form, p % 5 <> 3 AS valid FROM l WHERE p % 11 <> 0 AND p % 5 <> 4),
u AS (SELECT * FROM r QUALIFY valid OR NOT bool_or(valid) OVER (PARTITION BY k)),
g AS (SELECT k, count(DISTINCT form) AS n, min(pos) AS pos FROM u GROUP BY k)
SELECT k, trim(value) AS value, 'm' || pos AS method, CASE WHEN NOT valid THEN 'format' WHEN n = 1 THEN 'unanimous' WHEN pos = 1 THEN 'preferred' ELSE 'rank' END AS rule, n > 1 AND pos > 1 AS disputed FROM g JOIN u USING (k, pos)""",
    "channel_checks": f"""
WITH {_L}, c AS (SELECT k, pos, pos % 3 = 1 AS wanted, 's' || pos AS source, CASE WHEN p % 9 <> 0 THEN 't' || (p % 4) END AS text, {list(_STATUSES)}[1 + p % 4] AS status, (p % 7) / 8 AS coverage, p % 5 <> 0 AS reliable, p % 13 <> 0 AS real,
  CASE WHEN p % 9 = 0 OR p % 13 = 0 THEN 0 ELSE [3, 2, 1, 0][1 + p % 4] END AS r FROM l),
o AS (SELECT k, text, min(pos) AS pos FROM c WHERE text IS NOT NULL GROUP BY 1, 2), t AS (SELECT k, string_agg(text, ',' ORDER BY pos) AS texts FROM o GROUP BY 1),
a AS (SELECT k, bool_and(reliable AND real AND status = '{MATCH}') AS every, bool_or(reliable AND real AND status = '{MATCH}') AS one, bool_and(reliable AND real) AS firm FROM c GROUP BY 1),
g AS (SELECT a.*, coalesce(t.texts, '') AS read FROM a LEFT JOIN t USING (k))
{_channels('any', 'true')} UNION ALL {_channels('all', 'wanted DESC')}""",
    "sample_decisions": f"""
WITH s AS (SELECT p_partkey AS k, ['{MATCH}', '{PARTIAL}', '{MISMATCH}', '{UNCONFIRMED}', '', '?'][1 + p_partkey % 6] AS s, p_partkey % 5 = 0 AS blocked, trim(['AB', 'A', 'XY', ' '][1 + (p_partkey // 6) % 4]) AS v FROM part)
SELECT k AS p_partkey, CASE WHEN k % 11 = 0 THEN CASE WHEN k % 2 = 0 THEN '{MATCH}' ELSE '{MISMATCH}' END WHEN k % 7 = 0 AND NOT blocked AND s NOT IN ('', '?') THEN '{MATCH}' WHEN s IN ('{MATCH}', '{UNCONFIRMED}') THEN CASE WHEN blocked THEN '{PARTIAL}' ELSE '{MATCH}' END
  WHEN s IN ('{PARTIAL}', '{MISMATCH}') THEN s WHEN v = '' THEN '{MISMATCH}' WHEN k % 8 = 0 THEN '{PARTIAL}' WHEN v = 'AB' THEN CASE WHEN blocked THEN '{PARTIAL}' ELSE '{MATCH}' END WHEN v = 'A' THEN '{PARTIAL}' ELSE '{MISMATCH}' END AS decision FROM s""",
}
