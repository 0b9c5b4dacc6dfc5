"""Review queries: policies over several readings, the work list, merged projections and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FAILED, MATCH, MISMATCH, PASS, REJECT, REVIEW, WAITING
from ..operators import review
from ..sources.tables import table


def _verdict():
    part = F.col("part")
    return F.when(part % 3 == 0, MATCH).when(part % 3 == 1, MISMATCH).alias("status"), (part % 2 == 0).alias("reliable")


def _readings(spark, sf_dir):
    """Line items as readings of an order: status, trust and date follow from the part."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("required"))
    part = F.col("part")
    return i.join(o, "l_orderkey").select(
        "l_orderkey",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        "part",
        "required",
        *_verdict(),
        (part % 5 != 0).alias("usable"),
        F.when(part % 4 != 0, F.date_add("required", (part % 7 - 3).cast("int"))).alias("actual"),
    )


_READINGS = f"""
i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
r AS (
  SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS pos, part, CAST(o_orderdate AS DATE) AS required,
    CASE part % 3 WHEN 0 THEN '{MATCH}' WHEN 1 THEN '{MISMATCH}' END AS status, part % 2 = 0 AS reliable, part % 5 <> 0 AS usable,
    CASE WHEN part % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(part % 7 - 3 AS INTEGER) END AS actual
  FROM i JOIN orders ON l_orderkey = o_orderkey)
"""


def signature_modes(spark, sf_dir):
    """Signature checks of orders under both modes (MCH-26)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    found = review.signature_modes(lines.select("l_orderkey", *_verdict()), ["l_orderkey"])
    return found.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


def date_variants(spark, sf_dir):
    """The chosen date of each order (MCH-23, SET-08)."""
    k = F.col("l_orderkey")
    readings = _readings(spark, sf_dir).withColumns({"mode": F.when(k % 4 == 0, "any").when(k % 4 == 1, "all").when(k % 4 == 2, "none"), "required": F.when(F.col("pos") % 3 != 0, F.col("required"))})
    return review.date_variant(readings, ["l_orderkey"], "mode").withColumn("actual", F.col("actual").cast("string"))


def confirmations(spark, sf_dir):
    """What the confirmation of each order lacks (MCH-44)."""
    k = F.col("o_orderkey")
    gaps = review.confirmation_missing({
        "review_status": F.when(k % 13 != 0, "确认通过"), "final_result": F.when(k % 26 == 0, PASS), "overall": F.when(k % 11 != 0, PASS), "seal_mode": F.when(k % 3 == 0, "none"), "date_mode": F.when(k % 10 == 3, "none"), "signature_mode": F.when(k % 4 == 0, F.when(k % 8 == 0, "any").otherwise("all")),
        "standard_requirement": F.when(k % 7 != 1, "x"), "standard_status": F.when(k % 2 == 0, "matched"), "human_match": k % 5 == 1, "date_actual": F.when(k % 5 != 0, "2025-01-01"), "date_status": F.when(k % 9 != 0, MATCH), "date_reliable": k % 17 != 0,
        "seal_read": F.when(k % 7 != 0, "x").otherwise(""), "seal_status": F.lit(MATCH), "seal_reliable": k % 19 != 0, "signature_status": F.when(k % 16 == 0, MATCH), "signature_reliable": F.lit(True),
    })
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(gaps, ",").alias("missing"))


def _listed(spark, sf_dir):
    s = F.col("o_orderstatus")
    overall = F.when(s == "F", PASS).when(s == "O", WAITING).otherwise("?")
    final = F.when(F.col("o_orderkey") % 9 == 0, REJECT).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", review.list_status(F.col("o_orderkey") % 7 == 0, final, overall).alias("status"))


def work_counts(spark, sf_dir):
    """Orders by status of the work list (FLT-10, AGG-06)."""
    return review.list_counts(_listed(spark, sf_dir), F.col("status"))


def work_page(spark, sf_dir):
    """The work list's second page of forty (SRT-02, LIM-02)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("created"), "o_orderpriority")
    return o.orderBy(*review.list_order(F.col("created"), F.col("o_orderkey"), F.col("o_orderpriority"))).offset(40).limit(40)


def last_files(spark, sf_dir):
    """The last reading of each file; every thirteenth has no name (WIN-06)."""
    name = F.when(F.col("part") % 13 == 0, " ").otherwise(F.concat(F.lit("f"), (F.col("part") % 50).cast("string")))
    return review.last_file_wins(_readings(spark, sf_dir).select("pos", name.alias("file")), "file", "pos")


def spans_apart(spark, sf_dir):
    """Whether the orders of a customer, each open for some days, follow each other (WIN-18)."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("s"), (start + F.col("o_orderkey") % 60).alias("e"))
    return review.apart(o, "o_custkey", "s", "e", "o_orderkey")


def merged_calls(spark, sf_dir):
    """Readings as two projections of remote tasks (JOIN-23)."""
    part = F.col("part")
    calls = _readings(spark, sf_dir).select(
        (part % 2).alias("method"),
        F.when(part % 11 != 0, F.col("l_orderkey") % 97).alias("task"),
        "pos",
        (part % 3 == 0).alias("invoked"),
        F.when(part % 5 != 0, part % 100).alias("seconds"),
        F.when(part % 4 != 0, part % 10).alias("note"),
    )
    return review.merge_calls(calls, "task", "method", "pos", ["seconds"], ["note"])


def merged_lists(spark, sf_dir):
    """Artifacts of each order from three sources, and covers with overrides (REC-03, REC-12, SET-02)."""
    k = F.col("o_orderkey")
    items = review.merge_lists(F.array(k % 3, k % 5), F.when(k % 2 == 0, F.array(k % 5, k % 7)), F.array(k % 3, k % 11))
    change = F.when(k % 4 == 0, F.struct(F.when(k % 8 == 0, "X").alias("o_orderstatus"), F.lit("me").alias("o_orderpriority")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(items.cast("array<string>"), ",").alias("items"), "o_orderstatus", "o_orderpriority", change.alias("change"))
    return review.overridden(o, "change", ["o_orderstatus", "o_orderpriority"])


def rerun_plans(spark, sf_dir):
    """Parts to run again: one plan has accepted negatives, the other none (AGG-47)."""
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    unsafe = review.rerun_plan(p, "p_brand", size % 2 == 0, size != 10, key % 2 == 0).withColumn("plan", F.lit("unsafe"))
    return unsafe.union(review.rerun_plan(p, "p_brand", size % 2 == 0, size > 0, key % 2 == 0).withColumn("plan", F.lit("safe")))


def separable(spark, sf_dir):
    """Prices of large and small parts of each brand (AGG-46)."""
    return review.separability(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", F.col("p_size") > 25)


def standards(spark, sf_dir):
    """Parts grouped by brand; those of even size have no requirement (AGG-49)."""
    need = F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_type"))
    return review.standard_groups(table(spark, sf_dir, "part").select("p_brand", "p_partkey", need.alias("need")), "p_brand", "need", "p_partkey")


def batch_spans(spark, sf_dir):
    """Customers as batches of their orders (JOIN-04)."""
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(3).alias("total"), (F.col("c_custkey") % 5).alias("completed"))
    day = F.col("o_orderdate").cast("date").cast("string")
    j = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(day).alias("started"), day.alias("finished"))
    return review.batch_times(b, j, "k")


QUERIES = {
    f.__name__: f
    for f in (signature_modes, date_variants, confirmations, work_counts, work_page, last_files, spans_apart, merged_calls, merged_lists, rerun_plans, separable, standards, batch_spans)
}

_RERUN = "SELECT DISTINCT p_brand, {blocked} AS blocked, '{plan}' AS plan FROM part WHERE p_size % 2 = 0 AND {where}"

ORACLE_SQL = {
    "signature_modes": f"""
WITH {_READINGS},
g AS (
  SELECT l_orderkey, bool_or(coalesce(status = '{MATCH}' AND reliable, false)) AS one, bool_and(coalesce(status = '{MATCH}' AND reliable, false)) AS each_,
    bool_and(coalesce(status = '{MISMATCH}' AND reliable, false)) AS none FROM r GROUP BY l_orderkey),
m AS (SELECT l_orderkey, one AS matched, none, false AS every FROM g UNION ALL SELECT l_orderkey, each_, none, true FROM g)
SELECT l_orderkey, CASE WHEN matched THEN '{MATCH}' WHEN none THEN '{MISMATCH}' ELSE '{REVIEW}' END AS status, matched OR none AS reliable, every FROM m""",
    "date_variants": f"""
WITH {_READINGS},
q AS (SELECT * REPLACE (CASE WHEN pos % 3 <> 0 THEN required END AS required), CASE l_orderkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'all' WHEN 2 THEN 'none' ELSE '' END AS mode FROM r),
d AS (SELECT *, first_value(CASE WHEN usable THEN required END) OVER (PARTITION BY l_orderkey ORDER BY (usable AND required IS NOT NULL) DESC, pos) AS due, status = '{MATCH}' AND reliable IS TRUE AS sure FROM q),
g AS (SELECT * REPLACE (coalesce(sure, false) AS sure), CASE WHEN usable AND actual IS NOT NULL AND coalesce(sure, false) THEN 0 WHEN usable AND actual IS NOT NULL AND due IS NOT NULL THEN 1 WHEN usable THEN 2 ELSE 3 END AS grp FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY grp, CASE grp WHEN 1 THEN abs(actual - due) ELSE 0 END, pos) AS place FROM g),
c AS (SELECT l_orderkey, count(DISTINCT coalesce(CAST(actual AS VARCHAR), '') || '|' || coalesce(status, '')) FILTER (usable) > 1 AS conflict, bool_or(usable) AS found_any, bool_and(usable AND sure) AS every, bool_and(reliable) FILTER (usable) AS firm FROM g GROUP BY l_orderkey),
z AS (SELECT *, found_any AND CASE mode WHEN 'all' THEN NOT every WHEN 'any' THEN false WHEN 'none' THEN false ELSE conflict END AS up FROM n JOIN c USING (l_orderkey) WHERE place = 1)
SELECT l_orderkey, pos, CAST(actual AS VARCHAR) AS actual, CASE WHEN up THEN '{REVIEW}' ELSE status END AS status, NOT up AND reliable AND (NOT found_any OR mode <> '' OR firm) AS reliable, conflict FROM z""",
    "confirmations": f"""
WITH g AS (
  SELECT o_orderkey AS k, o_orderkey, concat_ws(',', CASE WHEN k % 3 <> 0 AND k % 7 <> 1 AND k % 2 <> 0 AND k % 5 <> 1 THEN 'standard' END, CASE WHEN k % 10 <> 3 AND (k % 5 = 0 OR k % 9 = 0 OR k % 17 = 0) THEN 'date' END,
    CASE WHEN k % 3 <> 0 AND (k % 7 = 0 OR k % 19 = 0) THEN 'seal' END, CASE WHEN k % 4 = 0 AND k % 16 <> 0 THEN 'signature' END) AS missing FROM orders)
SELECT o_orderkey, CASE WHEN k % 13 = 0 AND k % 26 <> 0 THEN '' WHEN missing = '' AND k % 11 = 0 THEN 'verdict' ELSE missing END AS missing FROM g""",
    "work_counts": f"""
WITH g AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN '{review.PROCESSING}' WHEN o_orderkey % 9 = 0 THEN '{REJECT}' WHEN o_orderstatus = 'F' THEN '{PASS}' WHEN o_orderstatus = 'O' THEN '{REVIEW}' ELSE '?' END AS status
  FROM orders)
SELECT status, count(*) AS n FROM g WHERE status IN ('{review.PROCESSING}', '{PASS}', '{REVIEW}', '{REJECT}', '{FAILED}') GROUP BY status UNION ALL SELECT '', count(*) FROM orders""",
    "work_page": """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created, o_orderpriority FROM orders ORDER BY 2 DESC, 1 DESC, 3 DESC LIMIT 40 OFFSET 40""",
    "last_files": f"""
WITH {_READINGS},
f AS (SELECT pos, CASE WHEN part % 13 = 0 THEN ' ' ELSE 'f' || part % 50 END AS file FROM r)
SELECT max(pos) AS pos, file, min(pos) AS "first" FROM f GROUP BY file, CASE WHEN file = ' ' THEN pos END""",
    "spans_apart": """
WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS s, CAST(o_orderdate AS DATE) - DATE '1990-01-01' + o_orderkey % 60 AS e FROM orders),
l AS (SELECT o_custkey, s, lag(e) OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) AS before FROM s)
SELECT o_custkey, bool_and(before IS NULL OR s >= before) AS apart FROM l GROUP BY o_custkey""",
    "merged_calls": f"""
WITH {_READINGS},
c AS (
  SELECT part % 2 AS method, CASE WHEN part % 11 <> 0 THEN l_orderkey % 97 END AS task, pos, part % 3 = 0 AS invoked, CASE WHEN part % 5 <> 0 THEN part % 100 END AS seconds,
    CASE WHEN part % 4 <> 0 THEN part % 10 END AS note FROM r),
k AS (SELECT *, CASE WHEN task IS NULL THEN pos END AS own FROM c),
w AS (SELECT *, min(CASE WHEN invoked THEN pos END) OVER (PARTITION BY method, task, own) AS since FROM k)
SELECT method, task, min(pos) AS pos, bool_or(invoked) AS invoked, arg_max(seconds, pos) FILTER (seconds IS NOT NULL AND (invoked OR since IS NULL OR pos < since)) AS seconds,
  arg_max(note, pos) FILTER (note IS NOT NULL) AS note FROM w GROUP BY method, task, own""",
    "merged_lists": """
WITH l AS (
  SELECT o_orderkey, unnest([o_orderkey % 3, o_orderkey % 5] || CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 5, o_orderkey % 7] ELSE [] END || [o_orderkey % 3, o_orderkey % 11]) AS x,
    generate_subscripts([o_orderkey % 3, o_orderkey % 5] || CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 5, o_orderkey % 7] ELSE [] END || [o_orderkey % 3, o_orderkey % 11], 1) AS i FROM orders),
f AS (SELECT o_orderkey, x, min(i) AS i FROM l GROUP BY o_orderkey, x),
a AS (SELECT o_orderkey, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS items FROM f GROUP BY o_orderkey)
SELECT o_orderkey, items, CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'me' ELSE o_orderpriority END AS o_orderpriority, o_orderkey % 4 = 0 AS applied
FROM orders JOIN a USING (o_orderkey)""",
    "rerun_plans": " UNION ALL ".join(
        [
            _RERUN.format(blocked="true", plan="unsafe", where="p_size = 10"),
            _RERUN.format(blocked="false", plan="unsafe", where="p_partkey % 2 = 0 AND p_size <> 10 AND NOT EXISTS (SELECT 1 FROM part WHERE p_size = 10)"),
            _RERUN.format(blocked="false", plan="safe", where="p_partkey % 2 = 0"),
        ]
    ),
    "separable": """
SELECT p_brand, max(p_retailprice) FILTER (p_size > 25) AS positive, max(p_retailprice) FILTER (p_size <= 25) AS negative,
  coalesce(max(p_retailprice) FILTER (p_size > 25) > max(p_retailprice) FILTER (p_size <= 25), false) AS separable FROM part GROUP BY p_brand""",
    "standards": """
SELECT p_brand, min(p_partkey) AS "first", count(*) AS n FROM part GROUP BY p_brand, CASE WHEN p_size % 2 = 0 THEN p_partkey END""",
    "batch_spans": """
WITH j AS (
  SELECT o_custkey AS k, min(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END) AS started, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS finished FROM orders GROUP BY o_custkey)
SELECT c_custkey AS k, 3 AS total, c_custkey % 5 AS completed, coalesce(started, '') AS started, CASE WHEN c_custkey % 5 >= 3 THEN coalesce(finished, '') ELSE '' END AS finished
FROM customer LEFT JOIN j ON c_custkey = k""",
}
