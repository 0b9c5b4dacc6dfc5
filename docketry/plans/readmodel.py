"""Read-model queries: truth against results, JSON records, dates with missing parts, and lists of receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH
from ..functions import dates, text
from ..operators import evaluation, listing, readmodel
from ..sources.tables import table


def _truth(spark, sf_dir):
    """Orders as labelled receipts: every fifth without a date (half of them say so), those of priorities 1 and 2 due on their day, others a day later."""
    day = F.col("o_orderdate").cast("date")
    due = F.when(F.col("o_orderpriority") < "3", day).otherwise(F.date_add(day, 1))
    present = F.col("o_orderkey") % 5 != 0
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt"), present.alias("present"), F.when(present, day.cast("string")).when(F.col("o_orderkey") % 10 == 0, "").alias("day"), due.cast("string").alias("required"))


def _results(spark, sf_dir):
    """Line items as results of two readers: some blank, some of the wrong day."""
    day = F.col("o_orderdate").cast("date")
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    j = i.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    actual = F.when(F.col("part") % 4 == 0, "").when(F.col("part") % 4 == 1, F.date_add(day, 1).cast("string")).otherwise(day.cast("string"))
    status = F.when(F.col("part") % 3 == 0, MISMATCH).when(F.col("part") % 3 == 1, MATCH).otherwise("")
    backend = F.when(F.col("l_linenumber") % 3 == 0, " ").when(F.col("l_linenumber") % 3 == 1, "a").otherwise("b")
    seconds = F.when(F.col("part") % 7 != 0, (F.col("part") % 50).cast("double"))
    return j.select(F.col("l_orderkey").alias("receipt"), F.col("l_linenumber").alias("id"), backend.alias("backend"), actual.alias("actual"), status.alias("status"), (F.col("part") % 2 == 0).alias("reliable"), seconds.alias("seconds"))


def backend_dates(spark, sf_dir):
    """Date metrics of each reader on its newest results (JOIN-10, AGG-12, AGG-13, AGG-15)."""
    return evaluation.backend_metrics(_truth(spark, sf_dir), _results(spark, sf_dir), "receipt", "backend", "id")


def label_coverage(spark, sf_dir):
    """Customers as images, those with orders as labelled (AGG-17)."""
    return evaluation.coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


def label_counts(spark, sf_dir):
    """Labels of orders: an explicit one for urgent orders, else the reasons (AGG-16, SRT-06)."""
    reasons = F.array(F.lit(" late"), F.when(F.col("o_totalprice") > 200000, "late").otherwise("small "), F.lit(" "), F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", " urgent ").otherwise("").alias("explicit"), reasons.alias("reasons"))
    return evaluation.label_counts(o, "explicit", "reasons", "o_orderkey")


def json_summaries(spark, sf_dir):
    """A summary of each event's properties with one member that is always absent (PRJ-01, JSN-04, JSN-05)."""
    return table(spark, sf_dir, "events").select("event_id", readmodel.summary(F.col("props"), {"key": "$.k", "none": "$.x"}).alias("summary"))


def heads(spark, sf_dir):
    """Properties as columns, the event's own id over the payload's (PRJ-05)."""
    payload = F.to_json(F.struct(F.lit(-1).alias("event_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("payload")
    return readmodel.with_head(table(spark, sf_dir, "events").select("event_id", payload), "payload", "event_id long, k int", ["event_id"])


def _requests(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return readmodel.regroup(i, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


def json_rows(spark, sf_dir):
    """Line items of an order as one JSON array and back as rows (JSN-02, JSN-03, JOIN-09)."""
    r = _requests(spark, sf_dir).select("l_orderkey", F.concat(F.lit('{"requests":'), F.col("items"), F.lit("}")).alias("payload"))
    return readmodel.unnest(r, "payload", "$.requests", "struct<l_linenumber: long, l_partkey: long>", ["l_orderkey"]).select("l_orderkey", "place", F.col("item.l_partkey").alias("part"))


def field_split(spark, sf_dir):
    """Fields of a customer that are shown, the number of others, and a merge in which the newer known value wins (PRJ-06, MAP-02, MAP-03)."""
    f = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    newer = F.create_map(F.lit("name"), F.when(F.col("c_custkey") % 2 == 0, "new"), F.lit("extra"), F.lit("x"))
    shown, rest = readmodel.split_fields(f, ["name", "segment"])
    merged = readmodel.merge_known(f, newer)
    return table(spark, sf_dir, "customer").select("c_custkey", shown["segment"].alias("segment"), F.size(rest).alias("others"), merged["name"].alias("name"), F.size(merged).alias("members"))


def receipt_dates(spark, sf_dir):
    """Order dates, twenty years later, written in nine more or less damaged ways (DAT-02)."""
    d = F.add_months(F.col("o_orderdate").cast("date"), 240)
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    y, m, n = F.year("d").cast("string"), F.month("d").cast("string"), F.day("d").cast("string")
    ways = [[y, "-", m, "-", n], [y, m, "月", n, "日"], [m, "月", n, "日"], ["月", n, "日"], [y, "年", m, "月", n], ["1105年", m, "月", n, "日"], ["21127年", m, "月", n, "日"], [(F.year("d") + 1).cast("string"), "/", m, "/", n], [m, "月", n, "曰"]]
    written = F.array(*[F.concat(*[F.lit(p) if isinstance(p, str) else p for p in way]) for way in ways])
    shown = o.withColumn("written", F.element_at(written, (F.col("o_orderkey") % 9 + 1).cast("int")))
    return shown.select("o_orderkey", dates.receipt_date(F.col("written"), F.col("d")).cast("string").alias("found"))


def date_parts(spark, sf_dir):
    """Components that are missing or differ, loose dates, instants and deadlines of order dates (DAT-05, DAT-08, DAT-09, DAT-13)."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    missing, differ = dates.partial_conflicts(d, F.year(d) + (k % 2).cast("int"), F.when(k % 3 != 0, F.month(d)), F.when(k % 5 != 0, F.day(d)))
    shown = F.when(k % 4 == 0, F.concat(F.lit("on "), d.cast("string"))).otherwise(F.concat(F.year(d).cast("string"), F.lit("/"), F.month(d).cast("string"), F.lit("/"), F.day(d).cast("string")))
    at = dates.instant(F.concat(d.cast("string"), F.lit("T00:00:00"), F.when(k % 2 == 0, "+08:00").otherwise("")))
    day_zero = F.timestamp_seconds(F.lit(0))
    passed = (F.unix_micros(dates.deadline(at, 300)) - F.unix_micros(day_zero)) / 1000000
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("", missing).alias("missing"), F.concat_ws("", differ).alias("differ"), dates.loose_date(shown).alias("loose"), passed.cast("long").alias("deadline"))


def text_repairs(spark, sf_dir):
    """Labels stripped, sample numbers, differing characters and equal decimals (STR-06, STR-16, ARR-03, MAT-11)."""
    name = F.concat(F.lit("scan"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.when(F.col("c_custkey") % 2 == 0, "_02").otherwise(""), F.lit(".jpg"))
    digits, page = text.sample_number(name)
    other = F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "X").otherwise(""))
    balance = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.strip_label(F.concat(F.lit(" 客户： _"), F.col("c_mktsegment"), F.lit(" _")), "客户").alias("stripped"), digits.alias("digits"), page.alias("page"),
        F.concat_ws(",", text.differing_places(F.col("c_mktsegment"), other).cast("array<string>")).alias("places"), text.same_decimal(F.concat(F.lit(" "), balance, F.lit(" .0")), F.when(F.col("c_custkey") % 2 == 0, balance).otherwise("none")).alias("same"),
    )


def review_page(spark, sf_dir):
    """The second page of reviewable orders in review order, hydrated (SRT-01, FLT-08, LIM-03)."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("pages", F.when(k % 3 == 0, F.array(k + 1, k + 2)))
    free = listing.reviewable(o, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "pages")
    status = F.when(F.col("o_orderstatus") == "P", "需人工复核").otherwise("通过")
    order = listing.review_order(status, F.col("o_orderpriority") == "5-LOW", F.when(k % 2 == 0, F.col("o_orderdate")), F.lit("1990-01-01").cast("timestamp_ntz"), k)
    return listing.hydrate(free, table(spark, sf_dir, "orders"), "o_orderkey", order, 20, 20).select("o_orderkey", "o_custkey", "o_totalprice")


def jobs_then_records(spark, sf_dir):
    """Events as jobs of users as results, and customers no event names (JOIN-22)."""
    jobs = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("result"), F.col("event_id").alias("job"), F.col("event_type").alias("type"))
    return listing.jobs_then_records(jobs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("result")), "result", "job")


def spans_within(spark, sf_dir):
    """Short spans of users inside long ones (JOIN-24)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("a"))
    inner = e.filter("event_type = 'click'").withColumn("b", F.col("a") + 600)
    outer = e.filter("event_type = 'purchase'").withColumn("b", F.col("a") + 86400)
    return listing.within(inner, outer, "user_id", "a", "b").select("event_id", "user_id")


def senders(spark, sf_dir):
    """Line items as regions of an order's page that have another at their right (JOIN-25)."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 64 / 64).alias("x1"), (F.col("l_suppkey") % 16 / 16).alias("y1")).distinct()
    boxes = i.withColumn("x2", F.col("x1") + 0.25).withColumn("y2", F.col("y1") + 0.125)
    return listing.left_of_another(boxes, "page").select("page", "x1", "y1")


_FNS = [backend_dates, label_coverage, label_counts, json_summaries, heads, json_rows, field_split, receipt_dates, date_parts, text_repairs, review_page, jobs_then_records, spans_within, senders]
QUERIES = {f.__name__: f for f in _FNS}
ORACLE_SQL = {
    "backend_dates": """
WITH truth AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS present, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE::VARCHAR WHEN o_orderkey % 10 = 0 THEN '' END AS day,
        (o_orderdate::DATE + CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END)::VARCHAR AS required, o_orderdate::DATE AS d FROM orders),
  items AS (SELECT l_orderkey AS k, l_linenumber AS id, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
  newest AS (SELECT * FROM items WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY k, id % 3 ORDER BY id DESC) = 1),
  r AS (SELECT CASE id % 3 WHEN 1 THEN 'a' ELSE 'b' END AS backend, present, day, required,
        CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN (d + 1)::VARCHAR ELSE d::VARCHAR END AS actual, p, CASE WHEN day = required THEN 1 ELSE 0 END AS due FROM newest JOIN truth USING (k)),
  m AS (SELECT *, present AND p % 2 = 0 AND p % 3 < 2 AS decided FROM r)
SELECT backend, count(*) AS samples, round(count(*) FILTER (actual = day) / count(*), 4) AS accuracy, round(count(*) FILTER (present AND actual <> '') / count(*) FILTER (present), 4) AS detection,
  coalesce(round(count(*) FILTER (NOT present AND actual = '') / nullif(count(*) FILTER (NOT present), 0), 4), 0) AS abstention, round(count(*) FILTER (decided) / count(*), 4) AS decision_coverage,
  round(count(*) FILTER (decided AND p % 3 = due) / count(*) FILTER (decided), 4) AS decision_accuracy,
  round(avg(CASE WHEN p % 7 <> 0 THEN p % 50 END), 2) AS mean_seconds, count(*) FILTER (p % 7 <> 0) AS timed FROM m GROUP BY 1""",
    "label_coverage": """
SELECT count(*) AS images, count(o) AS labelled, count(*) - count(o) AS unlabelled, round(count(o) / count(*), 4) AS ratio
FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = c_custkey""",
    "label_counts": """
SELECT label, count(*) AS n, min(k) AS first_place FROM (
  SELECT DISTINCT o_orderkey AS k, unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN ['urgent'] WHEN o_totalprice > 200000 THEN ['late', o_orderstatus] ELSE ['late', 'small', o_orderstatus] END) AS label FROM orders)
GROUP BY 1""",
    "json_summaries": "SELECT event_id, '{\"key\":' || (props ->> '$.k') || '}' AS summary FROM events",
    "heads": "SELECT event_id, (props ->> '$.k')::INT AS k FROM events",
    "json_rows": """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, l_partkey AS part
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""",
    "field_split": "SELECT c_custkey, c_mktsegment AS segment, 1 AS others, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name, 4 AS members FROM customer",
    "receipt_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 NOT IN (5, 6, 7) THEN (o_orderdate::DATE + INTERVAL 20 YEAR)::DATE::VARCHAR END AS found FROM orders",
    "date_parts": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '月' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '日' ELSE '' END AS missing, CASE WHEN o_orderkey % 2 = 1 THEN '年' ELSE '' END AS differ,
  CASE WHEN o_orderkey % 4 = 0 THEN 'on ' ELSE '' END || o_orderdate::DATE::VARCHAR AS loose,
  CASE WHEN o_orderkey % 2 = 0 THEN (epoch(o_orderdate::DATE::TIMESTAMP) - 28800 + 300)::BIGINT END AS deadline FROM orders""",
    "text_repairs": """
SELECT c_custkey, c_mktsegment AS stripped, lpad(c_custkey::VARCHAR, 10, '0') AS digits, lpad(c_custkey::VARCHAR, 10, '0') || CASE WHEN c_custkey % 2 = 0 THEN '_02' ELSE '' END || '.jpg' AS page,
  CASE WHEN c_custkey % 3 = 0 THEN length(c_mktsegment)::VARCHAR ELSE '' END AS places, c_custkey % 2 = 0 AS same FROM customer""",
    "review_page": """
WITH busy AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT k FROM busy) AND NOT (o_orderkey % 3 = 0 AND (o_orderkey + 1 IN (SELECT k FROM busy) OR o_orderkey + 2 IN (SELECT k FROM busy)))
  ORDER BY CASE WHEN o_orderpriority = '5-LOW' THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '1990-01-01' END DESC, o_orderkey DESC LIMIT 20 OFFSET 20)""",
    "jobs_then_records": """
WITH jobs AS (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS result, event_id AS job, event_type AS type FROM events)
SELECT result, min(job) AS job, arg_min(type, job) AS type FROM jobs WHERE result IS NOT NULL GROUP BY 1
UNION ALL SELECT result, job, type FROM jobs WHERE result IS NULL
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT result FROM jobs WHERE result IS NOT NULL)""",
    "spans_within": """
WITH e AS (SELECT *, floor(epoch(ts)) AS a FROM events)
SELECT event_id, user_id FROM e AS i WHERE event_type = 'click'
  AND EXISTS (SELECT 1 FROM e AS o WHERE o.event_type = 'purchase' AND o.user_id = i.user_id AND i.a >= o.a AND i.a + 600 <= o.a + 86400)""",
    "senders": """
WITH b AS (SELECT DISTINCT l_orderkey AS page, (l_partkey % 64) / 64 AS x1, (l_suppkey % 16) / 16 AS y1 FROM lineitem)
SELECT page, x1, y1 FROM b AS l WHERE EXISTS (SELECT 1 FROM b AS r WHERE r.page = l.page AND r.x1 - (l.x1 + 0.25) >= 0.03 AND abs(r.y1 - l.y1) <= 0.15
  AND least(l.y1, r.y1) + 0.125 - greatest(l.y1, r.y1) >= 0.25 * 0.125)""",
}
