"""Matching, correction and evidence queries over parts, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PARTIAL, PASS, UNREAD, WAITING
from ..operators import matching
from ..sources.tables import table
from .analytics import _CELLS, _cells


def _titles(spark, sf_dir):
    """Brand and type of each part, and the same with a letter lost, doubled or none changed."""
    t = F.concat_ws(" ", "p_brand", "p_type")
    cut = F.pmod(F.col("p_partkey"), F.length("p_type")).cast("int") + F.length("p_brand") + 2
    damaged = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(t, F.lit(1), cut - 1), F.substring(t, cut + 1, F.length(t)))).when(F.col("p_partkey") % 3 == 1, F.concat(F.substring(t, F.lit(1), cut), F.substring(t, cut, F.length(t)))).otherwise(t)
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("title"), damaged.alias("reading"))


_TITLES = "t AS (SELECT p_partkey, p_brand || ' ' || p_type AS title, p_partkey % length(p_type) + length(p_brand) + 2 AS cut FROM part), d AS (SELECT p_partkey, title, CASE p_partkey % 3 WHEN 0 THEN substr(title, 1, cut - 1) || substr(title, cut + 1) WHEN 1 THEN substr(title, 1, cut) || substr(title, cut) ELSE title END AS reading FROM t)"


def name_correction(spark, sf_dir):
    """Damaged titles put right by the list of titles (MCH-14)."""
    t = _titles(spark, sf_dir)
    return matching.correct_names(t.select("p_partkey", "reading"), t, "reading", "title").select("p_partkey", "reading", "corrected", "edits")


def best_readings(spark, sf_dir):
    """The reading of each brand that compares best with its first title (MCH-01, WIN-09)."""
    t = _titles(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    first = t.groupBy("p_brand").agg(F.min_by("title", "p_partkey").alias("wanted"))
    return matching.best_candidate(t.join(first, "p_brand"), ["p_brand"], "wanted", "reading", "p_partkey")


def code_policies(spark, sf_dir):
    """Part codes with letters O for zeros, or a dot too many (MCH-09, MCH-10, MCH-12)."""
    e = F.concat(F.lit("AB"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.col("p_brand"))
    a = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("AB"), F.translate(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), "0", "O"), F.col("p_brand"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("AB."), F.substring(e, F.lit(3), F.length(e)))).when(F.col("p_partkey") % 4 == 2, F.concat(F.substring(e, F.lit(4), F.length(e)), F.substring(e, 1, 3))).otherwise(F.lower(e))
    return table(spark, sf_dir, "part").select("p_partkey", matching.zero_letter_match(e, a, F.lit(3), F.lit(6)).alias("zero"), matching.extra_dot(e, a, F.lit(2)).alias("dot"), matching.is_rotation(a, e).alias("rotation"))


def signatures(spark, sf_dir):
    """Whether the nation of each customer is among three others (MCH-25)."""
    n = F.col("c_nationkey")
    receiver = F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.concat_ws(" ", F.lit("N"), n.cast("string")))
    contacts = F.array(*[F.concat(F.lit("N"), F.pmod(F.col("c_custkey") * k, F.lit(25)).cast("string")) for k in (1, 2, 3)])
    return table(spark, sf_dir, "customer").select("c_custkey", matching.signature(receiver, contacts).alias("status"))


def standard_checks(spark, sf_dir):
    """Suppliers' parts as stamps: flag as text, status as shape, both needed on one row (MCH-28)."""
    rows = table(spark, sf_dir, "lineitem")
    return matching.joint_standard(rows, ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


def filter_vocabulary(spark, sf_dir):
    """Cells that each filter lets through, by channel (FLT-12)."""
    conditions = matching.statistics_filters(F.col("state"), F.col("decision"), F.col("expected"))
    return _cells(spark, sf_dir).groupBy("channel").agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def pending(spark, sf_dir):
    """Orders whose verdict waits (MCH-30)."""
    verdict = F.when(F.col("o_totalprice") > 250000, PASS).otherwise(MISMATCH)
    shown = matching.pending_verdict(verdict, F.col("o_orderstatus") == "P", F.startswith("o_orderpriority", F.lit("1")))
    return table(spark, sf_dir, "orders").groupBy(shown.alias("shown"), "o_orderstatus").agg(F.count("*").alias("n"))


def newest_readings(spark, sf_dir):
    """The newest eligible outcome of each user and type, empty ones included (REC-11)."""
    e = table(spark, sf_dir, "events").withColumn("reading", F.when(F.col("event_id") % 4 != 0, F.col("props")))
    return matching.newest_outcomes(e, ["user_id", "event_type"], F.col("value") >= 2, ["ts", "event_id"], ["event_id", "reading"])


def traces(spark, sf_dir):
    """Events of a user and day as calls of two branches (REC-10)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), at.alias("a"), F.when(F.col("event_id") % 31 != 0, at + 5_000_000).alias("b"), F.when(F.col("event_id") % 29 != 0, F.col("event_id") % 50).alias("secs"), (F.col("event_id") % 2).alias("branch"))
    return matching.combine_traces(e, ["user_id", "day"], "a", "b", "secs", 2)


def order_digests(spark, sf_dir):
    """A digest of each customer's orders (AGG-44)."""
    return matching.fingerprint(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


def company_coverage(spark, sf_dir):
    """Of each nation's customers, how many have an order of each status, and whether all have one (AGG-26)."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("kinds"))
    j = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_if(F.col("kinds") == 3).alias("matched"), F.count_if(F.col("kinds").isNull()).alias("unlabeled"), F.bool_and(F.coalesce(F.col("kinds") == 3, F.lit(False))).alias("complete"))


_FNS = [name_correction, best_readings, code_policies, signatures, standard_checks, filter_vocabulary, pending, newest_readings, traces, order_digests, company_coverage]
QUERIES = {f.__name__: f for f in _FNS}
_RANK = f"CASE WHEN wanted = reading THEN 3 WHEN length(reading) < length(wanted) AND wanted LIKE '%' || array_to_string(string_split(reading, ''), '%') || '%' THEN 2 ELSE 1 END"
_CODE = "'AB' || lpad(p_partkey::VARCHAR, 6, '0') || p_brand"
ORACLE_SQL = {
    "name_correction": f"WITH {_TITLES}, n AS (SELECT DISTINCT title AS name FROM t), p AS (SELECT DISTINCT reading, name, levenshtein(reading, name) AS k FROM d JOIN n ON abs(length(reading) - length(name)) <= 2 AND regexp_extract_all(reading, '[0-9]+') = regexp_extract_all(name, '[0-9]+') WHERE levenshtein(reading, name) <= 2 AND 1 - levenshtein(reading, name)::DOUBLE / greatest(length(reading), length(name)) >= 0.85), b AS (SELECT reading, min(k) AS k FROM p GROUP BY 1), c AS (SELECT p.reading, any_value(name) AS corrected, any_value(p.k)::INTEGER AS edits FROM p JOIN b ON p.reading = b.reading AND p.k = b.k GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, d.reading, corrected, edits FROM d LEFT JOIN c ON d.reading = c.reading",
    "best_readings": f"WITH {_TITLES}, j AS (SELECT d.*, p_brand, first_value(title) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS wanted FROM d JOIN part USING (p_partkey)), r AS (SELECT *, {_RANK} AS r, levenshtein(wanted, reading) AS k FROM j) SELECT p_brand, reading, CASE r WHEN 3 THEN '{MATCH}' WHEN 2 THEN '{PARTIAL}' ELSE '{MISMATCH}' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r DESC, k, p_partkey) = 1",
    "code_policies": f"WITH c AS (SELECT p_partkey, {_CODE} AS e, CASE p_partkey % 4 WHEN 0 THEN 'AB' || replace(lpad(p_partkey::VARCHAR, 6, '0'), '0', 'O') || p_brand WHEN 1 THEN 'AB.' || substr({_CODE}, 3) WHEN 2 THEN substr({_CODE}, 4) || substr({_CODE}, 1, 3) ELSE lower({_CODE}) END AS a FROM part) SELECT p_partkey, length(e) = length(a) AND e <> a AND substr(e, 1, 2) || replace(substr(e, 3, 6), 'O', '0') || substr(e, 9) = substr(a, 1, 2) || replace(substr(a, 3, 6), 'O', '0') || substr(a, 9) AS zero, length(a) = length(e) + 1 AND substr(a, 3, 1) IN ('.', '·') AND substr(a, 1, 2) || substr(a, 4) = e AS dot, length(a) = length(e) AND contains(e || e, a) AS rotation FROM c",
    "signatures": f"SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '{UNREAD}' WHEN c_nationkey IN (c_custkey % 25, c_custkey * 2 % 25, c_custkey * 3 % 25) THEN '{MATCH}' ELSE '{MISMATCH}' END AS status FROM customer",
    "standard_checks": "SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_linestatus = 'O') AS both, bool_or(l_returnflag = 'R') AS text, bool_or(l_linestatus = 'O') AS shape FROM lineitem GROUP BY 1",
    "filter_vocabulary": f"WITH {_CELLS} SELECT channel, count(*) FILTER (state IN ('错误', '未识别', '失败')) AS errors, count(*) FILTER (state IN ('未识别', '失败')) AS missing, count(*) FILTER (state = '失败') AS failed, count(*) FILTER (state = '错误') AS wrong, count(*) FILTER (state = '未识别') AS unrecognized, count(*) FILTER (expected IS NULL) AS pending_truth, count(*) FILTER (state = '错误' AND expected = '{MISMATCH}' AND decision = '{MATCH}') AS false_accept, count(*) FILTER (state = '错误' AND expected = '{MATCH}' AND decision = '{MISMATCH}') AS false_reject, count(*) FILTER (state = '错误' AND decision = '{PARTIAL}') AS partial, count(*) FILTER (state = '正确') AS correct FROM cells GROUP BY 1",
    "pending": f"SELECT CASE WHEN o_orderstatus = 'P' AND (o_totalprice <= 250000 OR o_orderpriority LIKE '1%') THEN '{WAITING}' WHEN o_totalprice > 250000 THEN '{PASS}' ELSE '{MISMATCH}' END AS shown, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "newest_readings": "SELECT user_id, event_type, event_id, CASE WHEN event_id % 4 <> 0 THEN props END AS reading FROM events WHERE value >= 2 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "traces": "WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, epoch_us(ts) AS a, CASE WHEN event_id % 31 <> 0 THEN epoch_us(ts) + 5000000 END AS b, CASE WHEN event_id % 29 <> 0 THEN event_id % 50 END AS secs, event_id % 2 AS branch FROM events) SELECT user_id, day, min(a) AS start, max(b) AS \"end\", CASE WHEN count(*) = count(secs) THEN sum(secs)::BIGINT END AS sum, CASE WHEN count(*) = count(b) THEN max(b) - min(a) END AS wall, count(DISTINCT branch) >= 2 AS complete FROM e GROUP BY 1, 2",
    "order_digests": "SELECT o_custkey, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT o_custkey, sha256(o_orderkey || chr(1) || o_orderstatus) AS h FROM orders) GROUP BY 1",
    "company_coverage": "WITH k AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1) SELECT c_nationkey, count(*) AS customers, count(*) FILTER (kinds = 3) AS matched, count(*) FILTER (kinds IS NULL) AS unlabeled, bool_and(coalesce(kinds = 3, false)) AS complete FROM customer LEFT JOIN k ON c_custkey = o_custkey GROUP BY 1",
}
