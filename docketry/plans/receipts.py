"""Receipt queries: listing, verdicts, current versions, filters, joins and sets over orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PASS, REJECT, REVIEW, UNREAD
from ..functions.dates import compare_dates
from ..operators.decision import Check, Policy, is_reliable, verdict
from ..operators.latest import counts_with_total, latest, latest_preferring, newest_by, page
from ..operators.reconcile import numeric_row_order
from ..sources.sinks import insert_or_ignore, merge_rows
from ..sources.tables import by_ids, overlay, table


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per order: its rows counted, its date and seal checked, and the verdict."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_rows"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").cast("date").alias("actual"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_returnflag") == "N").alias("open"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))
    joined = orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    late = F.when(F.col("actual") > F.date_add("ordered", 60), F.date_add("ordered", 60)).otherwise(F.col("actual"))
    date_status, days = compare_dates(late, F.col("actual"))
    seal = F.when(F.col("n_rows").isNull(), UNREAD).when(F.col("returned") > 0, MISMATCH).otherwise(MATCH)
    out = joined.select("o_orderkey", "o_custkey", F.col("ordered").cast("string").alias("ordered"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"), date_status.alias("date_status"), days.alias("days_late"), seal.alias("seal_status"))
    reliable = is_reliable(F.col("seal_status"))
    check = verdict(Policy(), Check(F.col("date_status"), is_reliable(F.col("date_status"))), Check(F.col("seal_status"), reliable))
    return out.withColumn("overall", check)


_RECEIPTS = f"""
r AS (SELECT l_orderkey, count(*) AS n_rows, sum(l_quantity) AS quantity, max(l_shipdate)::DATE AS actual, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS ordered, n_rows, quantity, actual, returned, least(actual, o_orderdate::DATE + 60) AS required FROM orders LEFT JOIN r ON o_orderkey = l_orderkey),
s AS (SELECT o_orderkey, o_custkey, ordered::VARCHAR AS ordered, coalesce(n_rows, 0) AS n_rows, coalesce(quantity, 0.0) AS quantity,
  CASE WHEN actual IS NULL THEN '无法判断' WHEN actual = required THEN '{MATCH}' ELSE '{MISMATCH}' END AS date_status, (actual - required)::INTEGER AS days_late,
  CASE WHEN n_rows IS NULL THEN '{UNREAD}' WHEN returned > 0 THEN '{MISMATCH}' ELSE '{MATCH}' END AS seal_status FROM j),
receipts AS (SELECT *, CASE WHEN date_status = '无法判断' OR seal_status = '{UNREAD}' THEN '{REVIEW}' WHEN date_status = '{MISMATCH}' OR seal_status = '{MISMATCH}' THEN '{REJECT}' ELSE '{PASS}' END AS overall FROM s)
"""


def receipt_listing(spark, sf_dir):
    """The newest receipt of each customer (SRC-02, WIN-01, MCH-29)."""
    r = _receipts(spark, sf_dir)
    rest = [c for c in r.columns if c != "o_custkey"]
    return newest_by(r, ["o_custkey"], rest, ["ordered", "o_orderkey"])


def receipt_status_counts(spark, sf_dir):
    return counts_with_total(_receipts(spark, sf_dir), "overall")


def receipt_page_2(spark, sf_dir):
    return page(_receipts(spark, sf_dir), [F.desc("ordered"), F.desc("o_orderkey")], 20, 20)


def pending_filter_then_limit(spark, sf_dir):
    """The 50 newest receipts that need no pass: the limit follows the filter (LIM-01)."""
    return page(_receipts(spark, sf_dir).filter(F.col("overall") != PASS), [F.desc("o_orderkey")], 0, 50)


def pending_limit_then_filter(spark, sf_dir):
    """Of the 50 newest receipts those that didn't pass: the limit comes first (LIM-01)."""
    return page(_receipts(spark, sf_dir), [F.desc("o_orderkey")], 0, 50).filter(F.col("overall") != PASS)


def latest_order_preferring(spark, sf_dir):
    """The newest order of each customer and status, finished ones before all others (WIN-02)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return latest_preferring(o, ["o_custkey"], F.col("o_orderstatus") == "F", [F.desc("o_orderkey")])


def latest_event(spark, sf_dir):
    """The newest event of each user and type (WIN-04)."""
    e = table(spark, sf_dir, "events")
    return newest_by(e, ["user_id", "event_type"], ["event_id", "value"], ["ts", "event_id"])


def latest_completed(spark, sf_dir):
    """The newest purchase or error of each user (WIN-05)."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return newest_by(e, ["user_id"], ["event_id", "event_type"], ["ts", "event_id"])


def contains_search(spark, sf_dir):
    """Customers with the term in name or segment, whatever its case (FLT-01, FLT-03)."""
    c = table(spark, sf_dir, "customer")
    return c.filter(F.contains(F.lower(F.concat_ws("\n", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey", "c_name", "c_mktsegment")


def prefix_search(spark, sf_dir):
    """Parts whose name or brand starts with the term (FLT-02, FLT-04)."""
    p = table(spark, sf_dir, "part")
    hit = lambda c: F.startswith(F.lower(c), F.lit("brand#1"))
    return p.filter(hit("p_name") | hit("p_brand")).select("p_partkey", "p_brand")


def exact_filters(spark, sf_dir):
    """Receipts of one day, status and verdict (FLT-06)."""
    r = _receipts(spark, sf_dir)
    return r.filter(F.startswith("ordered", F.lit("1995")) & (F.col("date_status") == MISMATCH) & (F.col("overall") == REJECT)).select("o_orderkey", "ordered")


def group_day_expansion(spark, sf_dir):
    """Rows shipped on the first day, with all rows of orders that shipped any then (FLT-07, JOIN-08)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("day"))
    day = rows.agg(F.min("day").alias("day")).first()["day"]  # one value
    return rows.join(rows.filter(F.col("day") == F.lit(day)).select("l_orderkey").distinct(), "l_orderkey", "left_semi")


def semi_live(spark, sf_dir):
    """Customers with an open order (JOIN-06)."""
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


def anti_orphan(spark, sf_dir):
    """Customers without an urgent order (JOIN-07)."""
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_acctbal")


def left_residual(spark, sf_dir):
    """Customers with their urgent orders, and all others once (JOIN-02)."""
    urgent = table(spark, sf_dir, "orders").filter(F.startswith("o_orderpriority", F.lit("1")))
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"), F.min("o_orderkey").alias("first_order"))


def id_scope(spark, sf_dir):
    """Orders of a list of ids (SRC-04)."""
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return by_ids(table(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_orderstatus")


def overlay_full_outer(spark, sf_dir):
    """Suppliers with the balances of customers of the same number put over theirs, without those in nation 3 (SRC-11)."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    over = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), (F.col("c_nationkey") == 3).alias("deleted"))
    return overlay(base, over, "k", "deleted")


def upsert_newest(spark, sf_dir):
    """Latest value per user and type of two halves of the event log merged (SNK-06, SNK-07)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old = newest_by(e.filter("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id", "value"], ["event_id"])
    return merge_rows(old, e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def first_writer(spark, sf_dir):
    """The first order of each customer, finished ones before the rest (SNK-09)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    done = newest_by(o.filter("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], ["o_orderkey"])
    return insert_or_ignore(done, o, ["o_custkey"], "o_orderkey")


def numeric_order(spark, sf_dir):
    """Rows in the order of their numbers where these are unique, else by position (WIN-20)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"))
    return numeric_row_order(rows, ["l_orderkey"], "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.bool_and("numeric").alias("numeric"), F.max("place").alias("rows"), F.max_by("l_partkey", "place").alias("last_part"))


def union_ids(spark, sf_dir):
    """Nations of customers or suppliers, of both, and of customers only (SET-01 to SET-07)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    tagged = lambda df, name: df.select(F.lit(name).alias("kind"), "nation")
    return tagged(c.union(s).distinct(), "union").union(tagged(c.intersect(s), "both")).union(tagged(c.subtract(s), "customers"))


def top_orders_per_segment(spark, sf_dir):
    """The three largest orders of each segment (LIM-04, WIN-07)."""
    from pyspark.sql import Window

    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return joined.select("c_mktsegment", "o_orderkey", "o_totalprice", rank.alias("place")).filter("place <= 3")


def newest_per_nation(spark, sf_dir):
    """The customer of the highest balance in each nation, with names (JOIN-20, WIN-01)."""
    best = latest(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"])
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return best.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "c_custkey", "c_acctbal")


_FNS = [receipt_listing, receipt_status_counts, receipt_page_2, pending_filter_then_limit, pending_limit_then_filter, latest_order_preferring, latest_event, latest_completed, contains_search, prefix_search, exact_filters, group_day_expansion,
        semi_live, anti_orphan, left_residual, id_scope, overlay_full_outer, upsert_newest, first_writer, numeric_order, union_ids, top_orders_per_segment, newest_per_nation]
QUERIES = {f.__name__: f for f in _FNS}
_NEWEST = "SELECT {keys}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"
ORACLE_SQL = {
    "receipt_listing": f"WITH {_RECEIPTS} SELECT o_custkey, o_orderkey, ordered, n_rows, quantity, date_status, days_late, seal_status, overall FROM receipts QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ordered DESC, o_orderkey DESC) = 1",
    "receipt_status_counts": f"WITH {_RECEIPTS} SELECT overall AS status, count(*) AS n FROM receipts GROUP BY 1 UNION ALL SELECT '', count(*) FROM receipts",
    "receipt_page_2": f"WITH {_RECEIPTS} SELECT * FROM receipts ORDER BY ordered DESC, o_orderkey DESC LIMIT 20 OFFSET 20",
    "pending_filter_then_limit": f"WITH {_RECEIPTS} SELECT * FROM receipts WHERE overall <> '{PASS}' ORDER BY o_orderkey DESC LIMIT 50",
    "pending_limit_then_filter": f"WITH {_RECEIPTS} SELECT * FROM (SELECT * FROM receipts ORDER BY o_orderkey DESC LIMIT 50) WHERE overall <> '{PASS}'",
    "latest_order_preferring": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) = 1",
    "latest_event": _NEWEST.format(keys="user_id, event_type", cols="event_id, value", order="ts DESC, event_id DESC", source="events"),
    "latest_completed": _NEWEST.format(keys="user_id", cols="event_id, event_type", order="ts DESC, event_id DESC", source="(SELECT * FROM events WHERE event_type IN ('purchase', 'error'))"),
    "contains_search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name || chr(10) || c_mktsegment) LIKE '%build%'",
    "prefix_search": "SELECT p_partkey, p_brand FROM part WHERE lower(p_name) LIKE 'brand#1%' OR lower(p_brand) LIKE 'brand#1%'",
    "exact_filters": f"WITH {_RECEIPTS} SELECT o_orderkey, ordered FROM receipts WHERE ordered LIKE '1995%' AND date_status = '{MISMATCH}' AND overall = '{REJECT}'",
    "group_day_expansion": "SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS day FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate::DATE = (SELECT min(l_shipdate)::DATE FROM lineitem))",
    "semi_live": "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "anti_orphan": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "left_residual": "SELECT c_custkey, count(o_orderkey) AS urgent, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%' GROUP BY 1",
    "id_scope": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
    "overlay_full_outer": "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(c_acctbal, s_acctbal) AS balance, s_nationkey AS nation FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = s_suppkey WHERE coalesce(c_nationkey, -1) <> 3",
    "upsert_newest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "first_writer": "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS o_orderkey, coalesce(max(o_orderstatus) FILTER (o_orderstatus = 'F'), arg_min(o_orderstatus, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1",
    "numeric_order": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), s AS (SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AS numeric, count(*)::INTEGER AS rows FROM r GROUP BY 1) SELECT l_orderkey, any_value(numeric) AS numeric, any_value(rows) AS rows, CASE WHEN any_value(numeric) THEN arg_max(l_partkey, l_linenumber) ELSE max(l_partkey) END AS last_part FROM r JOIN s USING (l_orderkey) GROUP BY 1",
    "union_ids": "SELECT 'union' AS kind, * FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "top_orders_per_segment": "SELECT c_mktsegment, o_orderkey, o_totalprice, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 3",
    "newest_per_nation": "SELECT n_name, r_name, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1",
}
