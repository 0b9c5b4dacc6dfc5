"""Record queries: accuracy of rows, issues, revisions, cascades, claims, spans and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..sources.tables import dealt, table


def row_cell_accuracy(spark, sf_dir):
    """Line items against a copy with changed, missing and added rows (AGG-11)."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("quantity"))
    kept = t.filter("part % 17 <> 0").withColumn("quantity", F.when(F.col("part") % 10 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")))
    added = t.filter("l_linenumber = 1").withColumn("l_linenumber", F.lit(99))
    return records.row_accuracy(t, kept.union(added), ["l_orderkey", "l_linenumber"], ["part", "quantity"])


def blocking(spark, sf_dir):
    """Issues of each user that block (FLT-13)."""
    code = F.when(F.col("event_type") == "view", "low_confidence").otherwise(F.col("event_type"))
    i = table(spark, sf_dir, "events").select("user_id", code.alias("code"), F.when(F.col("value") > 20, "date").when(F.col("value") > 5, "seal").otherwise("layout").alias("scope"), (F.length("props") > 8).alias("blocking"))
    return records.blocking_issues(i, ["user_id"], ["layout"], True)


def revisions(spark, sf_dir):
    """Digests of orders by content (JSN-07)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", records.revision(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).alias("revision"))


def cascade_delete(spark, sf_dir):
    """Orders left when finished ones of the first priority go, with all of the same customer and priority (SNK-11)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return records.delete_with_related(o, (F.col("o_orderstatus") == "F") & F.startswith("o_orderpriority", F.lit("1")), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_orderstatus")


def rename_cascade(spark, sf_dir):
    """Nations' customers under the names of their regions (SNK-14)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = n.filter("n_nationkey < 10").select(F.col("n_name").alias("old"), F.col("r_name").alias("new"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return records.renamed(c, names, "n_name").groupBy("n_name").agg(F.count("*").alias("customers"))


def shown_jobs(spark, sf_dir):
    """The event that stands for each user: the newest but sign-ups, errors first (JOIN-21)."""
    return records.displayed_job(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", F.col("event_type") == "signup", ["ts", "event_id"], ["event_id", "event_type"])


def claims(spark, sf_dir):
    """The order to be taken next of each priority, and in which turn (LIM-04, LIM-05)."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderpriority", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return records.lane_heads(o, "o_orderpriority", [F.col("day"), F.col("o_orderkey")])


def spans_recovered(spark, sf_dir):
    """Spans of events, ends missing where there is no value, children one id below (TIM-01, TIM-03, TIM-08)."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id") - F.col("event_id") % 10).alias("parent"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.col("event_id") % 100 * 1000).alias("secs"))
    e = e.withColumn("end", F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, F.col("start") - 1).otherwise(F.col("start") + F.col("secs")))
    return records.self_time(records.recovered_spans(e, "start", "end", "secs"), "event_id", "parent", "secs").select("event_id", "approximate", "own")


def best_dates(spark, sf_dir):
    """The ship date of each order by readings, agreement and requirement (WIN-12)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 30).alias("required"))
    i = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_trunc("month", "l_shipdate").cast("date").alias("day"), (F.col("l_discount") * 1000 + 0.5).cast("long").alias("percent")), "l_orderkey")
    j = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("required", F.date_trunc("month", "required").cast("date"))
    return records.best_date(j, ["l_orderkey"], "day", "percent", "required").withColumn("date", F.col("date").cast("string"))


def progress(spark, sf_dir):
    """Orders by joint state of order and items: waiting, partly shipped, done (AGG-08, AGG-27)."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("shipped"))
    j = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    bucket = F.when(F.col("shipped").isNull(), "missing").when(F.col("shipped") & (F.col("o_orderstatus") == "F"), "finished").when(F.col("shipped"), "received").when(F.col("o_orderstatus") == "P", "partial").otherwise("waiting")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("orders"))


def score_histogram(spark, sf_dir):
    """Events by type and tenth of their value's range up to 100 (AGG-41)."""
    bin_ = F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type", bin_.alias("bin")).agg(F.count("*").alias("n"))


def timing_medians(spark, sf_dir):
    """Median, calls and total of values by type (AGG-43, AGG-45)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 3).alias("median"), F.count("*").alias("calls"), (F.sum(F.round(F.col("value") * 100).cast("long"))).alias("total_cents"))


def routing(spark, sf_dir):
    """How often an order's status follows from its items' (AGG-38)."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
    j = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    guess = F.when(F.col("f") == F.col("n"), "F").when(F.col("f") == 0, "O").otherwise("P")
    return j.groupBy("o_orderstatus", guess.alias("guess")).agg(F.count("*").alias("n"))


def worst_first(spark, sf_dir):
    """Nations by the share of their customers in debt, the worst first, those without customers last (SRT-08)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("good"))
    j = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    rate = F.coalesce(F.try_divide("good", "n"), F.lit(2.0))
    return j.select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rate, "n_name")).alias("place"))  # 25 rows


_FNS = [row_cell_accuracy, blocking, revisions, cascade_delete, rename_cascade, shown_jobs, claims, spans_recovered, best_dates, progress, score_histogram, timing_medians, routing, worst_first]
QUERIES = {f.__name__: f for f in _FNS}
ORACLE_SQL = {
    "row_cell_accuracy": "WITH t AS (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS part, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT o, l, part, CASE WHEN part % 10 = 0 THEN q + 1 ELSE q END AS q FROM t WHERE part % 17 <> 0 UNION ALL SELECT o, 99, part, q FROM t WHERE l = 1), j AS (SELECT t.o IS NOT NULL AS known, r.o IS NOT NULL AS there, coalesce(t.part = r.part, false)::INTEGER + coalesce(t.q = r.q, false)::INTEGER AS c FROM t FULL JOIN r ON t.o = r.o AND t.l = r.l) SELECT count(*) AS rows, count(*) FILTER (known AND c = 2) AS rows_right, count(*) FILTER (known) * 2 AS cells, sum(c)::BIGINT AS cells_right, count(*) FILTER (NOT known) AS extra_rows, count(*) FILTER (NOT there) AS missing_rows FROM j",
    "blocking": "SELECT DISTINCT user_id, event_type AS code, CASE WHEN value > 20 THEN 'date' ELSE 'seal' END AS scope FROM events WHERE length(props) > 8 AND value > 5 AND event_type <> 'view'",
    "revisions": "SELECT o_orderkey, 'v2:' || sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus})::VARCHAR) AS revision FROM orders",
    "cascade_delete": "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_orderstatus = 'F' AND g.o_orderpriority LIKE '1%' AND g.o_custkey = o.o_custkey AND g.o_orderpriority = o.o_orderpriority)",
    "rename_cascade": "SELECT CASE WHEN n_nationkey < 10 THEN r_name ELSE n_name END AS n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "shown_jobs": "SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts DESC, event_id DESC) = 1",
    "claims": "WITH h AS (SELECT o_orderpriority, o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1) SELECT *, row_number() OVER (ORDER BY day, o_orderkey)::INTEGER AS turn FROM h",
    "spans_recovered": "WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 END AS parent, event_id % 100 * 1000 AS secs FROM events WHERE event_id % 6 <> 1), c AS (SELECT parent, sum(secs)::BIGINT AS i FROM e WHERE parent IS NOT NULL GROUP BY 1) SELECT e.event_id, e.event_id % 6 = 0 AS approximate, greatest(secs - coalesce(i, 0), 0) AS own FROM e LEFT JOIN c ON c.parent = e.event_id",
    "best_dates": "WITH j AS (SELECT l_orderkey, date_trunc('month', l_shipdate)::DATE AS day, floor(l_discount * 1000 + 0.5)::BIGINT AS p, date_trunc('month', o_orderdate::DATE + 30)::DATE AS required FROM lineitem JOIN orders ON l_orderkey = o_orderkey), d AS (SELECT l_orderkey, day, max(p) + least(12 * (count(*) - 1), 36) + 35 * max((day = required)::INTEGER) AS score, count(*) AS readings FROM j GROUP BY 1, 2) SELECT l_orderkey, day::VARCHAR AS date, score::BIGINT AS score, readings FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, day) = 1",
    "progress": "WITH i AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS shipped FROM lineitem GROUP BY 1) SELECT CASE WHEN shipped IS NULL THEN 'missing' WHEN shipped AND o_orderstatus = 'F' THEN 'finished' WHEN shipped THEN 'received' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'waiting' END AS bucket, count(*) AS orders FROM orders LEFT JOIN i ON o_orderkey = l_orderkey GROUP BY 1",
    "score_histogram": "SELECT event_type, least(floor(value / 10), 9)::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1, 2",
    "timing_medians": "SELECT event_type, round(median(value), 3) AS median, count(*) AS calls, sum(round(value * 100)::BIGINT)::BIGINT AS total_cents FROM events GROUP BY 1",
    "routing": "WITH i AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS f, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderstatus, CASE WHEN f = n THEN 'F' WHEN f = 0 THEN 'O' ELSE 'P' END AS guess, count(*) AS n FROM orders JOIN i ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "worst_first": "WITH c AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS good FROM customer GROUP BY 1) SELECT n_name, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(good::DOUBLE / n, 2.0), n_name)::INTEGER AS place FROM nation LEFT JOIN c ON n_nationkey = c_nationkey",
}
