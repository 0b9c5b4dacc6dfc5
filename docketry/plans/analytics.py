"""Evaluation, arbitration, timelines, texts and vectors as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CORRECT, ERROR, MATCH, MISMATCH, NOT_RUN, NO_TRUTH, PARTIAL, PASS, REJECT, REVIEW, TESTING, UNREAD, UNTESTED, WRONG
from ..functions import dates, measures, text
from ..operators import arbitration, evaluation, intervals, reconcile, vectors
from ..operators.decision import Check, Policy, is_reliable, strict_status, verdict
from ..sources.sinks import content_groups, expired
from ..sources.tables import dealt, table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seal cells of three channels over all documents; the truth is the toxicity label, where there is one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    expected = F.when(F.col("toxic") == 1, MISMATCH).when(F.col("toxic") == 0, MATCH)
    job = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 17 == 0, "running").when(F.col("doc_id") % 19 == 0, "queued").otherwise("succeeded")
    decisions = {"length": F.when(F.col("n_chars") > 1500, MISMATCH).otherwise(MATCH), "lang": F.when(F.col("lang") == "en", MATCH).when(F.col("lang") == "fr", PARTIAL).otherwise(MISMATCH), "parity": F.when(F.col("doc_id") % 2 == 0, MATCH).otherwise(MISMATCH)}
    value = lambda i: F.when(F.col("doc_id") % (7 + i) == 0, "").otherwise(F.col("source"))
    cells = [F.struct(F.lit(name).alias("channel"), evaluation.cell_state(job, F.col("doc_id") % (11 + i) != 1, expected, value(i), decision, F.col("doc_id") % (23 + i) == 2).alias("state"), decision.alias("decision"), expected.alias("expected")) for i, (name, decision) in enumerate(decisions.items())]
    return d.select(F.col("doc_id").alias("sample"), F.explode(F.array(*cells)).alias("c")).select("sample", "c.*")


_CELLS = f"""
d AS (SELECT doc_id, n_chars, lang, source, toxic, CASE toxic WHEN 1 THEN '{MISMATCH}' WHEN 0 THEN '{MATCH}' END AS expected,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'running' WHEN doc_id % 19 = 0 THEN 'queued' ELSE 'succeeded' END AS job FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT *, 'length' AS channel, 0 AS i, CASE WHEN n_chars > 1500 THEN '{MISMATCH}' ELSE '{MATCH}' END AS decision FROM d
  UNION ALL SELECT *, 'lang', 1, CASE lang WHEN 'en' THEN '{MATCH}' WHEN 'fr' THEN '{PARTIAL}' ELSE '{MISMATCH}' END FROM d
  UNION ALL SELECT *, 'parity', 2, CASE WHEN doc_id % 2 = 0 THEN '{MATCH}' ELSE '{MISMATCH}' END FROM d),
cells AS (SELECT doc_id AS sample, channel, decision, expected, CASE WHEN job IS NULL THEN '{UNTESTED}' WHEN doc_id % (11 + i) = 1 THEN '{NOT_RUN}' WHEN job = 'running' THEN '{TESTING}' WHEN job = 'queued' THEN '{NOT_RUN}'
  WHEN expected IS NULL THEN '{NO_TRUTH}' WHEN doc_id % (23 + i) = 2 THEN '{ERROR}' WHEN doc_id % (7 + i) = 0 OR source = '' OR source IS NULL THEN '{UNREAD}' WHEN decision = expected THEN '{CORRECT}' ELSE '{WRONG}' END AS state FROM u)
"""
_SCORED = f"state IN ('{CORRECT}', '{WRONG}', '{UNREAD}', '{ERROR}')"


def channel_cells_long(spark, sf_dir):
    return _cells(spark, sf_dir)


def channel_counts(spark, sf_dir):
    return evaluation.channel_counts(_cells(spark, sf_dir))


def common_sample(spark, sf_dir):
    return evaluation.common_sample(_cells(spark, sf_dir), 3)


def pair_disagreement(spark, sf_dir):
    return evaluation.disagreements(_cells(spark, sf_dir))


def error_types(spark, sf_dir):
    return evaluation.error_types(_cells(spark, sf_dir))


def cohort_accuracy(spark, sf_dir):
    """Correct and scored cells by truth and channel (AGG-24)."""
    scored = evaluation.is_scored(F.col("state"))
    return _cells(spark, sf_dir).filter(F.col("expected").isNotNull()).groupBy("expected", "channel").agg(F.count_if(scored).alias("scored"), F.count_if(F.col("state") == CORRECT).alias("correct"))


def group_stats(spark, sf_dir):
    """Orders by nation, by segment, by both and in all (AGG-21)."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupingSets([["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["c_mktsegment"], []], "c_nationkey", "c_mktsegment").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.max("o_totalprice").alias("largest")
    ).select("c_nationkey", "c_mktsegment", "level", "orders", "customers", "largest")


def field_accuracy(spark, sf_dir):
    """How often two simple readings of a document agree with its labels (AGG-09, AGG-10)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    ok = {"quality": (F.col("n_chars") > 300) == (F.col("quality") == 1), "toxic": F.when(F.col("lang") == "en", F.col("toxic") == 0)}
    return evaluation.field_accuracy(table(spark, sf_dir, "labels"), d, ["doc_id"], ok)


def decision_coverage(spark, sf_dir):
    """Decided share of the labelled cells and accuracy of the decided ones (AGG-13)."""
    c = _cells(spark, sf_dir).filter(evaluation.is_scored(F.col("state")))
    decided = F.count_if(is_reliable(F.col("decision")))
    right = F.count_if(is_reliable(F.col("decision")) & (F.col("decision") == F.col("expected")))
    return c.groupBy("channel").agg(F.count("*").alias("scored"), decided.alias("decided"), right.alias("right"), measures.safe_ratio(decided, F.count("*")).alias("coverage"), measures.safe_ratio(right, decided).alias("accuracy"))


def tag_tallies(spark, sf_dir):
    """Documents per tag, each tag once per document (AGG-25)."""
    tags = F.array_distinct(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")))
    return table(spark, sf_dir, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def day_counts_distinct(spark, sf_dir):
    """Users and events by day (AGG-02, AGG-04, DAT-10)."""
    return table(spark, sf_dir, "events").groupBy(dates.day_bucket(F.col("ts").cast("string")).alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


def queue_rollup(spark, sf_dir):
    """Events by type for each user, and the worst status of all (AGG-03, AGG-07, AGG-37)."""
    n = {t: F.count_if(F.col("event_type") == t) for t in ("view", "click", "purchase", "signup", "error")}
    status = F.when(n["error"] > 15, "failed").when(n["signup"] > 15, "running").when(n["purchase"] > 0, "succeeded").otherwise("unknown")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[c.alias(t) for t, c in n.items()], status.alias("status"))


def strict_sums(spark, sf_dir):
    """Sums that are null where any part is (AGG-35, AGG-36)."""
    e = table(spark, sf_dir, "events").withColumn("part", F.when(F.col("event_id") % 97 != 0, F.col("event_id")))
    return e.groupBy("user_id").agg(measures.strict_sum(F.col("part")).alias("total"), F.count("part").alias("parts"))


def candidate_arbitration(spark, sf_dir):
    """The event type that stands for each user and day, events being readings of three methods and nine providers, some without a value, method or confidence (MCH-21)."""
    e = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").cast("string").alias("day"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("value"), F.when(F.col("event_id") % 8 == 0, "").otherwise((F.col("event_id") % 3).cast("string")).alias("method"), F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")).alias("provider"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") * 37 % 100) / 100.0).alias("conf"), (F.col("event_id") % 7 == 0).alias("low"),
    )
    return arbitration.choose(e, ["user_id", "day"], "p4")


_ARBITRATION = """
WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, event_id AS pos, CASE WHEN event_id % 13 <> 0 THEN event_type END AS value, CASE WHEN event_id % 8 = 0 THEN '' ELSE (event_id % 3)::VARCHAR END AS method, event_id % 9 AS provider, CASE WHEN event_id % 5 <> 0 THEN (event_id * 37 % 100) / 100.0::DOUBLE END AS conf, event_id % 7 = 0 AS low FROM events),
q AS (SELECT *, CASE WHEN low OR conf < 0.65 THEN 0 WHEN conf >= 0.85 THEN 3 ELSE 2 END AS q FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY q DESC, coalesce(conf, -1) DESC, pos) AS r FROM q),
v AS (SELECT user_id, day, value, min(r) AS r, arg_min(q, r) AS q, min(r) FILTER (provider = 4) AS own, count(DISTINCT method) FILTER (q > 0 AND method <> '') AS support, bool_and(low) AS all_low, max(conf) AS conf, bool_and(conf IS NOT NULL) AS known, first(conf ORDER BY r) AS sure FROM o GROUP BY 1, 2, 3),
w AS (SELECT *, count(*) OVER k AS n, count(own) OVER k AS owns, max(support) OVER k AS top FROM v WINDOW k AS (PARTITION BY user_id, day)),
x AS (SELECT user_id, day, any_value(n) AS n, any_value(owns) AS owns, first(value ORDER BY own NULLS LAST) AS own_value, any_value(top) AS top, count(*) FILTER (support = top) AS tops, first(value ORDER BY support DESC) AS voted,
  first(value ORDER BY r) AS best_value, first(q ORDER BY r) AS best_q, first(sure ORDER BY r) AS sure, bool_and(all_low OR r = 1) AS others_low, bool_and(known OR r = 1) AS others_known, max(conf) FILTER (r > 1) AS other FROM w GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN n = 1 THEN 'unanimous' WHEN owns > 0 THEN 'preferred' WHEN top >= 2 AND tops = 1 THEN 'vote' WHEN others_low AND best_q >= 2 THEN 'others_low' WHEN others_known AND best_q > 0 AND sure >= 0.85 AND sure - other >= 0.15 THEN 'confidence' ELSE 'rank' END AS rule FROM x)
SELECT user_id, day, CASE rule WHEN 'preferred' THEN own_value WHEN 'vote' THEN voted ELSE best_value END AS value, rule, rule = 'rank' OR rule = 'preferred' AND owns > 1 AS disputed FROM y
"""


def verdict_truth_table(spark, sf_dir):
    """Verdicts of all statuses of two checks under three policies (MCH-29)."""
    s = spark.createDataFrame([(x,) for x in (MATCH, MISMATCH, PARTIAL, UNREAD)], "s string")
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    grid = n.join(s.select(F.col("s").alias("date_status"), F.lit(1).alias("j")), F.lit(1) == F.col("j")).join(s.select(F.col("s").alias("seal_status"), F.lit(1).alias("k")), F.lit(1) == F.col("k"))
    check = lambda c: Check(F.col(c), is_reliable(F.col(c)) | (F.col("n_nationkey") % 2 == 0))
    rule = lambda r: verdict(Policy(reject=r), check("date_status"), check("seal_status"), has_issue=F.col("n_nationkey") % 5 == 0)
    return grid.select("n_nationkey", "date_status", "seal_status", *[rule(r).alias(r) for r in ("none", "any_mismatch", "all_mismatch")])


def _verdict_sql() -> str:
    base = f"WHEN n_nationkey % 5 = 0 OR (n_nationkey % 2 = 1 AND (d.s NOT IN ('{MATCH}', '{MISMATCH}') OR e.s NOT IN ('{MATCH}', '{MISMATCH}'))) THEN '{REVIEW}'"
    one, both = f"(d.s = '{MISMATCH}' OR e.s = '{MISMATCH}')", f"(d.s = '{MISMATCH}' AND e.s = '{MISMATCH}')"
    rest = f"WHEN {one} THEN '{REVIEW}' WHEN d.s = '{MATCH}' AND e.s = '{MATCH}' THEN '{PASS}' ELSE '{REVIEW}' END"
    values = f"(VALUES ('{MATCH}'), ('{MISMATCH}'), ('{PARTIAL}'), ('{UNREAD}'))"
    return f"SELECT n_nationkey, d.s AS date_status, e.s AS seal_status, CASE {base} {rest} AS none, CASE {base} WHEN {one} THEN '{REJECT}' {rest} AS any_mismatch, CASE {base} WHEN {both} THEN '{REJECT}' {rest} AS all_mismatch FROM nation, {values} d(s), {values} e(s)"


def page_merge_conv(spark, sf_dir):
    """Conversations as receipts: turn 0 is the cover, later turns continue it; some first turns are no receipts (REC-01 to REC-05)."""
    c = table(spark, sf_dir, "conversations")
    status = F.when(F.length("text") % 11 == 0, REJECT).when(F.length("text") % 7 == 0, REVIEW).otherwise(PASS)
    pages = c.select(
        "conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("page"), F.when(F.col("turn") > 0, "continuation").when(F.length("text") % 10 == 3, "authorization").otherwise("receipt").alias("kind"), status.alias("status"),
        F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, F.substring("text", 1, 20)).alias("footer"), (F.length("text") % 100 / 100.0).alias("confidence"),
    )
    return reconcile.merge_pages(pages, ["conv_id"])


_PAGES = f"""
WITH p AS (SELECT conv_id, conv_id * 100 + turn AS id, turn AS page, CASE WHEN length(text) % 11 = 0 THEN '{REJECT}' WHEN length(text) % 7 = 0 THEN '{REVIEW}' ELSE '{PASS}' END AS status,
  CASE WHEN (turn + conv_id) % 3 = 0 THEN substr(text, 1, 20) END AS footer, length(text) % 100 / 100.0::DOUBLE AS confidence, turn > 0 OR length(text) % 10 <> 3 AS fits FROM conversations),
g AS (SELECT conv_id, max(id) FILTER (page = 0) AS id, count(*) AS pages, arg_max(footer, page) FILTER (page > 0 AND footer IS NOT NULL AND footer <> '') AS last, max(footer) FILTER (page = 0) AS own,
  bool_or(status = '{REJECT}') AS rejected, bool_and(status = '{PASS}') AS passed, min(confidence) AS confidence, bool_and(fits) AS covered FROM p GROUP BY 1)
SELECT conv_id, id, pages, coalesce(last, own) AS footer, CASE WHEN rejected THEN '{REJECT}' WHEN passed THEN '{PASS}' ELSE '{REVIEW}' END AS status, confidence, false AS orphan FROM g WHERE covered
UNION ALL SELECT conv_id, p.id, 1, footer, status, p.confidence, true FROM p JOIN g USING (conv_id) WHERE NOT covered
"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + (F.col("event_id") % 20 * 3_000_000_000)).alias("end"))


_SPANS = "s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + event_id % 20 * 3000000000 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), n AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), i AS (SELECT user_id, island, min(a) AS a, max(b) AS b FROM n GROUP BY 1, 2)"


def interval_union(spark, sf_dir):
    return intervals.covered(_spans(spark, sf_dir), ["user_id"])


def gap_complement(spark, sf_dir):
    return intervals.gaps(_spans(spark, sf_dir), ["user_id"])


def attempts(spark, sf_dir):
    """Attempts of a user: each sign-up opens one, events until the next belong to it (WIN-21, STM-15)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("attempt", F.sum((F.col("event_type") == "signup").cast("int")).over(w))
    return e.groupBy("user_id", "attempt").agg(F.count("*").alias("steps"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))


def text_keys(spark, sf_dir):
    """Normal forms of customer and part names (STR-01, STR-02, STR-05, STR-07, STR-15)."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_brand"), F.lit("： ("), F.col("p_type"), F.lit(")_0"), (F.col("p_size") % 10).cast("string"), F.lit(".JPG"))
    key, page = text.page_identity(name)
    return p.select("p_partkey", text.normalize(name).alias("normal"), text.seal_key(name).alias("seal"), text.bracketed(name).alias("bracketed"), text.after_colon(name).alias("rest"), key.alias("key"), page.alias("page"))


def ean13_check(spark, sf_dir):
    """Part keys as article numbers: the check digit holds for about one in ten (STR-13)."""
    code = F.lpad((F.col("p_partkey") * 7919).cast("string"), 13, "4")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.ean13_valid(code).alias("valid"))


def subsequence_status(spark, sf_dir):
    """Strict comparison of part types with parts of themselves and of brands (MAT-05, MAT-08, MCH-01)."""
    e, a = F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_type", "[AEIOUaeiou]", "")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", strict_status(e, a).alias("status"), measures.character_coverage(e, a).alias("coverage"), F.levenshtein(e, a).alias("edits"))


def nearest_date(spark, sf_dir):
    """The ship date of each order nearest to its order date plus 30 days, the first row of equals (WIN-10, DAT-06)."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day, want = F.col("l_shipdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 30)
    rank = F.struct(F.abs(F.datediff(day, want)).alias("off"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), day.alias("day"))
    status, late = dates.compare_dates(F.col("want"), F.col("best.day"))
    return j.groupBy("l_orderkey", want.alias("want")).agg(F.min(rank).alias("best")).select("l_orderkey", F.col("best.day").cast("string").alias("day"), status.alias("status"), late.alias("days_late"))


def strict_dates(spark, sf_dir):
    """Order dates written in damaged ways and read again (DAT-01, DAT-04, DAT-14)."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    written = F.concat_ws("", F.lit("签收 2O"), F.lpad((F.year(d) % 100).cast("string"), 2, "0"), F.lit("年"), (F.month(d) + F.col("o_orderkey") % 3).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    read = dates.strict_date(written)
    return o.select("o_orderkey", read.cast("string").alias("read"), dates.partial_date(F.year(read), F.month(read), F.dayofmonth(read)).alias("partial"))


def skew_slope(spark, sf_dir):
    """Least-squares slope of price over quantity by order, at least three rows, clamped (AGG-31)."""
    slope = F.round(measures.slope_of_cents(F.col("l_extendedprice"), F.col("l_quantity")) / 1e6, 6)
    clamped = F.greatest(F.least(slope, F.lit(0.05)), F.lit(-0.05))
    # Dealt by order first: three numbers of a line are less than what its sums take.
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(clamped * 1e4).cast("long").alias("slope_e4")).filter("n >= 3")


def column_consensus(spark, sf_dir):
    """The return flag that fills a supplier's gaps: ten rows or more, eight or more and 35 % of them alike (AGG-29)."""
    r = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 1").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    best = r.groupBy("l_suppkey").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "l_returnflag")).alias("b"))
    return best.filter("rows >= 10 AND b.n >= 8 AND b.n >= 0.35 * rows").select("l_suppkey", "rows", F.col("b.n").alias("support"), F.col("b.l_returnflag").alias("fill"))


def content_dedupe(spark, sf_dir):
    """Documents by the digest of their text; the smallest id of equal texts is kept (SNK-20)."""
    return content_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "digest", "is_first")


def retention(spark, sf_dir):
    """Events older than ten days that no purchase of the same id protects (SNK-12)."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    active = e.filter("event_type = 'purchase'")
    return expired(e, F.col("at"), 10, F.lit("2024-01-25 00:00:00").cast("timestamp"), active, "event_id").select("event_id", "user_id")


def json_props(spark, sf_dir):
    """The member k of each event's properties, and what type it has (JSN-01, JSN-06)."""
    v = F.variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_id", v.alias("k"), F.get_json_object("props", "$.k").alias("as_text"), F.size(F.json_object_keys("props")).alias("members"))


def knn_ratio_test(spark, sf_dir):
    """Every hundredth vector against all others of its label: the two nearest, and whether the first is clearly nearer (JOIN-15, JOIN-16, MCH-18)."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.two_nearest(v.filter("vec_id % 100 = 0"), v, "vec_id", "label", "embedding", 0.95)


def reference_consensus(spark, sf_dir):
    """For each label, how many vectors lie near its centre, and how near the nearest (AGG-33)."""
    return vectors.consensus(table(spark, sf_dir, "embeddings"), "label", "embedding", 0.9)


_FNS = [channel_cells_long, channel_counts, common_sample, pair_disagreement, error_types, cohort_accuracy, group_stats, field_accuracy, decision_coverage, tag_tallies, day_counts_distinct, queue_rollup, strict_sums, candidate_arbitration, verdict_truth_table,
        page_merge_conv, interval_union, gap_complement, attempts, text_keys, ean13_check, subsequence_status, nearest_date, strict_dates, skew_slope, column_consensus, content_dedupe, retention, json_props, knn_ratio_test, reference_consensus]
QUERIES = {f.__name__: f for f in _FNS}
_PAIR = "FROM cells a JOIN cells b ON a.sample = b.sample AND a.channel < b.channel WHERE a.state IN ('{c}', '{w}') AND b.state IN ('{c}', '{w}')".format(c=CORRECT, w=WRONG)
_NAME = "p_brand || '： (' || p_type || ')_0' || (p_size % 10) || '.JPG'"
ORACLE_SQL = {
    "channel_cells_long": f"WITH {_CELLS} SELECT sample, channel, state, decision, expected FROM cells",
    "channel_counts": f"WITH {_CELLS} SELECT channel, count(*) FILTER (state = '{CORRECT}') AS correct, count(*) FILTER (state = '{WRONG}') AS wrong, count(*) FILTER (state = '{UNREAD}') AS unread, count(*) FILTER (state = '{ERROR}') AS failed, count(*) FILTER ({_SCORED}) AS scored, round(count(*) FILTER (state = '{CORRECT}')::DOUBLE / nullif(count(*) FILTER ({_SCORED}), 0), 4) AS accuracy FROM cells GROUP BY 1",
    "common_sample": f"WITH {_CELLS}, s AS (SELECT sample FROM cells WHERE {_SCORED} GROUP BY 1 HAVING count(DISTINCT channel) = 3) SELECT channel, count(*) AS scored, count(*) FILTER (state = '{CORRECT}') AS correct FROM cells WHERE sample IN (SELECT sample FROM s) AND {_SCORED} GROUP BY 1",
    "pair_disagreement": f"WITH {_CELLS} SELECT a.channel AS channel_a, b.channel AS channel_b, count(*) AS total, count(*) FILTER (a.decision IS DISTINCT FROM b.decision) AS differ, count(*) FILTER (a.state = '{CORRECT}' AND b.state = '{WRONG}') AS only_a, count(*) FILTER (a.state = '{WRONG}' AND b.state = '{CORRECT}') AS only_b, count(*) FILTER (a.state = '{CORRECT}' AND b.state = '{CORRECT}') AS both, count(*) FILTER (a.state = '{WRONG}' AND b.state = '{WRONG}') AS neither {_PAIR} GROUP BY 1, 2",
    "error_types": f"WITH {_CELLS} SELECT channel, CASE WHEN expected = '{MISMATCH}' AND decision = '{MATCH}' THEN 'false_accept' WHEN expected = '{MATCH}' AND decision = '{MISMATCH}' THEN 'false_reject' WHEN decision = '{PARTIAL}' THEN 'partial' ELSE 'other' END AS kind, count(*) AS n FROM cells WHERE state = '{WRONG}' GROUP BY 1, 2",
    "cohort_accuracy": f"WITH {_CELLS} SELECT expected, channel, count(*) FILTER ({_SCORED}) AS scored, count(*) FILTER (state = '{CORRECT}') AS correct FROM cells WHERE expected IS NOT NULL GROUP BY 1, 2",
    "group_stats": "SELECT c_nationkey, c_mktsegment, grouping(c_nationkey, c_mktsegment)::INTEGER AS level, count(*) AS orders, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), (c_mktsegment), ())",
    "field_accuracy": "WITH j AS (SELECT (n_chars > 300) = (quality = 1) AS q, CASE WHEN lang = 'en' THEN toxic = 0 END AS t FROM labels JOIN documents USING (doc_id)), u AS (SELECT 'quality' AS field, q AS ok FROM j UNION ALL SELECT 'toxic', t FROM j) SELECT field, count(*) FILTER (ok) AS correct, count(ok) AS evaluated, coalesce(round(count(*) FILTER (ok)::DOUBLE / nullif(count(ok), 0), 4), 0.0) AS accuracy FROM u GROUP BY 1",
    "decision_coverage": f"WITH {_CELLS}, c AS (SELECT *, decision IN ('{MATCH}', '{MISMATCH}') AS sure FROM cells WHERE {_SCORED}) SELECT channel, count(*) AS scored, count(*) FILTER (sure) AS decided, count(*) FILTER (sure AND decision = expected) AS \"right\", round(count(*) FILTER (sure)::DOUBLE / count(*), 4) AS coverage, coalesce(round(count(*) FILTER (sure AND decision = expected)::DOUBLE / nullif(count(*) FILTER (sure), 0), 4), 0.0) AS accuracy FROM c GROUP BY 1",
    "tag_tallies": "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END])) AS tag FROM documents) GROUP BY 1",
    "day_counts_distinct": "SELECT ts::DATE::VARCHAR AS day, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY 1",
    "queue_rollup": "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, CASE WHEN count(*) FILTER (event_type = 'error') > 15 THEN 'failed' WHEN count(*) FILTER (event_type = 'signup') > 15 THEN 'running' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'succeeded' ELSE 'unknown' END AS status FROM events GROUP BY 1",
    "strict_sums": "SELECT user_id, CASE WHEN count(*) = count(part) THEN sum(part)::BIGINT END AS total, count(part) AS parts FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN event_id END AS part FROM events) GROUP BY 1",
    "candidate_arbitration": _ARBITRATION,
    "verdict_truth_table": _verdict_sql(),
    "page_merge_conv": _PAGES,
    "interval_union": f"WITH {_SPANS} SELECT user_id, sum(b - a)::BIGINT AS covered, max(b) - min(a) AS envelope, count(*) AS islands FROM i GROUP BY 1",
    "gap_complement": f"WITH {_SPANS} SELECT user_id, b AS start, next AS \"end\" FROM (SELECT user_id, b, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS next FROM i) WHERE next IS NOT NULL",
    "attempts": "WITH e AS (SELECT *, (sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) SELECT user_id, attempt, count(*) AS steps, arg_max(event_type, r) AS last FROM e GROUP BY 1, 2",
    "text_keys": f"WITH n AS (SELECT p_partkey, p_type, {_NAME} AS name FROM part) SELECT p_partkey, lower(regexp_replace(name, '[\\s:：,，.。()（）\\[\\]【】\\-_/]', '', 'g')) AS normal, regexp_replace(replace(name, '：', ':'), '[\\s()（）|｜]', '', 'g') AS seal, p_type AS bracketed, trim(regexp_extract(name, '^[^:：]*[:：](.*)$', 1)) AS rest, regexp_extract(name, '^(.+?)_([0-9]{{2}})(\\.[^.]+)$', 1) AS key, regexp_extract(name, '^(.+?)_([0-9]{{2}})(\\.[^.]+)$', 2)::INTEGER AS page FROM n",
    "ean13_check": "WITH c AS (SELECT p_partkey, lpad((p_partkey * 7919)::VARCHAR, 13, '4') AS code FROM part) SELECT p_partkey, code, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(code, i, 1)::INTEGER * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) % 10 = substr(code, 13, 1)::INTEGER AS valid FROM c",
    "subsequence_status": f"WITH c AS (SELECT p_partkey, p_type AS e, CASE p_partkey % 3 WHEN 0 THEN regexp_replace(p_type, '[AEIOUaeiou]', '', 'g') WHEN 1 THEN p_type ELSE p_brand END AS a FROM part) SELECT p_partkey, CASE WHEN e = '' THEN '无法判断' WHEN a = '' THEN '{UNREAD}' WHEN e = a THEN '{MATCH}' WHEN length(a) < length(e) AND e LIKE '%' || array_to_string(string_split(a, ''), '%') || '%' THEN '{PARTIAL}' ELSE '{MISMATCH}' END AS status, round(len(list_intersect(list_distinct(string_split(e, '')), list_distinct(string_split(a, ''))))::DOUBLE / len(list_distinct(string_split(e, ''))), 4) AS coverage, levenshtein(e, a)::INTEGER AS edits FROM c",
    "nearest_date": f"WITH j AS (SELECT l_orderkey, l_shipdate::DATE AS day, o_orderdate::DATE + 30 AS want, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_shipdate::DATE - (o_orderdate::DATE + 30)), l_linenumber, l_partkey, l_suppkey, l_shipdate) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, day::VARCHAR AS day, CASE WHEN day = want THEN '{MATCH}' ELSE '{MISMATCH}' END AS status, (day - want)::INTEGER AS days_late FROM j WHERE r = 1",
    "strict_dates": "WITH w AS (SELECT o_orderkey, try_cast('20' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || '-' || lpad((month(o_orderdate) + o_orderkey % 3)::VARCHAR, 2, '0') || '-' || lpad(day(o_orderdate)::VARCHAR, 2, '0') AS DATE) AS d FROM orders) SELECT o_orderkey, d::VARCHAR AS read, coalesce(d::VARCHAR, '____-__-__') AS partial FROM w",
    "skew_slope": "SELECT l_orderkey, count(*) AS n, round(greatest(least(round(regr_slope(l_extendedprice, l_quantity) / 1e6, 6), 0.05), -0.05) * 1e4)::BIGINT AS slope_e4 FROM lineitem GROUP BY 1 HAVING count(*) >= 3",
    "column_consensus": "WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2), b AS (SELECT l_suppkey, sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS rows, n AS support, l_returnflag AS fill, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) AS k FROM r) SELECT l_suppkey, rows, support, fill FROM b WHERE k = 1 AND rows >= 10 AND support >= 8 AND support >= 0.35 * rows",
    "content_dedupe": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents",
    "retention": "SELECT event_id, user_id FROM events e WHERE ts < TIMESTAMP '2024-01-25' - INTERVAL 10 DAY AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.event_id = e.event_id)",
    "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.k' AS as_text, len(json_keys(props))::INTEGER AS members FROM events",
    "knn_ratio_test": "WITH p AS (SELECT a.vec_id, b.vec_id AS other, a.label, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM p), g AS (SELECT vec_id, any_value(label) AS label, max(other) FILTER (k = 1) AS nearest, max(other) FILTER (k = 2) AS second, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM r WHERE k <= 2 GROUP BY 1) SELECT vec_id, label, nearest, second, round(d1, 6) AS distance, coalesce(d1 < 0.95 * d2, false) AS accepted FROM g",
    "reference_consensus": "WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2), d AS (SELECT vec_id, label, 1 - sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2) SELECT label, count(*) AS n, count(*) FILTER (d <= 0.9) AS near, round(min(d), 6) AS nearest FROM d GROUP BY 1",
}
