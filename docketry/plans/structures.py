"""Queries over whole records and graphs: patches, differences, rewriting, marks at any depth, greedy pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing, trees
from ..sources.tables import dealt, table


def _records(spark, sf_dir):
    """Orders as nested records, and the newer state of each."""
    # Orders are few bytes each, so a file of millions is read by one task or a few.
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey", heavy=True)
    k = F.col("o_orderkey")
    deal = F.struct(F.col("o_orderstatus").alias("state"), k.alias("total"))
    old = F.struct(F.struct(F.struct(deal.alias("deal"), F.col("o_custkey").alias("number")).alias("a")).alias("order"), F.struct(F.lit(1).alias("page"), F.array(k, k + 1).alias("parts")).alias("sheet"))
    return o.select("o_orderkey", "o_orderstatus", "o_custkey", F.to_json(old).alias("record"))


def patched_records(spark, sf_dir):
    """Orders' records with patches that set, remove and replace members three levels deep (JSN-05)."""
    k = F.col("o_orderkey")
    patch = F.concat(
        F.lit('{"order":{"a":{"deal":'), F.when(k % 4 == 0, "null").when(k % 4 == 1, '{"state":null,"total":7}').when(k % 4 == 2, "[1,null]").otherwise('{"state":{"x":null}}'), F.lit("}}"),
        F.when(k % 3 == 0, ',"sheet":{"page":2,"parts":null}').when(k % 3 == 1, ',"sheet":{}').otherwise(""), F.lit("}"),
    )
    m = trees.merge_patch(_records(spark, sf_dir).withColumn("patch", patch), ["o_orderkey"], "record", "patch")
    at = {"state": "$.order.a.deal.state", "total": "$.order.a.deal.total", "number": "$.order.a.number", "page": "$.sheet.page", "parts": "$.sheet.parts"}
    m = m.withColumn("value", F.try_parse_json("merged"))  # parsed once, not for each path
    return m.select("o_orderkey", *[F.try_variant_get("value", path, "string").alias(c) for c, path in at.items()], F.length("merged").alias("length"))


def record_changes(spark, sf_dir):
    """What must be written to bring orders' records up to date: the smallest patch, empty where nothing changed (REC-06)."""
    k = F.col("o_orderkey")
    deal = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit('"deal":{"state":"'), F.col("o_orderstatus"), F.lit('","total":'), k + 1, F.lit("},"))).otherwise(F.concat(F.lit('"deal":{"state":"'), F.col("o_orderstatus"), F.lit('","total":'), k, F.lit("},")))
    sheet = F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.lit(',"sheet":"none"')).when(k % 7 == 2, F.concat(F.lit(',"sheet":{"page":1,"parts":['), k + 1, F.lit(","), k, F.lit("]}"))).otherwise(F.concat(F.lit(',"sheet":{"page":1,"parts":['), k, F.lit(","), k + 1, F.lit("]}")))
    new = F.concat(F.lit('{"order":{"a":{'), deal, F.lit('"number":'), F.col("o_custkey"), F.lit("}}"), sheet, F.lit("}"))
    return trees.merge_diff(_records(spark, sf_dir).withColumn("newer", new), ["o_orderkey"], "record", "newer")


def rewritten_links(spark, sf_dir):
    """Pages' records with links renamed at four depths; a link's query stays (PRJ-11)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    base = F.regexp_extract("url", r"^[^?]*", 0)
    record = F.to_json(F.struct(F.array(F.struct(F.concat("url", F.lit("?v=1")).alias("at"), F.array(F.lit("x"), base).alias("more"))).alias("files"), F.struct(F.struct(F.col("url").alias("own")).alias("deep")).alias("info"), F.col("page_id").alias("n")))
    names = p.filter("page_id % 2 = 0").select(base.alias("old"), F.lit("/kept").alias("new"))
    return trees.rewrite_strings(p.select("page_id", record.alias("record")), ["page_id"], "record", names)


def human_marks(spark, sf_dir):
    """Which documents' records hold a person's decision, in themselves or in readings inside readings (FLT-15)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    own = F.when(k % 6 == 0, '{"review_status":"确认通过"}').when(k % 6 == 1, '{"human_note":""}').when(k % 6 == 2, '{"date_check":{"source":"人工修改"}}').when(k % 6 == 3, '{"fields":{"source":"人工"}}').when(k % 6 == 4, '{"seal_check":{"human_confirmed_match":false}}').otherwise('{"product_table":{"rows":[{"sources":{"n":"人工"}}]}}')
    once = lambda x, name: F.concat(F.lit('{"recognition_variants":{"seal":[{"method":"m"},{"' + name + '":'), x, F.lit("}]}}"))
    record = F.when(k % 3 == 0, own).when(k % 3 == 1, once(own, "details")).otherwise(once(once(own, "result"), "details"))
    return trees.has_human_edits(d.select("doc_id", record.alias("record")), ["doc_id"], "record")


def _lines(spark, sf_dir):
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))


def greedy_partners(spark, sf_dir):
    """Lines of an order paired by parts that are most alike, many ties among them (JOIN-26)."""
    i = _lines(spark, sf_dir).select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "part")
    pairs = i.alias("a").join(i.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.line") < F.col("b.line")))
    edges = pairs.select(F.col("a.line").alias("first"), F.col("b.line").alias("second"), (F.abs(F.col("a.part") - F.col("b.part")) % 5).alias("apart")).filter("apart < 4")
    return pairing.greedy_pairs(edges, "first", "second", ["apart"])


def stamp_halves(spark, sf_dir):
    """Regions of a page, one a line, with halves of a stamp as one (JOIN-26)."""
    n, part = F.col("l_linenumber"), F.col("part")
    r = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + n).alias("id"), ((part % 3) * 0.01 + 0.75 - F.floor(n / 4) * 0.3).alias("x"), (0.1 + n * 0.06).alias("y"), (0.16 + (part % 2) * 0.01).alias("width"), F.lit(0.1).alias("height"),
        F.lit("red").alias("color"), F.when(part % 11 == 0, "shipping").otherwise("customer").alias("role"), ((part % 100) / 1000.0).alias("pixel_ratio"),
    )
    j = pairing.join_halves(r, "page", "id")
    return j.select("page", "id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height", "pixel_ratio")], "color", "role", "joined")


_FNS = [patched_records, record_changes, rewritten_links, human_marks, greedy_partners, stamp_halves]
QUERIES = {f.__name__: f for f in _FNS}
_RECORD = """'{"order":{"a":{"deal":{"state":"' || o_orderstatus || '","total":' || o_orderkey || '},"number":' || o_custkey || '}},"sheet":{"page":1,"parts":[' || o_orderkey || ',' || (o_orderkey + 1) || ']}}'"""
_LINES = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2"
#: Edges e(g, k, a, b) of group g, gone through in order of k: each is taken if neither end is used.
_WALK = "walk AS (SELECT g, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM e GROUP BY g UNION ALL SELECT w.g, e.k, CASE WHEN list_contains(used, e.a) OR list_contains(used, e.b) THEN used ELSE used || [e.a, e.b] END, CASE WHEN list_contains(used, e.a) OR list_contains(used, e.b) THEN NULL ELSE e.a END, CASE WHEN list_contains(used, e.a) OR list_contains(used, e.b) THEN NULL ELSE e.b END FROM walk w JOIN e ON w.g = e.g AND e.k = w.k + 1)"
ORACLE_SQL = {
    "patched_records": f"""WITH m AS (SELECT o_orderkey, json_merge_patch({_RECORD}, '{{"order":{{"a":{{"deal":' || CASE o_orderkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{{"state":null,"total":7}}' WHEN 2 THEN '[1,null]' ELSE '{{"state":{{"x":null}}}}' END || '}}}}'
  || CASE o_orderkey % 3 WHEN 0 THEN ',"sheet":{{"page":2,"parts":null}}' WHEN 1 THEN ',"sheet":{{}}' ELSE '' END || '}}') AS m FROM orders)
SELECT o_orderkey, m ->> '$.order.a.deal.state' AS state, m ->> '$.order.a.deal.total' AS total, m ->> '$.order.a.number' AS number, m ->> '$.sheet.page' AS page, m ->> '$.sheet.parts' AS parts, length(m::VARCHAR)::INTEGER AS length FROM m""",
    "record_changes": """
WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '"order":{"a":{"deal":null}}' WHEN 1 THEN '"order":{"a":{"deal":{"total":' || (o_orderkey + 1) || '}}}' END AS deal,
  CASE o_orderkey % 7 WHEN 0 THEN '"sheet":null' WHEN 1 THEN '"sheet":"none"' WHEN 2 THEN '"sheet":{"parts":[' || (o_orderkey + 1) || ',' || o_orderkey || ']}' END AS sheet FROM orders)
SELECT o_orderkey, '{' || concat_ws(',', deal, sheet) || '}' AS patch, true AS exact FROM c""",
    "rewritten_links": r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^?]*') AS base FROM pages),
n AS (SELECT DISTINCT base FROM p WHERE page_id % 2 = 0),
s AS (SELECT page_id, p.base, n.base IS NOT NULL AS hit, substr(url, length(p.base) + 1) AS query, CASE WHEN n.base IS NULL THEN p.base ELSE '/kept' END AS named FROM p LEFT JOIN n USING (base))
SELECT page_id, '{"files":[{"at":' || to_json(named || query || '?v=1') || ',"more":["x",' || to_json(named) || ']}],"info":{"deep":{"own":' || to_json(named || query) || '}},"n":' || page_id || '}' AS record FROM s""",
    "human_marks": "SELECT doc_id, doc_id % 6 NOT IN (1, 3) AS edited FROM documents",
    "greedy_partners": f"""
WITH RECURSIVE i AS ({_LINES}), p AS (SELECT a.l_orderkey AS g, a.l_orderkey * 10 + a.l_linenumber AS a, b.l_orderkey * 10 + b.l_linenumber AS b, abs(a.part - b.part) % 5 AS apart FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
e AS (SELECT g, a, b, row_number() OVER (PARTITION BY g ORDER BY apart, a, b) AS k FROM p WHERE apart < 4),
{_WALK}
SELECT a AS first, b AS second, apart FROM walk JOIN p USING (g, a, b)""",
    "stamp_halves": f"""
WITH RECURSIVE i AS ({_LINES}), r AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS id, (part % 3) * 0.01::DOUBLE + 0.75::DOUBLE - floor(l_linenumber / 4) * 0.3::DOUBLE AS x, 0.1::DOUBLE + l_linenumber * 0.06::DOUBLE AS y, 0.16::DOUBLE + (part % 2) * 0.01::DOUBLE AS w, 0.1::DOUBLE AS h,
  CASE WHEN part % 11 = 0 THEN 'shipping' ELSE 'customer' END AS role, (part % 100) / 1000.0::DOUBLE AS ink FROM i),
p AS (SELECT a.page AS g, a.id AS a, b.id AS b, a.y AS ay, a.x AS ax, b.y AS byy, b.x AS bx, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w) AS side, least(a.w, b.w) / greatest(a.w, b.w) AS wr, abs(a.x + a.w / 2 - b.x - b.w / 2) / greatest(a.w, b.w) AS dx,
  abs(a.y + a.h / 2 - b.y - b.h / 2) / greatest(a.h, b.h) AS dy, greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.h, b.h) AS common FROM r a JOIN r b ON a.page = b.page AND a.role = b.role AND (a.y, a.x, a.id) < (b.y, b.x, b.id)),
e AS (SELECT g, a, b, row_number() OVER (PARTITION BY g ORDER BY ay, ax, a, -(side + wr + 1.0 - dx), byy, bx, b) AS k FROM p WHERE wr >= 0.88 AND side >= 0.82 AND dx <= 0.15 AND dy BETWEEN 0.48 AND 0.78 AND common BETWEEN 0.20 AND 0.55),
{_WALK}, t AS (SELECT a, b FROM walk WHERE a IS NOT NULL),
u AS (SELECT a.page, a.id, t.b AS joined, a.role, least(a.x, b.x) AS l, least(a.y, b.y) AS t, greatest(a.x + a.w, b.x + b.w) AS r, greatest(a.y + a.h, b.y + b.h) AS d, round(greatest(a.ink, b.ink), 4) AS ink FROM t JOIN r a ON a.id = t.a JOIN r b ON b.id = t.b),
v AS (SELECT page, id, joined, greatest(0, l - CASE WHEN r >= 0.9 THEN 0.04 ELSE 0.018 END) AS l, greatest(0, t - 0.01) AS t, least(1, r + CASE WHEN r >= 0.9 THEN 0.04 ELSE 0.018 END) AS r, least(1, d + 0.01) AS d, ink FROM u)
SELECT page, id, round(l, 6) AS x, round(t, 6) AS y, round(r - l, 6) AS width, round(d - t, 6) AS height, ink AS pixel_ratio, 'red' AS color, CASE WHEN (l + r) / 2 >= 0.5 OR (t + d) / 2 >= 0.62 THEN 'customer' ELSE 'shipping' END AS role, joined FROM v
UNION ALL SELECT page, id, round(x, 6), round(y, 6), w, h, ink, 'red', role, NULL FROM r WHERE id NOT IN (SELECT a FROM t) AND id NOT IN (SELECT b FROM t)""",
}
