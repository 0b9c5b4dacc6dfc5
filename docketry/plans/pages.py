"""Text boxes and similarities as queries: pages printed from orders are read back into rows, fields and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import boxes, products
from ..sources.tables import dealt, table

EDGES = [("number", 0.05), ("part", 0.2), ("quantity", 0.5), ("price", 0.7)]


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one page per order: a line for each row, with a slight jitter, and the customer's label and key above."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w))
    cells = [("number", F.col("n")), ("part", F.col("l_partkey")), ("quantity", F.col("l_quantity").cast("long")), ("price", F.floor(F.col("l_extendedprice")))]
    left = dict(EDGES)
    made = [
        F.struct(value.cast("string").alias("text"), F.lit(left[name] + 0.02).alias("x"), (0.3 + F.col("n") * 0.02 + (F.col("l_partkey") % 3 - 1) * 0.001 * i).alias("y"), F.lit(0.08).alias("width"), F.lit(0.008).alias("height"), (0.5 + (F.col("l_partkey") + i) % 50 / 100.0).alias("confidence"))
        for i, (name, value) in enumerate(cells)
    ]
    body = rows.select(F.col("l_orderkey").alias("page"), F.explode(F.array(*made)).alias("b")).select("page", "b.*")
    head = [("客户：", 0.1, F.lit(0.1)), (None, 0.3, F.lit(0.1)), ("总计", 0.1, F.lit(0.95)), ("收货单", 0.4, F.lit(0.02))]
    text = lambda t: F.lit(t) if t else F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    above = [F.struct(text(t).alias("text"), F.lit(x).alias("x"), y.alias("y"), F.lit(0.1).alias("width"), F.lit(0.008).alias("height"), F.lit(0.9).alias("confidence")) for t, x, y in head if t != "总计"]
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.array(*above)).alias("b")).select("page", "b.*")
    return body.union(titles)


def product_rows(spark, sf_dir):
    """The product table of each page, read from its boxes (TBF-03, TBF-04, WIN-19)."""
    return boxes.table_rows(_printed(spark, sf_dir), "page", EDGES, "number").select("page", "number", "part", "quantity", "price", F.round("confidence", 2).alias("confidence"))


def label_fields(spark, sf_dir):
    """The customer beside its label (TBF-01, JOIN-18)."""
    return boxes.right_of_labels(_printed(spark, sf_dir), "page", {"customer": ["客户", "客户："]})


def page_types(spark, sf_dir):
    """Pages by their keywords (TBF-05)."""
    kinds = {"receipt": ["收货单", "客户"], "continuation": ["续页", "页码"]}
    return boxes.page_type(_printed(spark, sf_dir), "page", kinds)


def band_join(spark, sf_dir):
    """Numbers and prices that stand on one line (JOIN-17)."""
    b = _printed(spark, sf_dir).filter("y > 0.25")
    number, price = b.filter("x < 0.1"), b.filter("x > 0.7")
    return boxes.band_pairs(number, price, "page", 0.006).select("page", "left", "right")


def overlaps(spark, sf_dir):
    """Boxes of a page that survive the suppression of overlapping ones (IMG-03)."""
    b = _printed(spark, sf_dir).filter("y > 0.25").select("page", "x", "y", "width", F.lit(0.03).alias("height"), "confidence")
    return boxes.suppress_overlaps(b, "page").groupBy("page").agg(F.count("*").alias("kept"))


def similarities(spark, sf_dir):
    """Part types against their neighbours' (MAT-02, MAT-03, MAT-04, MAT-06)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    a, b = F.col("p_type"), F.col("other")
    r = lambda c: F.round(c, 4)
    return p.join(q, "p_partkey").select("p_partkey", r(similarity.sequence_ratio(a, b)).alias("ratio"), r(similarity.windowed_ratio(a, b)).alias("windowed"), r(similarity.lcs_coverage(a, b)).alias("lcs"), similarity.longest_common_run(a, b).alias("run"))


def merged_tables(spark, sf_dir):
    """Product tables of tilted pages, one an order, with boxes that span two columns and misread cells (TBF-03, TBF-04, TBF-13, STR-12, STR-22, AGG-30)."""
    # Dealt by page once, as three numbers a line; the boxes are made where they are read.
    rows = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", heavy=True)
    i = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    i = i.withColumn("first", F.col("l_linenumber").eqNullSafe(F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))))
    n, p = F.col("l_linenumber"), F.col("p")
    tilt = (F.col("l_orderkey") % 5 - 2) * 0.01
    kind = F.element_at(F.array(F.lit("A1"), F.lit("BI"), F.lit(";C2")), (p % 3).cast("int") + 1)
    cells = [
        ((n * 10).cast("string"), 0.05, 0.02), (kind, 0.15, 0.03), (F.concat(F.lit("SM-"), F.lpad((p % 10000).cast("string"), 4, "0"), F.lit("128G"), F.when(p % 2 == 0, "B").otherwise("")), 0.3, 0.16), (F.when(p % 2 == 1, "A"), 0.45, 0.02), (F.when(p % 7 != 0, F.lit("wo12")), 0.52, 0.03),
        (F.lit("0.4880.001"), 0.70, 0.1),
    ]
    box = lambda text, x, width, y: F.struct(text.alias("text"), F.lit(x).alias("x"), F.lit(width).alias("width"), y.alias("y"))
    body = F.array(*[box(t, x, w, 0.35 + n * 0.03) for t, x, w in cells])
    head = F.array(*[box(F.lit(name), edge + 0.01, 0.03, F.lit(0.3)) for name, edge in products.COLUMNS])
    flat = i.select(F.col("l_orderkey").alias("page"), tilt.alias("tilt"), F.explode(F.concat(body, F.when(F.col("first"), head).otherwise(F.slice(head, 1, 0)))).alias("b")).filter("b.text is not null")
    made = flat.select("page", "b.text", "b.x", (F.col("b.y") + F.col("tilt") * (F.col("b.x") + F.col("b.width") / 2)).alias("y"), "b.width", F.lit(0.008).alias("height"), F.lit(0.5).alias("confidence"))
    t = products.product_table(made, "page")
    return t.select("page", F.col("cells")[products.NUMBER].alias("number"), "text", "confidence")


_FNS = [merged_tables, product_rows, label_fields, page_types, band_join, overlaps, similarities]
QUERIES = {f.__name__: f for f in _FNS}
_ROWS = "r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem)"
ORACLE_SQL = {
    "product_rows": f"WITH {_ROWS} SELECT l_orderkey AS page, n::VARCHAR AS number, l_partkey::VARCHAR AS part, l_quantity::BIGINT::VARCHAR AS quantity, floor(l_extendedprice)::BIGINT::VARCHAR AS price, round(least(0.5 + l_partkey % 50 / 100.0::DOUBLE, 0.5 + (l_partkey + 1) % 50 / 100.0::DOUBLE, 0.5 + (l_partkey + 2) % 50 / 100.0::DOUBLE, 0.5 + (l_partkey + 3) % 50 / 100.0::DOUBLE), 2) AS confidence FROM r",
    "label_fields": "SELECT o_orderkey AS page, 'customer' AS field, 'C' || o_custkey AS value FROM orders",
    "page_types": "SELECT o_orderkey AS page, 'receipt' AS type, 2 AS hits FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'unknown', 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "band_join": f"WITH {_ROWS} SELECT l_orderkey AS page, n::VARCHAR AS \"left\", floor(l_extendedprice)::BIGINT::VARCHAR AS \"right\" FROM r",
    "merged_tables": """
WITH i AS (SELECT l_orderkey AS page, l_linenumber * 10 AS number, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT page, number::VARCHAR AS number, number || ' | ' || ['A1', 'B1', 'C2'][1 + p % 3] || ' | SM-' || lpad((p % 10000)::VARCHAR, 4, '0') || '128G | ' || CASE WHEN p % 2 = 0 THEN 'B' ELSE 'A' END || ' | ' || CASE WHEN p % 7 <> 0 THEN 'W012' ELSE '' END || ' |  | 0.488 | 0.001 | ' AS text,
  round((0.9 + 0.86 + 0.7 + 0.85 + CASE WHEN p % 7 <> 0 THEN 0.88 ELSE 0 END + 0.9 + 0.9)::DOUBLE / 9, 3) AS confidence FROM i""",
}
