"""Product tables from boxes: tilt, merged cells, repairs and confidence."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import products

DDL = "page long, text string, x double, y double, width double, height double, confidence double"
HEADER = [("行号", 0.05), ("产品类别", 0.13), ("物料编号", 0.3), ("等级", 0.45), ("数量", 0.62), ("EAN码", 0.9)]


def page(spark, rows, tilt=0.0, number=1):
    return spark.createDataFrame([(number, t, x, y + tilt * (x + w / 2), w, 0.01, c) for t, x, y, w, c in rows], DDL)


HEAD = [(name, x, 0.3, 0.04, 0.9) for name, x in HEADER]


@pytest.mark.parametrize("tilt", [0.0, 0.02, -0.03])
def test_merged_cells_and_tilt(spark, tilt):
    first = [("10", 0.05, 0.33, 0.02, 0.9), ("B1", 0.15, 0.33, 0.03, 0.8), ("SM-G9980 512GA", 0.3, 0.33, 0.16, 0.9), ("W001", 0.52, 0.33, 0.03, 0.9), ("5", 0.62, 0.33, 0.02, 0.9), ("0.4880.001", 0.70, 0.33, 0.1, 0.9), ("4006381333931", 0.88, 0.33, 0.1, 0.9)]
    second = [("20", 0.05, 0.36, 0.02, 0.9), ("SW-T", 0.23, 0.36, 0.03, 0.5), ("OS926/CNFC", 0.3, 0.36, 0.1, 0.7), ("A", 0.45, 0.36, 0.02, 0.9), ("；", 0.47, 0.36, 0.01, 0.9), ("x", 1.2, 0.36, 0.02, 0.9)]
    got = {r["line"]: r for r in products.product_table(page(spark, HEAD + first + second, tilt), "page").collect()}
    rows = sorted(got.values(), key=lambda r: r["cells"]["行号"])
    assert rows[0]["cells"] == {"行号": "10", "产品类别": "B1", "物料编号": "SM-G9980512G", "等级": "A", "出库仓库": "W001", "数量": "5", "重量": "0.488", "体积": "0.001", "EAN码": "4006381333931"}
    assert rows[0]["text"] == "10 | B1 | SM-G9980512G | A | W001 | 5 | 0.488 | 0.001 | 4006381333931"
    assert rows[1]["cells"] == {"行号": "20", "物料编号": "SM-T OS926/CNFC", "等级": "A"} and len(rows) == 2


@pytest.mark.parametrize(("column", "raw", "want"), [
    (products.WEIGHT, "可。1.286", "1.286"), (products.WEIGHT, "0. 409", "0.409"), (products.WEIGHT, "1.2 x 3", "1.2x3"), (products.EAN, "中4006381333931 页", "4006381333931"), (products.EAN, "中4006381333932", "中4006381333932"), (products.KIND, "bi", "B1"), (products.GRADE, ";A", "A"),
    (products.STORE, "wo12", "W012"), (products.STORE, "ab1", "AB1"), (products.MATERIAL, "si-TOS926CNFC red", "SM-T0S926CNFC red"), (products.MATERIAL, "SM-FOLDER", "SM-FOLDER"), (products.MATERIAL, "DX-92OEGCN", "DX-920EGCN"), (products.COUNT, " 1 2 ", "12"), (products.NUMBER, None, ""),
])
def test_repairs(spark, column, raw, want):
    got = spark.createDataFrame([(column, raw)], "c string, v string").select(products.repaired(F.col("c"), F.col("v")).alias("v")).first()["v"]
    assert got == want


@pytest.mark.parametrize(("column", "value", "weighted", "letters", "want"), [
    (products.EAN, "4006381333931", 6.5, 13, 0.99), (products.EAN, "4006381333932", 6.5, 13, 0.5), (products.STORE, "W001", 2.0, 4, 0.88), (products.GRADE, "A", 0.99, 1, 0.99), (products.MATERIAL, "SM-G998", 0.7, 7, 0.7), (products.MATERIAL, "SM", 1.0, 2, 0.5), (products.COUNT, "", 1.0, 1, 0.0), (products.WEIGHT, "0.4", 9.0, 3, 1.0),
])
def test_confidence(spark, column, value, weighted, letters, want):
    got = spark.createDataFrame([(column, value, weighted, letters)], "c string, v string, w double, n int").select(products.rated(*map(F.col, "cvwn")).alias("v")).first()["v"]
    assert got == want


def test_boxes_are_split_only_where_they_cross_the_edge(spark):
    rows = [("SM-A 512GA", 0.25, 0.1, 0.1, 0.9), ("SM-A 512GA", 0.40, 0.2, 0.1, 0.9), ("X1TBb", 0.4, 0.3, 0.1, 0.9), ("0.1230.456", 0.68, 0.4, 0.05, 0.9), ("0.1230.456", 0.70, 0.5, 0.1, 0.9), (".123.456", 0.74, 0.6, 0.03, 0.9)]
    got = sorted((round(r["y"], 1), r["column"], r["text"]) for r in products.assigned(page(spark, rows)).collect())
    assert got == sorted([(0.1, "物料编号", "SM-A 512GA"), (0.2, "物料编号", "SM-A512G"), (0.2, "等级", "A"), (0.3, "物料编号", "X1TB"), (0.3, "等级", "B"), (0.4, "重量", "0.1230.456"), (0.5, "重量", "0.123"), (0.5, "体积", "0.456"), (0.6, "重量", ".123"), (0.6, "体积", ".456")])


def test_pages_are_levelled_without_joins(spark):
    from docketry.operators import products

    made = [(1, n, e, 0.3 + 0.01 * e, 0.02, 0.01, 0.9) for n, e in products.COLUMNS] + [(None, "行号", 0.1, 0.3, 0.02, 0.01, 0.9), (2, "x", 0.5, 0.4, 0.02, 0.01, 0.9)]
    boxes = spark.createDataFrame(made, "page int, text string, x double, y double, width double, height double, confidence double")
    level = products.levelled(boxes, "page")
    assert "Join" not in level._jdf.queryExecution().optimizedPlan().toString()
    rows = level.collect()
    assert len(rows) == len(made) and {round(r["y"], 6) for r in rows if r["page"] == 1} == {0.2999} and {r["y"] for r in rows if r["page"] != 1} == {0.3, 0.4}


def test_boxes_are_not_shuffled(spark, sf_dir):
    """The lines are dealt by page once, as numbers; boxes are made, put on lines and joined to cells where they are."""
    from docketry.plans import pages

    plan = pages.merged_tables(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_cells_of_several_boxes(spark):
    """Texts of a cell go from left to right; a box without a confidence counts as zero, one without a text not at all."""
    rows = [("10", 0.05, 0.33, 0.02, 0.9), ("b", 0.3, 0.33, 0.01, None), ("aaa", 0.25, 0.33, 0.01, 0.4), (None, 0.27, 0.33, 0.01, 0.9), ("；", 0.45, 0.33, 0.01, 0.9), ("x9", 0.5, 0.33, 0.03, 0.5)]
    got = {r["column"]: (r["original"], r["value"], r["confidence"], r["repaired"]) for r in products.product_cells(page(spark, rows), "page").collect()}
    assert got == {"行号": ("10", "10", 0.9, False), "物料编号": ("aaa b", "aaa b", 0.3, False), "出库仓库": ("x9", "X9", 0.88, True)}
