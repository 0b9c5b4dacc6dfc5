"""Texts put together from fragments: what each rule joins, and what it leaves alone."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import fragments

CENTRE = "天地玄黄宇宙洪荒服务中心"
U, S = "圆章展开分带1", "保留章色旋转对照图"


@pytest.mark.parametrize(("readings", "ok"), [
    ([(U, "天地玄黄"), (S, "宇宙洪荒服务中心")], True), ([(U, "天地玄黄"), (S, "宇宙洪荒"), (S, "服务 中心")], True), ([(S, "天地玄黄"), (S, "宇宙洪荒服务中心")], False), ([(U, "天地玄黄"), (U, "宇宙洪荒服务中心")], False),
    ([(S, "天地玄黄"), ("圆章/矩形校正图", "宇宙洪荒服务中心")], False), ([(U, "天地玄黄宇"), (S, "宇宙洪荒服务中心")], False), ([(U, "天地"), (S, "玄黄"), (U, "宇宙洪荒"), (S, "服务中心")], False), ([(U, CENTRE), (S, "x")], False), ([("原图", "天地玄黄"), (U, "宇宙洪荒服务中心")], False),
    ([(U, "天地玄黄"), (U, "玄黄"), (S, "天地"), (S, "宇宙洪荒服务中心")], True), ([(U, "天"), (S, "地玄黄宇宙洪荒服务中心")], False),
])
def test_organizations_are_covered_in_order(spark, readings, ok):
    rows = spark.createDataFrame([(1, CENTRE, *r) for r in readings], "id int, requirement string, label string, text string")
    assert [tuple(r) for r in fragments.joined_organization(rows, ["id"]).collect()] == ([(1, CENTRE)] if ok else [])


def test_other_requirements_are_left_alone(spark):
    rows = spark.createDataFrame([(1, "天地服务中心", U, "天地"), (1, "天地服务中心", S, "服务中心"), (2, "天地玄黄宇宙洪荒a服务中心", U, "天地玄黄宇宙洪荒a"), (2, "天地玄黄宇宙洪荒a服务中心", S, "服务中心"), (3, None, U, "x"), (4, CENTRE, U, None)], "id int, requirement string, label string, text string")
    assert fragments.joined_organization(rows, ["id"]).count() == 0


def value(spark, column, ddl, *row):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first()["v"]


ACCEPT = "天地玄黄宇宙洪荒有限公司业务受理2专用章"


@pytest.mark.parametrize(("need", "texts", "conflict", "want"), [
    (ACCEPT, ["天地玄", "黄宇宙洪荒有限公司", "业务受理2"], False, "天地玄黄宇宙洪荒有限公司业务受理2"), (ACCEPT, ["天地玄", "黄宇宙洪荒有限公司", "业务受理"], False, ""), (ACCEPT, ["天地玄", "黄宇宙洪荒有限公司", "业务受理2"], True, ""),
    (ACCEPT, ["天地玄", "黄宇宙洪荒有限公司", "业务受理2", "天地玄黄宇宙洪荒有限公司"], False, ""), (ACCEPT, ["天", "地玄黄宇宙洪荒有限公司", "业务受理2"], False, ""), (ACCEPT, ["天地玄黄宇", "宙洪荒有限公司", "业务受理2"], False, ""),
    ("天地玄黄宇宙洪荒有限公司收货专用章", ["天地玄", "黄宇宙洪荒有限公司", "业务受理"], False, ""), ("业务受理", ["业务受理"], False, ""), (None, None, None, ""),
])
def test_acceptance_stamp(spark, need, texts, conflict, want):
    # a company of twelve letters is cut after its second to fourth
    assert value(spark, fragments.acceptance_stamp(F.col("n"), F.col("t"), F.col("c")), "n string, t array<string>, c boolean", need, texts, conflict) == want


@pytest.mark.parametrize(("need", "texts", "conflict", "want"), [
    ("甲乙有限公司收货专用章12", ["甲乙有限公司", "收货专用章", "12"], False, "甲乙有限公司收货专用章12"), ("甲乙有限公司收货专用章12", ["甲乙有限公司", "收货专用章"], False, ""), ("甲乙有限公司收货专用章", ["甲乙有限公司123456", "收货专用章"], False, "甲乙有限公司收货专用章"),
    ("甲乙有限公司收货专用章", ["甲乙有限公司12345", "收货专用章"], False, ""), ("甲乙有限公司丙分公司三星售后服务专用章", ["甲乙有限公司丙分公司", "三星售后服务专用章"], False, "甲乙有限公司丙分公司三星售后服务专用章"), ("甲乙有限公司丙分公司三星售后服务专用章", ["甲乙有限公司", "售后服务专用章"], False, ""),
    ("甲乙有限公司北京上海收货专用章", ["甲乙有限公司", "北京上海收货专用章"], False, ""), ("甲乙有限公司收货专用章", ["甲乙有限公司", "收货专用章"], True, ""), ("甲乙店收货专用章", ["甲乙店", "收货专用章"], False, ""), ("甲乙有限公司仓储部收货章", ["甲乙有限公司", "仓储部收货章"], None, "甲乙有限公司仓储部收货章"),
])
def test_company_stamp(spark, need, texts, conflict, want):
    assert value(spark, fragments.company_stamp(F.col("n"), F.col("t"), F.col("c")), "n string, t array<string>, c boolean", need, texts, conflict) == want


@pytest.mark.parametrize(("texts", "band", "want"), [
    (["甲乙丙有限公司"], [("收贷专用章", 0.75)], "甲乙丙有限公司收货专用章"), (["甲乙丙有限公司"], [("收贷专用章", 0.74)], ""), (["甲乙丙有限公司"], [("收货专用章", 0.9)], ""), (["甲乙丙有限公司"], [("送贷专用章", 0.9)], ""), (["甲乙丙有限公司"], [("收货专甲章", 0.9)], ""),
    (["甲乙丙有限公司", "甲乙丁有限公司"], [("收贷专用章", 0.9)], ""), (["甲乙丁有限公司"], [("收贷专用章", 0.9)], ""), (["甲乙丙有限公司12345678"], [("x", 0.9), ("收贷专用章", 0.9)], "甲乙丙有限公司收货专用章"), (None, None, ""),
])
def test_type_band_stamp(spark, texts, band, want):
    got = value(spark, fragments.type_band_stamp(F.col("n"), F.col("t"), F.col("b"), F.col("c")), "n string, t array<string>, b array<struct<text: string, confidence: double>>, c boolean", "甲乙丙有限公司收货专用章", texts, band, False)
    assert got == want


@pytest.mark.parametrize(("need", "bands", "texts", "want"), [
    ("甲乙有限公司业务受理专用章", ["甲乙有限公司"], ["业务受理"], "甲乙有限公司业务受理"), ("甲乙有限公司业务受理专用章", ["甲乙有限公司"], ["业务受理专用章"], "甲乙有限公司业务受理"), ("甲乙有限公司业务受理3专用章", ["甲乙有限公司"], ["业务受理专用章"], ""),
    ("甲乙有限公司业务受理3专用章", ["甲乙有限公司", "业务受理3"], [], "甲乙有限公司业务受理3"), ("甲乙有限公司业务受理", ["甲乙有限公司", "甲丙有限公司"], ["业务受理"], ""), ("甲乙有限公司收货", ["甲乙有限公司"], ["业务受理"], ""),
])
def test_band_company(spark, need, bands, texts, want):
    assert value(spark, fragments.band_company(F.col("n"), F.col("b"), F.col("t")), "n string, b array<string>, t array<string>", need, bands, texts) == want


@pytest.mark.parametrize(("first", "second", "want"), [
    (["天地玄黄宇宙洪荒服务中心"], ["x天地玄黄宇宙洪荒服务中心"], CENTRE), (["地玄黄宇宙洪荒服务中心"], [CENTRE], CENTRE[1:]), (["黄宇宙洪荒服务中心"], [CENTRE], CENTRE[3:]), (["宇宙洪荒服务中心"], [CENTRE], ""), ([CENTRE], ["天地"], ""), (None, [CENTRE], ""),
])
def test_shared_suffix(spark, first, second, want):
    assert value(spark, fragments.shared_suffix(F.col("n"), F.col("a"), F.col("b")), "n string, a array<string>, b array<string>", CENTRE, first, second) == want


def test_overlapping_repairs(spark):
    need, box = "甲乙丙丁有限公司维修专章", (0.1, 0.1, 0.2, 0.2)
    near, far, ink = (0.15, 0.15, 0.2, 0.2), (0.29, 0.29, 0.2, 0.2), "red"
    rows = [
        (1, need, 0, *box, ink, "收货客户章", ["甲乙", "维修专用章"], False), (1, need, 1, *near, ink, "收货客户章", ["丙丁有限公司"], False), (2, need, 0, *box, ink, "收货客户章", ["甲乙", "维修专用章"], False), (2, need, 1, *far, ink, "收货客户章", ["丙丁有限公司"], False),
        (3, need, 0, *box, ink, "收货客户章", ["甲乙", "维修专用章"], False), (3, need, 1, *near, "blue", "收货客户章", ["丙丁有限公司"], False), (4, need, 0, *box, ink, "收货客户章", ["丙丁有限公司"], None), (4, need, 1, *near, ink, "收货客户章", ["甲乙", "维修专用章"], None),
        (5, need, 0, *box, ink, "收货客户章", ["甲乙"], False), (5, need, 1, *near, ink, "收货客户章", ["丙丁有限公司"], False), (6, need, 0, *box, ink, "发货单位章", ["甲乙", "维修专用章"], False), (6, need, 1, *near, ink, "收货客户章", ["丙丁有限公司"], False), (7, need, 0, *box, ink, "收货客户章", ["甲乙", "丙丁有限公司", "维修专用章"], False),
    ]
    df = spark.createDataFrame(rows, "id int, requirement string, place int, x double, y double, width double, height double, color string, role string, texts array<string>, conflict boolean")
    assert sorted(tuple(r) for r in fragments.overlapping_repairs(df, ["id"], "place").collect()) == [(1, "甲乙丙丁有限公司维修专用章"), (4, "甲乙丙丁有限公司维修专用章")]


def test_texts_are_normalized_once(spark):
    from pyspark.sql import functions as F

    from docketry.operators import fragments

    d = spark.createDataFrame([("x", ["y"])], "need string, read array<string>")
    for made, times in ((fragments.company_stamp(F.col("need"), F.col("read"), F.lit(False)), 2), (fragments.acceptance_stamp(F.col("need"), F.col("read"), F.lit(False)), 2), (fragments.shared_suffix(F.col("need"), F.col("read"), F.col("read")), 3)):
        assert d.select(made.alias("t"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count("regexp_replace") == times
