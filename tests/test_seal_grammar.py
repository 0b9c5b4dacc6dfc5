"""Typed fields of stamps' wording, and stations compared field by field."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import seal_grammar as grammar

NAMES = [
    ("牡丹江市万邦通讯器材商店", "牡丹江市万邦通讯器材商店", "", "", "", "商店／门店"), ("华润万象汇三星授权体验店", "华润万象汇三星授权体验店", "", "", "", "授权体验店"), ("三星授权体验店东城星河城", "三星授权体验店东城星河城", "", "", "", "授权体验店"),
    ("太原市伊加壹电子服务总汇", "太原市伊加壹电子服务总汇", "", "", "", "维修／服务机构"), ("合肥佳元电子第一分公司手机售后专用章", "合肥佳元电子第一分公司", "", "手机售后专用章", "", "分公司"), ("北京集中维修中心业务章（3）", "北京集中维修中心", "", "业务章", "(3)", "服务／维修中心"),
    ("北京三星电子技术服务站维修专用章0004754613", "北京三星电子技术服务站", "", "维修专用章", "", "服务站"), ("京小服科技服务有限公司维修中心专用章（04）", "京小服科技服务有限公司", "", "维修中心专用章", "(04)", "公司"),
    ("深圳欧瑞特供应链管理有限公司福州仓库收货专用章（1）", "深圳欧瑞特供应链管理有限公司", "福州仓库", "收货专用章", "(1)", "公司"), ("重庆伟仕通供应链管理有限公司北京收货专用章", "重庆伟仕通供应链管理有限公司", "北京", "收货专用章", "", "公司"),
    ("银川恒久致远通信器材有限责任公司客户服务中心", "银川恒久致远通信器材有限责任公司", "客户服务中心", "", "", "公司"), ("广州花东仓020DCH收货专用章①/②", "广州花东仓", "", "收货专用章", "①/②", "仓库"), ("上海朱泾DC021DC0收货专用章①", "上海朱泾", "", "收货专用章", "①", "仓库"),
    ("北京亨通达科技有限公司西城西单分公司北售后服务专用章", "北京亨通达科技有限公司", "西城西单分公司", "北售后服务专用章", "", "公司"), ("站代码：598824702081769324广州中启通信科技有限公司", "广州中启通信科技有限公司", "", "", "", "公司"), ("三星电子服务中心上海信站代码6237106", "三星电子服务中心", "上海信", "", "", "服务／维修中心"),
]
FIELDS = [
    ("三星电子服务中心授权代码:6055487", "authorization_code", "6055487"), ("三星电子维修中心2310637", "station_code", "2310637"), ("三星电子服务中心取机专用章5785258站", "station_code", "5785258"), ("三星售后6183342站", "station_code", "6183342"),
    ("三星电子授权服务中心0431-88693789", "phone", "0431-88693789"), ("哈尔滨晨光智能科技有限公司维修专用章045153608531", "phone", "045153608531"), ("北京三星电子技术服务站维修专用章0004754613", "registration_code", "0004754613"),
    ("广州花东仓020DCH收货专用章①/②", "warehouse_code", "020DCH"), ("上海朱泾DC021DC0收货专用章①", "warehouse_code", "DC021DC0"), ("授权代码:598824702081769324广州中启通信科技有限公司", "authorization_code", "598824702081769324"),
]
OTHERS = [
    ("北京亨通达科技有限公司西城西单分公司甲售后服务专用章", {"branch": "西城西单分公司", "purpose": "售后服务专用章", "unclassified": "甲", "parse_status": "partial", "correction_supported": False}),
    ("完全未说明的机构甲", {"company": "", "purpose": "", "unclassified": "完全未说明的机构甲", "parse_status": "unparsed"}), ("甲有限公司或乙有限公司公章", {"supported": False, "parse_status": "partial"}), ("三星电子服务中心上海信", {"parse_status": "unparsed", "company": ""}),
    ("三星电子服务中心上海信站代码6237106", {"parse_status": "parsed", "groupable": False, "correction_supported": False}), ("北京甲乙电子技术有限公司服务专用章（04）", {"company": "北京甲乙电子技术有限公司", "number": "(04)", "correction_supported": True, "groupable": True}),
    ("北京永乐DC010DCM收货专用章②", {"correction_supported": False}), ("三星电子服务中心", {"groupable": False, "supported": True}), (None, {"parse_status": "unparsed", "name": ""}), ("", {"parse_status": "unparsed"}), ("（１）", {"number": "(1)", "parse_status": "partial"}),
]


@pytest.fixture(scope="module")
def terms(spark):
    texts = sorted({t for t, *_ in (*NAMES, *FIELDS, *OTHERS) if t is not None}) + [None]
    rows = spark.createDataFrame([(t, "kept") for t in texts], "text string, __rest string")
    return {r["text"]: r["terms"] for r in grammar.with_terms(rows.drop("__rest"), "text").collect()}


@pytest.mark.parametrize(("text", "company", "branch", "purpose", "number", "kind"), NAMES)
def test_names(terms, text, company, branch, purpose, number, kind):
    t = terms[text]
    assert (t["company"], t["branch"], t["purpose"], t["number"], t["entity_type"], t["parse_status"]) == (company, branch, purpose, number, kind, "parsed")


@pytest.mark.parametrize(("text", "kind", "value"), FIELDS)
def test_codes_and_contacts(terms, text, kind, value):
    t = terms[text]
    assert (t["identity_fields"][0]["kind"], t["identity_fields"][0]["value"], t["groupable"]) == (kind, value, False)
    assert value not in t["name"] and value not in t["purpose"]


@pytest.mark.parametrize(("text", "want"), OTHERS)
def test_what_is_not_known(terms, text, want):
    assert {k: terms[text][k] for k in want} == want


NEED = "三星电子服务中心上海信站代码6237106"
STAMP = "三星电子服务中心站代码上海信威6237106TEL:021-51035898上海市南京西路819号中创大区210€"


@pytest.mark.parametrize(("text", "want"), [
    (STAMP, (2, ["电话", "地址"], "上海信威")), (STAMP.replace("站代码上海信威", "上海信威站代码"), (2, ["电话", "地址"], "上海信威")), (STAMP.replace("TEL:", "tel"), (2, ["电话", "地址"], "上海信威")), (STAMP.replace("TEL:", "电话:"), (2, ["电话", "地址"], "上海信威")),
    (STAMP.split("TEL:")[0], (2, [], "上海信威")), (STAMP.replace("上海信威", "上海信"), (3, ["电话", "地址"], "上海信")), (STAMP[: STAMP.index("上海市")], (2, ["电话"], "上海信威")),
    *[(t, None) for t in (STAMP.replace("6237106", "6237107"), STAMP.replace("6237106", "623710"), STAMP.replace("6237106", "62371060"), STAMP.replace("6237106", ""), STAMP.replace("站代码", ""), STAMP.replace("三星电子服务中心", "其他电子服务中心"), STAMP.replace("上海信威", "北京信威"),
                          STAMP.replace("上海信威", "上海新威"), STAMP.replace("上海信威", "上海信威分公司"), STAMP.replace("中创大区", "中创公司"), STAMP + "TEL:021-51035898", "x", "", None)],
])
def test_stations(spark, text, want):
    got = spark.createDataFrame([(NEED, text)], "need string, text string").select(grammar.compare_stations(F.col("need"), F.col("text")).alias("v")).first()["v"]
    assert (got and (len(got["matched"]), got["additional"], got["read_name"])) == want
    if got:
        assert got["required_name"] == "上海信"
