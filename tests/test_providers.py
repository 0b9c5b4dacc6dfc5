"""Value tables of what several providers read: usable evidence, fields, stamps and samples."""

import pytest
from pyspark.sql import functions as F

from docketry.constants import MATCH, MISMATCH, PARTIAL, UNCONFIRMED, UNREAD
from docketry.operators import providers


def value(spark, column, ddl, *row):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("field", "raw", "want"), [
    ("仓库联系人", " 张三/李四； 王五|", "张三、李四、王五"), ("要求到货", "２０２５年3月4日", "2025-03-04"), ("要求到货", "2025-2-30", "2025-2-30"), ("要求到货", "2025/12/1", "2025-12-01"), ("实收数量", "1,234.50", "1234.5"), ("实收数量", "007.00", "7"), ("实收数量", "12,34", "12,34"), ("实收数量", "10", "10"),
    ("签章要求", "①（ Ａ ）", "①(A)"), ("客户", None, ""),
])
def test_canonical_fields(spark, field, raw, want):
    assert value(spark, providers.canonical_field(F.col("f"), F.col("v")), "f string, v string", field, raw) == want


@pytest.mark.parametrize(("row", "want"), [
    ((None, None, None, None, None, None), False), (("x", None, None, None, None, None), True), ((None, True, None, None, None, None), True), ((None, None, True, None, None, None), True), ((None, None, None, "mock", None, None), True), ((None, None, None, "live", "Waiting", None), True), ((None, False, False, "live", "匹配", "未运行"), True), (("", False, False, "", "匹配", ""), False),
])
def test_inactive(spark, row, want):
    assert value(spark, providers.inactive(*map(F.col, "abcdef")), "a string, b boolean, c boolean, d string, e string, f string", *row) is want


READINGS = "k int, field string, pos int, method string, provider string, value string, conf double, low boolean, known string, inactive boolean"


def test_fields_are_chosen_one_by_one(spark):
    rows = [
        (1, "要求到货", 1, "a", "p", "2025年3月4日", 0.7, None, None, False), (1, "要求到货", 2, "b", "p", "2025-03-04", 0.6, True, None, False), (1, "要求到货", 3, "c", "p", "soon", 0.99, None, None, False), (1, "实收数量", 1, "a", "p", "many", 0.9, None, None, False),
        (1, "客户", 1, "a", "p", "甲", 0.9, None, None, False), (1, "客户", 2, "b", "q", " 乙 ", 0.1, None, None, False), (1, "客户", 3, "c", "q", "丙", 0.99, None, None, True), (2, "客户", 1, "a", "p", "甲", 0.95, None, "乙", False), (2, "客户", 2, "b", "p", "丙", 0.7, None, None, False), (2, "空", 1, "a", "p", " ", 0.9, None, None, False),
    ]
    got = {(r["k"], r["field"]): (r["value"], r["method"], r["rule"], r["disputed"]) for r in providers.select_fields(spark.createDataFrame(rows, READINGS), ["k"], "q").collect()}
    assert got == {(1, "要求到货"): ("2025年3月4日", "a", "unanimous", False), (1, "实收数量"): ("many", "a", "format", False), (1, "客户"): ("乙", "b", "preferred", False), (2, "客户"): ("丙", "b", "rank", True)}
    hand = [(1, "签收人", 1, "a", "p", "张 三", 0.9, None, None, False), (1, "签收人", 2, "b", "p", "张三", 0.8, None, None, False)]
    assert [tuple(r) for r in providers.select_fields(spark.createDataFrame(hand, READINGS), ["k"], printed=False).collect()] == [(1, "签收人", "张 三", "a", "unanimous", False)]


CHECKS = "k int, pos int, provider string, source string, recognized string, status string, coverage double, similarity double, reliable boolean, simulated boolean"


@pytest.mark.parametrize(("checks", "policy", "mode", "want"), [
    ([("local", "甲", MATCH, 1.0, True, False), ("qingtong", "乙", PARTIAL, 0.9, True, False)], "any_exact", "any", ("local", MATCH, True)), ([("local", "甲", MATCH, 1.0, True, False), ("qingtong", "乙", PARTIAL, 0.9, True, False)], "any_exact", "all", ("local", PARTIAL, False)),
    ([("local", "甲", MATCH, 1.0, True, False), ("qingtong", "乙", PARTIAL, 0.9, True, False)], "qingtong_exact", "any", ("qingtong", PARTIAL, False)), ([("local", "甲", MATCH, 1.0, True, False)], "qingtong_exact", "any", ("local", MATCH, True)),
    ([("local", "甲", MATCH, 1.0, True, True), ("qingtong", "乙", MISMATCH, 0.1, True, False)], "any_exact", "any", ("qingtong", MISMATCH, False)), ([("local", "甲", MISMATCH, 0.2, True, False), ("qingtong", "乙", MISMATCH, 0.3, True, False)], "any_exact", "any", ("qingtong", MISMATCH, True)),
    ([("local", "甲", MATCH, 1.0, False, False)], "any_exact", "any", ("local", MATCH, False)), ([("local", "", MATCH, 1.0, True, False), ("qingtong", "x", MISMATCH, 0.0, True, False)], "any_exact", "any", ("qingtong", MISMATCH, True)), ([("local", None, UNREAD, None, None, None)], "any_exact", "all", ("local", UNREAD, False)),
    ([("local", "甲", MATCH, 1.0, True, False), ("qingtong", "甲", MATCH, 1.0, True, False)], "any_exact", "all", ("local", MATCH, True)),
])
def test_channels(spark, checks, policy, mode, want):
    rows = [(1, i, p, p, text, status, c, c, sure, fake) for i, (p, text, status, c, sure, fake) in enumerate(checks)]
    got = providers.combine_channels(spark.createDataFrame(rows, CHECKS), ["k"], policy, mode).first()
    assert (got["source"], got["status"], got["reliable"]) == want
    assert got["all_recognized"] == list(dict.fromkeys(t for _, t, *_ in checks if t))


@pytest.mark.parametrize(("row", "want"), [
    ((MISMATCH, True, False, False, "甲", "乙"), MATCH), ((MATCH, False, False, False, "甲", "甲"), MISMATCH), ((MISMATCH, None, False, True, "甲", "乙"), MATCH), ((MISMATCH, None, True, True, "甲", "乙"), MISMATCH), ((MATCH, None, True, False, "甲", "甲"), PARTIAL), ((PARTIAL, None, False, False, "甲", "甲"), PARTIAL),
    ((UNCONFIRMED, None, False, False, "甲", "甲"), MATCH), ((UNCONFIRMED, None, True, False, "甲", "甲"), PARTIAL), (("", None, False, False, "甲", " "), MISMATCH), ((None, None, None, None, "（甲）乙", "甲乙"), MATCH), ((None, None, True, None, "甲乙", "甲乙"), PARTIAL), ((None, None, None, None, "甲乙", "丙"), MISMATCH), ((None, None, None, None, None, "丙"), PARTIAL),
])
def test_sample_decisions(spark, row, want):
    assert value(spark, providers.sample_decision(*map(F.col, "abcdef")), "a string, b boolean, c boolean, d boolean, e string, f string", *row) == want
