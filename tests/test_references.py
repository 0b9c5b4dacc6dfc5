"""Gates and routes on both sides of every threshold, text conditions, and the order of routes."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import references as ref
from docketry.plans.stamps import _TEXTS

MEASURES = (*ref.LOCAL, *ref.CHROMATIC, *ref.TRIMMED, *ref.INK)
EVIDENCE = "receipt string, candidate int, reference string, " + ", ".join(f"{m} double" for m in MEASURES)
CHECKS = "receipt string, requirement string, recognized string, all_recognized array<string>, company_conflict boolean, company_score double"


def at_least(gate):
    return {m: float(v) for names, values in ref.GATES[gate].items() for m, v in zip(names, values)}


def rows(receipt, gate, change=None):
    """Evidence just at the gate; for votes the leading reference just has what it must."""
    base = dict.fromkeys(MEASURES, 0.0) | at_least(gate)
    top = dict(base)
    if gate in ref.VOTES:
        _, most, ratio = ref.VOTES[gate]
        lead = {"color_mask_consensus": "color_mask_score", "prefix_color_consensus": "color_mask_score", "chromatic_consensus": "chromatic_homography_inliers"}.get(gate, "homography_inliers")
        top[lead] = max(top[lead], float(most))
        if ratio:
            top["chromatic_inlier_ratio"] = max(top["chromatic_inlier_ratio"], ratio)
    both = [top, base] if gate in ref.VOTES else [top]
    for one in both:
        one.update(change or {})
    return [(receipt, 0, f"r{i}", *[one[m] for m in MEASURES]) for i, one in enumerate(both)]


def check(receipt, gate, score=0.9, conflict=None, texts=True):
    need, own, other, clash = _TEXTS.get(gate, ("x", "y", "z", False)) if texts else ("x", "y", "z", _TEXTS.get(gate, (0, 0, 0, False))[3])
    return (receipt, need, own, [other], clash if conflict is None else conflict, score)


@pytest.fixture(scope="module")
def routes(spark):
    checks, evidence = [], []
    for g in ref.ROUTES:
        checks.append(check(f"{g}|at", g))
        evidence += rows(f"{g}|at", g)
        for m, v in at_least(g).items():
            if v:
                checks.append(check(f"{g}|{m}", g))
                evidence += rows(f"{g}|{m}", g, {m: v - 0.001})
        if g in _TEXTS:
            checks.append(check(f"{g}|texts", g, texts=False))
            evidence += rows(f"{g}|texts", g)
        if g in ref.LEAST_SCORE:
            checks.append(check(f"{g}|score", g, score=ref.LEAST_SCORE[g] - 0.001))
            evidence += rows(f"{g}|score", g)
            checks.append(check(f"{g}|enough", g, score=ref.LEAST_SCORE[g]))
            evidence += rows(f"{g}|enough", g)
        if g in ref.VOTES:
            checks.append(check(f"{g}|alone", g))
            evidence += rows(f"{g}|alone", g)[:1]
            checks.append(check(f"{g}|twice", g))
            evidence += [(*r[:2], "same", *r[3:]) for r in rows(f"{g}|twice", g)]
        if g not in ref.SPECIFIC:
            checks.append(check(f"{g}|conflict", g, conflict=True))
            evidence += rows(f"{g}|conflict", g)
    checks.append(check("none|no evidence", "strict"))
    found = ref.decide(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(evidence, EVIDENCE), "receipt").collect()
    assert len(found) == len(checks) - 1
    return {r["receipt"]: r for r in found}


@pytest.mark.parametrize("gate", list(ref.ROUTES))
def test_gate_opens_at_its_thresholds_only(routes, gate):
    at = routes[f"{gate}|at"]
    assert (at["route"], at["accepted"], at["reference"]) == (ref.ROUTES[gate], True, "r0")
    base = ref.CONFIDENCE[gate][1]
    assert base <= at["confidence"] <= base + 0.02
    assert at["references"] == (2 if gate in ref.VOTES else 0)
    for receipt, r in routes.items():
        g, _, what = receipt.partition("|")
        if g == gate and what not in ("at", "enough"):
            assert r["route"] != ref.ROUTES[gate], receipt
        if g == gate and what == "conflict":
            assert (r["route"], r["confidence"]) == ("rejected", 0.0)
        if g == gate and what == "enough":
            assert r["route"] == ref.ROUTES[gate]


def test_confidence_grows_to_its_cap(spark):
    checks = [check(k, "strict") for k in ("a", "b")]
    evidence = rows("a", "strict", dict(zip(ref.LOCAL, (400.0, 400.0, 1.0, 1.0, 1.0)))) + rows("b", "strict", dict(zip(ref.LOCAL, (110.0, 110.0, 0.65, 0.30, 0.475))))
    got = {r["receipt"]: r["confidence"] for r in ref.decide(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(evidence, EVIDENCE), "receipt").collect()}
    assert got == {"a": 0.98, "b": 0.91}


@pytest.mark.parametrize(("need", "own", "gate", "ok"), [
    ("天地玄黄有限公司", "天地玄红有限公司", "bare_company_one_glyph", True), ("天地玄黄有限公司", "天地红红有限公司", "bare_company_one_glyph", False), ("天地玄黄有限公司", "天地玄黄有限公司", "bare_company_one_glyph", False),
    ("天地玄黄有限公司", "地玄黄有限公司", "clipped_company", False), ("天地玄黄宇宙有限公司", "玄黄宇宙有限公司", "clipped_company", True), ("天地玄黄宇宙有限公司", "天地玄黄宇宙有限公司", "clipped_company", False),
    ("甲乙丙丁戊己有限公司售后专用章", "乙丙丁戊己售后专用章", "company_conflict", False), ("甲乙丙丁戊己有限公司售后专用章", "丙丁戊己有限售后专用章", "company_conflict", True),
    ("三星电子服务中心取机专用章123456站", "三星电子服务中心", "branded_station", False), ("三星电子 服务中心取机专用章1234567站", "（三星电子服务中心）", "branded_station", True),
])
def test_texts(spark, need, own, gate, ok):
    row = spark.createDataFrame([(need, own, None, True, 0.95)], "requirement string, recognized string, all_recognized array<string>, company_conflict boolean, company_score double")
    assert row.select(F.coalesce(ref.allowed()[gate], F.lit(False)).alias("v")).first()["v"] is ok
