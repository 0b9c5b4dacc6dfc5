"""Queries of stamps that are compared with references: votes and routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, fragments, seal_grammar
from ..operators import references as ref
from ..sources.tables import dealt, table

_GATES = list(ref.ROUTES)
_MEASURES = (*ref.LOCAL, *ref.CHROMATIC, *ref.TRIMMED, *ref.INK)
#: Requirement, what was read, other readings, and whether companies conflict, for the routes that depend on them.
_TEXTS = {
    "company_conflict": ("甲乙丙丁戊己有限公司售后专用章", "乙丙丁戊己有限售后专用章", "x", True), "receiving_one_glyph": ("天地玄黄有限公司收货专用章", "收货专用章", "天地玄红有限公司", True), "bare_company_one_glyph": ("天地玄黄有限公司", "天地玄红有限公司", "x", True),
    "clipped_company": ("天地玄黄宇宙洪荒有限公司", "黄宇宙洪荒有限公司", "x", True), "branded_station": ("三星电子服务中心取机专用章1234567站", "三星电子服务中心", "x", False), "color_mask_consensus": ("天地玄黄有限公司", "天玄", "x", False),
    "prefix_color_consensus": ("甲乙丙丁戊己庚辛服务", "甲乙丙丁戊己庚", "x", False),
}


def _least(gate: str, measure: str) -> float:
    return next((float(v) for names, values in ref.GATES[gate].items() for m, v in zip(names, values) if m == measure), 0.0)


def _evidence(spark, sf_dir):
    """Lines as evidence: an order's measures lie about what one gate asks, a little below, at or above it."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    i = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    of = (F.col("l_orderkey") % len(_GATES)).cast("int") + 1
    share = F.element_at(F.array(F.lit(0.99), F.lit(1.0), F.lit(1.02), F.lit(1.25)), (F.col("p") % 4).cast("int") + 1)
    measures = [(F.element_at(F.array(*[F.lit(_least(g, m)) for g in _GATES]), of) * share).alias(m) for m in _MEASURES]
    return i.select(F.col("l_orderkey").alias("receipt"), (F.col("l_linenumber") % 2).alias("candidate"), F.concat(F.lit("r"), (F.col("p") % 3).cast("string")).alias("reference"), *measures)


def _checks(spark, sf_dir):
    k = F.col("o_orderkey")
    of, broken = (k % len(_GATES)).cast("int") + 1, k % 4 == 0
    part = lambda i, none: F.when(broken, F.lit(none)).otherwise(F.element_at(F.array(*[F.lit(_TEXTS.get(g, ("x", "y", "z", False))[i]) for g in _GATES]), of))
    conflict = part(3, False) | ((k % 5 == 0) & ~broken)
    return table(spark, sf_dir, "orders").select(k.alias("receipt"), part(0, "").alias("requirement"), part(1, "").alias("recognized"), F.array(part(2, "")).alias("all_recognized"), conflict.alias("company_conflict"), F.lit(0.9).alias("company_score"))


def reference_votes(spark, sf_dir):
    """The strongest candidate of each receipt by each kind of vote (AGG-33, AGG-34)."""
    return ref.consensus(_evidence(spark, sf_dir), "receipt").select("receipt", "kind", "candidate", "references", F.round("top", 6).alias("top"), F.round("second", 6).alias("second"), "accepted")


def reference_routes(spark, sf_dir):
    """By which route each receipt's stamp is accepted, and how surely (MCH-18, MCH-19, MAT-15, WIN-07, WIN-08)."""
    return ref.decide(_checks(spark, sf_dir), _evidence(spark, sf_dir), "receipt")


CENTRE = "天地玄黄宇宙洪荒服务中心"
_LABELS, _BEGINS, _SIZES = (fragments.UNWRAPPED, fragments.SAFE_READINGS[1], "原图"), (0, 4, 8, 0, 6, 4), (4, 4, 4, 6, 6, 8)


def fragment_paths(spark, sf_dir):
    """Orders whose lines, as fragments of a service organization, cover it in order (MCH-15)."""
    p = F.col("p")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    text = F.substring(F.lit(CENTRE), at(_BEGINS, p) + 1, at(_SIZES, p))
    return fragments.joined_organization(i.select("l_orderkey", F.lit(CENTRE).alias("requirement"), at(_LABELS, F.floor(p / 6)).alias("label"), text.alias("text")), ["l_orderkey"])


def fragment_texts(spark, sf_dir):
    """Parts' stamps from readings of their company, kind and ends, some missing or doubtful (MCH-15)."""
    k, brand = F.col("p_partkey"), F.translate("p_brand", "#B0123456789", "号乙子丑寅卯辰巳午未申酉")
    company = F.concat(F.lit("天地玄黄"), F.regexp_replace(brand, "[a-z]", ""), F.lit("有限公司"))
    kind = F.when(k % 2 == 0, "收货专用章").otherwise("三星检测专用章")
    read = F.array(F.when(k % 5 != 0, company).otherwise(F.lit("x")), F.when(k % 7 != 0, kind), F.when(k % 3 == 0, F.concat(company, F.lit("12345678"))))
    doubtful = F.array(F.struct(F.when(k % 2 == 0, "收贷专用章").otherwise("检册专用章").alias("text"), (0.7 + (k % 10) / 100.0).alias("confidence")))
    need, none = F.concat(company, kind), F.lit(False)
    # Parts are few bytes each, so a file of millions is read by one task or a few; the rules are dealt to all cores.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").repartition(4 * spark.sparkContext.defaultParallelism)
    return part.select(
        "p_partkey", fragments.company_stamp(need, read, k % 11 == 0).alias("stamp"), fragments.type_band_stamp(F.concat(company, F.regexp_replace(kind, "三星", "")), read, doubtful, none).alias("repaired"),
        fragments.band_company(F.concat(company, F.lit("业务受理"), (k % 3).cast("string"), F.lit("专用章")), F.array(company), F.array(F.concat(F.lit("业务受理"), (k % 4).cast("string")))).alias("accepted"),
        fragments.acceptance_stamp(F.concat(company, F.lit("业务受理")), F.array(F.substring(company, F.lit(1), (k % 4).cast("int") + 1), F.substring(company, (k % 4).cast("int") + 2, F.lit(99)), F.lit("业务受理")), none).alias("joined"),
        fragments.shared_suffix(F.lit(CENTRE), F.array(F.substring(F.lit(CENTRE), (k % 6).cast("int") + 1, F.lit(99))), F.array(F.lit("x"), F.lit(CENTRE))).alias("suffix"),
    )


def group_listing(spark, sf_dir):
    """Groups of parts with names in Han, Latin and digits, in the order of their listing (SRT-07, AGG-21)."""
    size = F.col("p_size")
    name = F.when(size % 5 == 0, F.concat(F.lit("张"), "p_brand")).when(size % 5 == 1, F.concat(F.lit("阿"), "p_brand")).when(size % 5 == 2, F.lower("p_brand")).when(size % 5 == 3, size.cast("string"))
    p = table(spark, sf_dir, "part").select(name.alias("company"), (F.col("p_partkey") % 2 == 0).alias("annotated"), (F.col("p_partkey") % 3 == 0).alias("evaluable"), (F.col("p_partkey") % 400 == 0).alias("anomalous"))
    g = evaluation.group_statistics(p, "company")
    return g.withColumn("place", F.row_number().over(Window.orderBy(*evaluation.group_order())))  # one row a group


def stamp_terms(spark, sf_dir):
    """The typed fields of wordings that are made of a company, branch, purpose, code and number (STR-18)."""
    k, brand = F.col("p_partkey"), F.regexp_replace(F.translate("p_brand", "#B0123456789", "号乙子丑寅卯辰巳午未申酉"), "[a-z]", "")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    text = F.concat(F.lit("甲乙 "), brand, F.lit("有限公司"), of(_BRANCHES, k), of(_PURPOSES, F.floor(k / 3)), of(("", "站代码：123456"), F.floor(k / 12)), of(("", "（3）", "①"), F.floor(k / 24)))
    t = seal_grammar.with_terms(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text")
    return t.select("p_partkey", "terms.company", "terms.branch", "terms.purpose", "terms.number", F.size("terms.identity_fields").alias("fields"), "terms.unclassified", "terms.parse_status", "terms.groupable")


def station_checks(spark, sf_dir):
    """Readings of a service station against the required one: other codes, names and contacts (MCH-08)."""
    k = F.col("p_partkey")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)
    text = F.concat(F.lit("三星电子服务中心"), of(_STATIONS, k), of(("站代码6237106", "站代码:6237106", "站代码6237107"), F.floor(k / 3)), of(("", "TEL:021-51035898", "电话021-51035898上海市南京西路819号", "电话021-51035898公司"), F.floor(k / 9)))
    c = seal_grammar.compare_stations(F.lit("三星电子服务中心上海信站代码6237106"), text)
    return table(spark, sf_dir, "part").select("p_partkey", c["read_name"].alias("name"), F.size(c["matched"]).alias("matched"), F.array_join(c["additional"], ",").alias("additional")).filter("name is not null")


_BRANCHES, _PURPOSES, _STATIONS = ("", "福州仓库", "北京"), ("收货专用章", "公章", "手机售后专用章", ""), ("上海信", "上海信威", "上海新威")
_FNS = [reference_votes, reference_routes, fragment_paths, fragment_texts, group_listing, stamp_terms, station_checks]
QUERIES = {f.__name__: f for f in _FNS}


def _passes(gate: str, prefix: str = "", names: dict[str, str] | None = None) -> str:
    return " AND ".join(f"{prefix}{(names or {}).get(m, m)} >= {float(v)}::DOUBLE" for ms, values in ref.GATES[gate].items() for m, v in zip(ms, values))


def _votes_sql() -> str:
    inked = "color_mask_score AS a, color_mask_correlation AS b, color_mask_dice AS c, inlier_ratio AS ratio"
    local = lambda p: f"{p}homography_inliers AS a, least({p}candidate_coverage, {p}reference_coverage) AS b, {p}good_matches AS c, {p}inlier_ratio AS ratio"
    rank = {"chromatic_consensus": local("chromatic_"), "color_mask_consensus": inked, "prefix_color_consensus": inked}
    votes = " UNION ALL ".join(f"SELECT receipt, '{k}' AS kind, candidate, reference, {rank.get(k, local(''))} FROM ev WHERE {_passes(k)}" for k in ref.VOTES)
    least = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {float(v[i])}::DOUBLE" for k, v in ref.VOTES.items()) + " END"
    measures = ", ".join("[" + ", ".join(f"{_least(g, m)}::DOUBLE" for g in _GATES) + f"][1 + l_orderkey % {len(_GATES)}] * [0.99::DOUBLE, 1.0::DOUBLE, 1.02::DOUBLE, 1.25::DOUBLE][1 + p % 4] AS {m}" for m in _MEASURES)
    return f"""
WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
ev AS (SELECT l_orderkey AS receipt, l_linenumber % 2 AS candidate, 'r' || (p % 3) AS reference, {measures} FROM i),
u AS ({votes}),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY receipt, kind, candidate, reference ORDER BY a DESC, b DESC, c DESC, ratio DESC) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY receipt, kind, candidate ORDER BY a DESC, b DESC, c DESC, ratio DESC, reference DESC) AS r FROM d),
g AS (SELECT receipt, kind, candidate, count(*)::INTEGER AS "references", max(a) FILTER (r = 1) AS top, max(a) FILTER (r = 2) AS second, sum(a) AS total, max(ratio) FILTER (r = 1) AS ratio, max(reference) FILTER (r = 1) AS reference FROM n GROUP BY 1, 2, 3),
v AS (SELECT *, "references" >= {least(0)} AND top >= {least(1)} AND ratio >= {least(2)} AS accepted FROM g),
best_vote AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY receipt, kind ORDER BY accepted DESC, "references" DESC, top DESC, total DESC, candidate) = 1)"""


def _routes_sql() -> str:
    ranks = {"best": "homography_inliers DESC, least(candidate_coverage, reference_coverage) DESC, good_matches DESC", "cut": "trimmed_chromatic_homography_inliers DESC, least(trimmed_chromatic_candidate_coverage, trimmed_chromatic_reference_coverage) DESC, trimmed_chromatic_good_matches DESC", "inked": "color_mask_score DESC, color_mask_correlation DESC, color_mask_dice DESC"}
    picks = ", ".join(f"{n} AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY receipt ORDER BY {o}, candidate, reference DESC) = 1)" for n, o in ranks.items())
    vote = ", ".join(f"v_{k} AS (SELECT e.*, b.second, b.\"references\" AS n_votes FROM best_vote b JOIN ev e ON b.receipt = e.receipt AND b.candidate = e.candidate AND b.reference = e.reference WHERE b.kind = '{k}' AND b.accepted QUALIFY row_number() OVER (PARTITION BY b.receipt ORDER BY {'e.color_mask_score DESC, e.color_mask_correlation DESC, e.color_mask_dice DESC' if 'color' in k else 'e.homography_inliers DESC, least(e.candidate_coverage, e.reference_coverage) DESC, e.good_matches DESC'}) = 1)" for k in ref.VOTES)
    of = f"o_orderkey % {len(_GATES)}"
    fits = lambda g: f"(o_orderkey % 4 <> 0 AND {of} = {_GATES.index(g)})"
    clash = f"(o_orderkey % 4 <> 0 AND ({of} IN ({', '.join(str(_GATES.index(g)) for g, t in _TEXTS.items() if t[3])}) OR o_orderkey % 5 = 0))"

    def opened(g: str) -> str:
        if g in ref.VOTES:
            held = f"v_{g}.receipt IS NOT NULL" + (f" AND NOT {clash}" if g in _TEXTS else "")
        else:
            held = _passes(g, {"trimmed_chromatic": "cut.", "color_mask": "inked.", "color_sift": "inked."}.get(g, "best."))
        return f"({held}{' AND ' + fits(g) if g in _TEXTS else ''})"

    case = lambda gates: "CASE " + " ".join(f"WHEN {opened(g)} THEN '{g}'" for g in gates) + " END"
    generic = [g for g in ref.ROUTES if g not in ref.SPECIFIC]

    def shown(m: str) -> str:
        trimmed, chromatic = (f"trimmed_chromatic_{m}", f"chromatic_{m}") if m in ref.LOCAL else (m, m)
        votes = " ".join(f"WHEN '{k}' THEN v_{k}.{chromatic if k == 'chromatic_consensus' else m}" for k in ref.VOTES)
        return f"CASE generic WHEN 'trimmed_chromatic' THEN cut.{trimmed} WHEN 'color_mask' THEN inked.{m} WHEN 'color_sift' THEN inked.{m} {votes} ELSE best.{m} END AS {m}"

    joins = "JOIN best USING (receipt) JOIN cut USING (receipt) JOIN inked USING (receipt) " + " ".join(f"LEFT JOIN v_{k} ON best.receipt = v_{k}.receipt" for k in ref.VOTES)
    seconds, counts = " ".join(f"WHEN '{k}' THEN v_{k}.second" for k in ref.VOTES), " ".join(f"WHEN '{k}' THEN v_{k}.n_votes" for k in ref.VOTES)
    low = "least(candidate_coverage, reference_coverage)"
    made = {"coverage": low, "second": "coalesce(second, 0)", "ink_margin": "least(color_mask_score, color_mask_correlation, color_mask_dice)", "ink_margin_low": "least(color_mask_score - 0.70::DOUBLE, color_mask_correlation - 0.70::DOUBLE, color_mask_dice - 0.65::DOUBLE)",
            "local_margin": f"99 * least((homography_inliers - 40) / 80, (inlier_ratio - 0.65::DOUBLE) / 0.25::DOUBLE, ({low} - 0.30::DOUBLE) / 0.30::DOUBLE)"}
    part = lambda w, m, floor, span: f"{w}::DOUBLE * least(1, greatest(0, ({made.get(m, m)} - {floor}::DOUBLE) / {span}::DOUBLE))"
    sure = " ".join(f"WHEN '{g}' THEN round(least({most}::DOUBLE, {base}::DOUBLE + {' + '.join(part(*p) for p in parts)}), 3)" for g, (most, base, parts) in ref.CONFIDENCE.items())
    names = " ".join(f"WHEN '{g}' THEN '{r}'" for g, r in ref.ROUTES.items())
    return f"""{_votes_sql()}, {picks}, {vote},
a AS (SELECT o_orderkey AS receipt, {case(ref.SPECIFIC)} AS specific, {case(generic)} AS generic, {clash} AS clash FROM (SELECT o_orderkey, o_orderkey AS receipt FROM orders) o {joins}),
b AS (SELECT receipt, specific, generic, coalesce(specific, CASE WHEN NOT clash THEN generic END) AS gate FROM a),
s AS (SELECT b.receipt, gate, CASE gate {seconds} END AS second, coalesce(CASE gate {counts} END, 0) AS "references", {', '.join(shown(m) for m in ('candidate', 'reference', *ref.LOCAL, 'chromatic_homography_inliers', *ref.INK))} FROM b {joins.replace('USING (receipt)', 'ON b.receipt = {}.receipt')})
SELECT receipt, coalesce(CASE gate {names} END, 'rejected') AS route, gate IS NOT NULL AS accepted, coalesce(CASE gate {sure} END, 0.0) AS confidence, candidate, reference, "references" FROM s""".replace("JOIN best ON b.receipt = {}", "JOIN best ON b.receipt = best").replace("JOIN cut ON b.receipt = {}", "JOIN cut ON b.receipt = cut").replace("JOIN inked ON b.receipt = {}", "JOIN inked ON b.receipt = inked")


ORACLE_SQL = {
    "reference_votes": f"{_votes_sql()} SELECT receipt, kind, candidate, \"references\", round(top, 6) AS top, round(second, 6) AS second, accepted FROM best_vote",
    "reference_routes": _routes_sql(),
    "fragment_paths": f"""
WITH i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
f AS (SELECT DISTINCT l_orderkey, (p // 6) % 3 AS label, {list(_BEGINS)}[1 + p % 6] AS a, {list(_BEGINS)}[1 + p % 6] + {list(_SIZES)}[1 + p % 6] AS b FROM i WHERE (p // 6) % 3 <> 2),
w AS (SELECT x.l_orderkey, [x.label, y.label] AS labels FROM f x JOIN f y ON x.l_orderkey = y.l_orderkey AND x.a = 0 AND x.b = y.a AND y.b = 12
  UNION ALL SELECT x.l_orderkey, [x.label, y.label, z.label] FROM f x JOIN f y ON x.l_orderkey = y.l_orderkey AND x.a = 0 AND x.b = y.a JOIN f z ON x.l_orderkey = z.l_orderkey AND y.b = z.a AND z.b = 12)
SELECT DISTINCT l_orderkey, '{CENTRE}' AS text FROM w WHERE len(list_distinct(labels)) >= 2""",
    "fragment_texts": f"""
WITH b AS (SELECT p_partkey AS k, '天地玄黄' || regexp_replace(translate(p_brand, '#B0123456789', '号乙子丑寅卯辰巳午未申酉'), '[a-z]', '', 'g') || '有限公司' AS c, CASE WHEN p_partkey % 2 = 0 THEN '收货专用章' ELSE '检测专用章' END AS kind FROM part)
SELECT k AS p_partkey, CASE WHEN k % 11 <> 0 AND k % 7 <> 0 AND (k % 5 <> 0 OR k % 3 = 0) THEN c || CASE WHEN k % 2 = 0 THEN '' ELSE '三星' END || kind ELSE '' END AS stamp,
  CASE WHEN (k % 5 <> 0 OR k % 3 = 0) AND k % 10 >= 5 THEN c || kind ELSE '' END AS repaired, CASE WHEN k % 3 = k % 4 THEN c || '业务受理' || (k % 3) ELSE '' END AS accepted,
  CASE WHEN k % 4 >= 1 AND k % 4 + 1 <= length(c) - 8 THEN c || '业务受理' ELSE '' END AS joined, CASE WHEN k % 6 <= 3 THEN substr('{CENTRE}', 1 + k % 6) ELSE '' END AS suffix FROM b""",
    "group_listing": """
WITH p AS (SELECT CASE p_size % 5 WHEN 0 THEN '张' || p_brand WHEN 1 THEN '阿' || p_brand WHEN 2 THEN lower(p_brand) WHEN 3 THEN p_size::VARCHAR ELSE '未分类' END AS label, p_partkey AS k FROM part),
g AS (SELECT label, count(*) AS total, count(*) FILTER (k % 2 = 0) AS annotated, count(*) FILTER (k % 3 = 0) AS evaluable, count(*) FILTER (k % 400 = 0) AS anomalies FROM p GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY anomalies DESC, total DESC, label COLLATE zh, label)::INTEGER AS place FROM g""",
    "stamp_terms": f"""
WITH b AS (SELECT p_partkey AS k, '甲乙' || regexp_replace(translate(p_brand, '#B0123456789', '号乙子丑寅卯辰巳午未申酉'), '[a-z]', '', 'g') || '有限公司' AS c, {list(_BRANCHES)}[1 + p_partkey % 3] AS b, {list(_PURPOSES)}[1 + (p_partkey // 3) % 4] AS p,
  (p_partkey // 12) % 2 AS f, ['', '(3)', '①'][1 + (p_partkey // 24) % 3] AS n FROM part), u AS (SELECT *, b = '北京' AND p = '' AS u FROM b)
SELECT k AS p_partkey, c AS company, CASE WHEN u THEN '' ELSE b END AS branch, p AS purpose, n AS number, f::INTEGER AS fields, CASE WHEN u THEN b ELSE '' END AS unclassified, CASE WHEN u THEN 'partial' ELSE 'parsed' END AS parse_status, NOT u AND f = 0 AS groupable FROM u""",
    "station_checks": f"""
SELECT p_partkey, {list(_STATIONS)}[1 + p_partkey % 3] AS name, CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 2 END AS matched, ['', '电话', '电话,地址'][1 + (p_partkey // 9) % 4] AS additional
FROM part WHERE p_partkey % 3 < 2 AND (p_partkey // 3) % 3 < 2 AND (p_partkey // 9) % 4 < 3""",
}
