"""Visual references: gates, votes of several references, and the route by which a stamp is accepted.

Evidence has a row for each receipt, candidate region and reference, with
measures of local features (also of the coloured ink alone, and of that
trimmed) and of the ink as a whole.  Gates, routes and confidences are tables
that are compiled into expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.measures import subsequence

LOCAL = ("good_matches", "homography_inliers", "inlier_ratio", "candidate_coverage", "reference_coverage")
INK = ("color_mask_score", "color_mask_correlation", "color_mask_dice")
CHROMATIC, TRIMMED = tuple(f"chromatic_{m}" for m in LOCAL), tuple(f"trimmed_chromatic_{m}" for m in LOCAL)
# What each gate asks of these measures at least, in the order of the names.
GATES = {
    "strict": {LOCAL: (110, 80, 0.65, 0.30, 0.30)},
    "high_ratio": {LOCAL: (105, 80, 0.70, 0.30, 0.30)},
    "high_support": {LOCAL: (130, 100, 0.70, 0.28, 0.28)},
    "ultra_support": {LOCAL: (145, 105, 0.70, 0.24, 0.24)},
    "trimmed_chromatic": {TRIMMED: (90, 75, 0.80, 0.50, 0.50)},
    "branded_station": {LOCAL: (95, 70, 0.72, 0.50, 0.50)},
    "company_conflict": {LOCAL: (180, 130, 0.70, 0.50, 0.50), CHROMATIC: (175, 140, 0.78, 0.50, 0.50)},
    "receiving_one_glyph": {LOCAL: (125, 100, 0.80, 0.60, 0.60), CHROMATIC: (125, 100, 0.75, 0.60, 0.60)},
    "bare_company_one_glyph": {LOCAL: (95, 60, 0.64, 0.60, 0.60), CHROMATIC: (90, 60, 0.64, 0.58, 0.58), INK: (0.77, 0.78, 0.77)},
    "clipped_company": {LOCAL: (195, 160, 0.80, 0.38, 0.55), CHROMATIC: (180, 160, 0.85, 0.50, 0.60)},
    "color_mask": {INK: (0.80, 0.80, 0.80)},
    "color_sift": {INK: (0.70, 0.70, 0.65), LOCAL: (60, 40, 0.65, 0.30, 0.30)},
    # Votes: a reference counts for its candidate.
    "consensus": {LOCAL: (98, 65, 0.65, 0.30, 0.30)},
    "high_purity_consensus": {LOCAL: (85, 65, 0.70, 0.30, 0.30)},
    "chromatic_consensus": {CHROMATIC: (100, 65, 0.68, 0.24, 0.24)},
    "color_mask_consensus": {INK: (0.68, 0.68, 0.70), LOCAL: (50, 15, 0, 0.15, 0.20)},
    "prefix_color_consensus": {INK: (0.64, 0.66, 0.59), LOCAL: (28, 15, 0.53, 0.19, 0.21)},
}
# References that must agree, and what the leading one must have (inliers or ink score, inlier ratio).
VOTES = {"consensus": (2, 75, 0.0), "high_purity_consensus": (2, 70, 0.0), "chromatic_consensus": (2, 95, 0.85), "color_mask_consensus": (2, 0.74, 0.0), "prefix_color_consensus": (2, 0.67, 0.0)}
# Least company scores, and lengths of texts.
LEAST_SCORE = {"company_conflict": 0.82, "receiving_one_glyph": 0.87, "bare_company_one_glyph": 0.83, "clipped_company": 0.60, "color_mask_consensus": 0.15, "prefix_color_consensus": 0.70}
SHARED_FRAGMENT, CLIPPED_LENGTH, CLIPPED_MOST, PREFIX_LENGTH = 6, 8, 4, 7
AFTER_SALES, RECEIVING, BRAND = "售后专用章", "收货专用章", "三星电子服务中心"
LEGAL = r"(有限责任公司|有限公司)$"
BARE_COMPANY = r"^[一-鿿A-Za-z0-9（）()·]+(有限责任公司|有限公司)$"
STATION = r"^三星电子服务中心取机专用章[0-9]{7}站$"
# The routes in the order in which they are tried; those after the fourth are closed where companies conflict.
ROUTES = {
    "company_conflict": "company_conflict_ultra_reference", "receiving_one_glyph": "receiving_one_glyph_reference", "bare_company_one_glyph": "bare_company_one_glyph_reference", "clipped_company": "clipped_prefix_company_ultra_reference",
    "strict": "strict_single_reference", "high_ratio": "high_ratio_single_reference", "high_support": "high_support_minor_coverage", "ultra_support": "ultra_support_partial_coverage", "branded_station": "branded_station_single_reference",
    "trimmed_chromatic": "trimmed_chromatic_single_reference", "consensus": "multi_reference_consensus", "high_purity_consensus": "high_purity_multi_reference_consensus", "chromatic_consensus": "chromatic_crop_multi_reference_consensus",
    "color_mask_consensus": "color_mask_multi_reference_consensus", "prefix_color_consensus": "strong_prefix_color_mask_multi_reference_consensus", "color_mask": "color_mask_geometry", "color_sift": "color_mask_sift_geometry",
}
SPECIFIC = tuple(ROUTES)[:4]
REJECTED = "rejected"
# Confidence of a route: the most, the base, and (weight, measure, floor, span) of what is added, each share of its span at most 1.
CONFIDENCE = {
    "strict": (0.98, 0.90, [(0.04, "homography_inliers", 80, 120), (0.02, "inlier_ratio", 0.65, 0.25), (0.02, "coverage", 0.30, 0.35)]),
    "high_ratio": (0.98, 0.90, [(0.04, "homography_inliers", 80, 120), (0.02, "inlier_ratio", 0.65, 0.25), (0.02, "coverage", 0.30, 0.35)]),
    "high_support": (0.96, 0.92, [(0.02, "homography_inliers", 100, 60), (0.01, "inlier_ratio", 0.70, 0.20)]),
    "ultra_support": (0.95, 0.92, [(0.02, "homography_inliers", 105, 60), (0.01, "inlier_ratio", 0.70, 0.20)]),
    "branded_station": (0.95, 0.92, [(0.02, "homography_inliers", 70, 40), (0.01, "inlier_ratio", 0.72, 0.15)]),
    "trimmed_chromatic": (0.95, 0.92, [(0.02, "homography_inliers", 75, 40), (0.01, "inlier_ratio", 0.80, 0.15)]),
    "company_conflict": (0.96, 0.93, [(0.02, "homography_inliers", 130, 60), (0.01, "inlier_ratio", 0.70, 0.15)]),
    "receiving_one_glyph": (0.96, 0.94, [(0.01, "homography_inliers", 100, 30), (0.01, "chromatic_homography_inliers", 100, 30)]),
    "bare_company_one_glyph": (0.96, 0.94, [(0.01, "homography_inliers", 60, 30), (0.01, "color_mask_score", 0.77, 0.15)]),
    "clipped_company": (0.97, 0.95, [(0.01, "homography_inliers", 160, 40), (0.01, "chromatic_homography_inliers", 160, 40)]),
    "consensus": (0.94, 0.91, [(0.03, "second", 65, 15)]),
    "high_purity_consensus": (0.94, 0.91, [(0.03, "second", 65, 15)]),
    "chromatic_consensus": (0.94, 0.91, [(0.03, "second", 65, 15)]),
    "color_mask_consensus": (0.94, 0.92, [(0.20, "second", 0.68, 1)]),
    "prefix_color_consensus": (0.94, 0.92, [(0.20, "second", 0.64, 1)]),
    "color_mask": (0.96, 0.91, [(0.5, "ink_margin", 0.80, 1)]),
    "color_sift": (0.95, 0.91, [(0.20, "ink_margin_low", 0, 1), (0.02, "local_margin", 0, 99)]),
}


def passes(gate: str, of=F.col) -> Column:
    """Whether the measures reach all that the gate asks (MCH-18); a missing measure is zero."""
    asked = [F.coalesce(of(m), F.lit(0)) >= least for names, values in GATES[gate].items() for m, least in zip(names, values)]
    return reduce(lambda a, b: a & b, asked)


def local_rank(names=LOCAL) -> Column:
    """By inliers, then by the smaller coverage, then by matches (WIN-07)."""
    matches, inliers, _, a, b = [F.coalesce(F.col(n), F.lit(0)).cast("double") for n in names]
    return F.struct(inliers.alias("inliers"), F.least(a, b).alias("coverage"), matches.alias("matches"))


def ink_rank() -> Column:
    """By score, correlation and overlap of the ink (WIN-08)."""
    a, b, c = [F.coalesce(F.col(n), F.lit(0)).cast("double") for n in INK]
    return F.struct(a.alias("inliers"), b.alias("coverage"), c.alias("matches"))


def consensus(evidence: DataFrame, receipt: str) -> DataFrame:
    """For each receipt and kind of vote the strongest candidate (AGG-33, AGG-34): candidate, reference, references, top, second and accepted.

    A reference counts once for a candidate, with its best evidence.  Counts
    combine before the shuffle; what is gathered is one candidate's references.
    """
    kinds = F.filter(F.array(*[F.when(passes(k), F.lit(k)) for k in VOTES]), F.isnotnull)
    inked = F.col("kind").isin("color_mask_consensus", "prefix_color_consensus")
    rank = F.when(inked, ink_rank()).when(F.col("kind") == "chromatic_consensus", local_rank(CHROMATIC)).otherwise(local_rank())
    ratio = F.when(F.col("kind") == "chromatic_consensus", F.col("chromatic_inlier_ratio")).otherwise(F.col("inlier_ratio")).cast("double")
    named = evidence.filter((F.col("candidate") >= 0) & (F.coalesce("reference", F.lit("")) != ""))
    votes = named.withColumn("kind", F.explode(kinds)).groupBy(receipt, "kind", "candidate", "reference").agg(F.max(F.struct(rank.alias("rank"), F.coalesce(ratio, F.lit(0.0)).alias("ratio"))).alias("v"))
    least = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in VOTES.items() for x in (k, float(v[i]))]), F.col("kind"))
    each = votes.groupBy(receipt, "kind", "candidate").agg(F.reverse(F.array_sort(F.collect_list(F.struct("v.rank", "v.ratio", "reference")))).alias("m"))
    top = F.col("m")[0]
    held = each.select(
        receipt, "kind", "candidate", F.size("m").alias("references"), top["rank"]["inliers"].alias("top"), F.get("m", F.lit(1))["rank"]["inliers"].alias("second"), top["reference"].alias("reference"),
        F.aggregate("m", F.lit(0.0), lambda n, x: n + x["rank"]["inliers"]).alias("total"), ((F.size("m") >= least(0)) & (top["rank"]["inliers"] >= least(1)) & (top["ratio"] >= least(2))).alias("accepted"),
    )
    order = F.struct("accepted", "references", "top", "total", (-F.col("candidate")).alias("first"))
    return held.groupBy(receipt, "kind").agg(F.max_by(F.struct("candidate", "reference", "references", "top", "second", "accepted"), order).alias("c")).select(receipt, "kind", "c.*")


def _one_glyph(fragments: Column, company: Column) -> Column:
    """Whether a fragment is a company of the same length that differs in one place."""
    places = lambda x: F.size(F.filter(F.sequence(F.lit(1), F.length(company)), lambda i: F.substring(x, i, F.lit(1)) != F.substring(company, i, F.lit(1))))
    return F.exists(fragments, lambda x: (F.length(x) == F.length(company)) & x.rlike(LEGAL) & (F.length(company) > 0) & (places(x) == 1))


def allowed(requirement: str = "requirement", recognized: str = "recognized", others: str = "all_recognized", conflict: str = "company_conflict", score: str = "company_score") -> dict[str, Column]:
    """What the texts of a stamp must be like for the routes that depend on them."""
    need, own = text.normalize(F.col(requirement)), text.normalize(F.col(recognized))
    fragments = F.concat(F.array(own), F.transform(F.coalesce(F.col(others), F.array().cast("array<string>")), text.normalize))
    joined = F.array_join(fragments, "")
    clash, s = F.coalesce(F.col(conflict), F.lit(False)), F.coalesce(F.col(score), F.lit(0.0))
    before = lambda end: F.substring(need, F.lit(1), F.length(need) - len(end))
    pieces = lambda c: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: i + SHARED_FRAGMENT - 1 <= F.length(c)), lambda i: F.substring(c, i, F.lit(SHARED_FRAGMENT)))
    bare, missing = need.rlike(BARE_COMPANY), F.length(need) - F.length(own)
    prefix = F.coalesce(F.array_max(F.transform(F.filter(fragments, lambda x: x.rlike(r"^[一-鿿]+$") & need.startswith(x)), F.length)), F.lit(0))
    han = F.regexp_replace(need, r"[^一-鿿]", "")
    return {
        "company_conflict": clash & need.endswith(AFTER_SALES) & joined.contains(AFTER_SALES) & F.exists(pieces(before(AFTER_SALES)), lambda p: joined.contains(p)) & (s >= LEAST_SCORE["company_conflict"]),
        "receiving_one_glyph": clash & need.endswith(RECEIVING) & before(RECEIVING).rlike(LEGAL) & F.exists(fragments, lambda x: x.contains(RECEIVING)) & _one_glyph(fragments, before(RECEIVING)) & (s >= LEAST_SCORE["receiving_one_glyph"]),
        "bare_company_one_glyph": clash & bare & _one_glyph(fragments, need) & (s >= LEAST_SCORE["bare_company_one_glyph"]),
        "clipped_company": clash & need.rlike(LEGAL) & own.rlike(LEGAL) & (F.length(own) >= CLIPPED_LENGTH) & need.endswith(own) & missing.between(1, CLIPPED_MOST) & (s >= LEAST_SCORE["clipped_company"]),
        "branded_station": need.rlike(STATION) & own.contains(BRAND),
        "color_mask_consensus": ~clash & bare & (s >= LEAST_SCORE["color_mask_consensus"]) & F.exists(fragments, lambda x: x.rlike(r"^[一-鿿]{2,6}$") & subsequence(x, han)),
        "prefix_color_consensus": ~clash & need.rlike(r"^[一-鿿]{8,20}$") & ~bare & (s >= LEAST_SCORE["prefix_color_consensus"]) & (prefix >= PREFIX_LENGTH),
    }


def _margin(measures: dict[str, float]) -> Column:
    return F.least(*[F.coalesce(F.col(f"b.{m}"), F.lit(0.0)) - floor for m, floor in measures.items()])


def confidence(gate: Column) -> Column:
    """The route's confidence from the evidence ``b`` that stands for it and the second vote (MAT-15)."""
    low = F.least("b.candidate_coverage", "b.reference_coverage")
    made = {
        "coverage": low, "second": F.coalesce("second", F.lit(0.0)), "ink_margin": _margin(dict.fromkeys(INK, 0.80)) + 0.80, "ink_margin_low": _margin(dict(zip(INK, (0.70, 0.70, 0.65)))),
        "local_margin": F.least((F.col("b.homography_inliers") - 40) / 80, (F.col("b.inlier_ratio") - 0.65) / 0.25, (low - 0.30) / 0.30) * 99,
    }
    out = F.lit(0.0)
    for name, (most, base, parts) in CONFIDENCE.items():
        share = lambda m, floor, span: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (made.get(m, F.coalesce(F.col(f"b.{m}"), F.lit(0.0))) - floor) / span))
        value = F.least(F.lit(most), F.lit(base) + sum((w * share(m, floor, span) for w, m, floor, span in parts[1:]), parts[0][0] * share(*parts[0][1:])))
        out = F.when(gate == name, F.round(value, 3)).otherwise(out)
    return out


def decide(checks: DataFrame, evidence: DataFrame, receipt: str) -> DataFrame:
    """The route by which each receipt's stamp is accepted, the first that is open, or none (MCH-19).

    ``checks`` has the receipt, requirement, recognized, all_recognized,
    company_conflict and company_score; receipts without evidence have no row.
    Returns route, accepted, confidence, candidate, reference and references
    (votes).  The evidence that stands for a vote is the leading reference's.
    """
    local, ink = [c for c in evidence.columns if c != receipt], F.struct("candidate", "reference", *LOCAL, *CHROMATIC, *INK)
    tie = F.struct((-F.col("candidate")).alias("c"), F.col("reference").alias("r"))
    trimmed = F.struct("candidate", "reference", *[F.col(t).alias(m) for t, m in zip(TRIMMED, LOCAL)], *CHROMATIC, *INK)
    assert set(LOCAL) <= set(local)
    best = evidence.groupBy(receipt).agg(
        F.max_by(ink, F.struct(local_rank(), tie)).alias("best"), F.max_by(trimmed, F.struct(local_rank(TRIMMED), tie)).alias("cut"), F.max_by(ink, F.struct(ink_rank(), tie)).alias("inked"),
    )
    votes = consensus(evidence, receipt)
    lead = votes.filter("accepted").join(evidence, [receipt, "candidate", "reference"]).groupBy(receipt, "kind").agg(
        F.max_by(F.struct("candidate", "reference", *LOCAL, *CHROMATIC, *INK), F.when(F.col("kind").isin("color_mask_consensus", "prefix_color_consensus"), ink_rank()).otherwise(local_rank())).alias("e"), F.first("second").alias("second"), F.first("references").alias("references"),
    )
    shown = F.when(F.col("kind") == "chromatic_consensus", F.struct("e.candidate", "e.reference", *[F.col(f"e.{c}").alias(m) for c, m in zip(CHROMATIC, LOCAL)], *[F.col(f"e.{c}").alias(c) for c in (*CHROMATIC, *INK)])).otherwise(F.col("e"))
    wide = lead.groupBy(receipt).agg(*[F.max_by(F.struct(shown.alias("e"), "second", "references"), F.when(F.col("kind") == k, 1)).alias(k) for k in VOTES])
    texts = allowed()
    joined = checks.join(best, receipt).join(wide, receipt, "left")
    clash = F.coalesce("company_conflict", F.lit(False))
    of = lambda s: lambda m: F.col(f"{s}.{m}")

    def opened(gate: str) -> Column:
        if gate in VOTES:
            held = F.col(gate).isNotNull()
        elif gate == "trimmed_chromatic":
            held = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"cut.{m}"), F.lit(0)) >= least for m, least in zip(LOCAL, GATES[gate][TRIMMED])])
        else:
            held = passes(gate, of("inked" if gate in ("color_mask", "color_sift") else "best"))
        return held & texts[gate] if gate in texts else held

    first = lambda gates: F.coalesce(*[F.when(opened(g), F.lit(g)) for g in gates])
    tried = joined.withColumns({"specific": first(SPECIFIC), "generic": first([g for g in ROUTES if g not in SPECIFIC])})
    picked = tried.withColumn("gate", F.coalesce("specific", F.when(~clash, F.col("generic"))))
    # What is shown for a route that overrules a conflict, too, is the evidence that the others would show.
    source = F.when(F.col("generic") == "trimmed_chromatic", F.col("cut")).when(F.col("generic").isin("color_mask", "color_sift"), F.col("inked"))
    for k in VOTES:
        source = source.when(F.col("generic") == k, F.col(f"{k}.e"))
    second, n = F.lit(None).cast("double"), F.lit(0)
    for k in VOTES:
        second, n = F.when(F.col("gate") == k, F.col(f"{k}.second")).otherwise(second), F.when(F.col("gate") == k, F.col(f"{k}.references")).otherwise(n)
    stands = picked.withColumns({"b": source.otherwise(F.col("best")), "second": second, "references": n})
    names = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return stands.select(
        receipt, F.coalesce(F.element_at(names, F.col("gate")), F.lit(REJECTED)).alias("route"), F.col("gate").isNotNull().alias("accepted"), F.when(F.col("gate").isNull(), 0.0).otherwise(confidence(F.col("gate"))).alias("confidence"),
        F.col("b.candidate").alias("candidate"), F.col("b.reference").alias("reference"), "references",
    )
