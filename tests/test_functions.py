"""Value tables of the expressions."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.constants import MATCH, MISMATCH, PARTIAL, UNDECIDABLE, UNREAD
from docketry.functions import dates, measures, text
from docketry.operators import arbitration, intervals, latest, reconcile
from docketry.operators.decision import strict_status


def value(spark, column, **row):
    ddl = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], ddl).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "normal"), [("A: b，(C)_d-/", "abcd"), ("　全 角　", "全角"), (None, ""), ("", "")])
def test_normalize(spark, raw, normal):
    assert value(spark, text.normalize(F.col("x")), x=raw) == normal


def test_fold_width_is_not_nfkc(spark):
    assert value(spark, text.seal_key(F.col("x")), x="（Ａ１）｜①") == "A1①"


@pytest.mark.parametrize(("code", "ok"), [("4006381333931", True), ("4006381333932", False), ("400638133393", False), ("", False)])
def test_ean13(spark, code, ok):
    assert value(spark, text.ean13_valid(F.col("x")), x=code) is ok


@pytest.mark.parametrize(("name", "want"), [("a_02.jpg", ("a", 2)), ("a_2.jpg", ("a_2", 0)), ("b.png", ("b", 0)), ("c", ("c", 0))])
def test_page_identity(spark, name, want):
    key, page = text.page_identity(F.col("x"))
    assert value(spark, F.struct(key, page), x=name) == want


@pytest.mark.parametrize(("raw", "day"), [("到 2O25-2-3", "2025-02-03"), ("2025年12月31日", "2025-12-31"), ("2025-02-30", None), ("25-01-01", None), (None, None)])
def test_strict_date(spark, raw, day):
    assert value(spark, dates.strict_date(F.col("x")).cast("string"), x=raw) == day


@pytest.mark.parametrize(("required", "actual", "want"), [(None, None, (UNDECIDABLE, None)), ("2025-01-02", None, (UNREAD, None)), ("2025-01-02", "2025-01-02", (MATCH, 0)), ("2025-01-02", "2025-01-05", (MISMATCH, 3)), ("2025-01-02", "2025-01-01", (MISMATCH, -1))])
def test_compare_dates(spark, required, actual, want):
    status, late = dates.compare_dates(F.col("r").cast("date"), F.col("a").cast("date"))
    assert value(spark, F.struct(status, late), r=required, a=actual) == want


@pytest.mark.parametrize(("expected", "actual", "want"), [("", "x", UNDECIDABLE), (None, None, UNDECIDABLE), ("abc", "", UNREAD), ("abc", "abc", MATCH), ("abc", "ac", PARTIAL), ("abc", "ca", MISMATCH), ("aab", "aa", PARTIAL), ("abc", "abcd", MISMATCH)])
def test_strict_status(spark, expected, actual, want):
    assert value(spark, strict_status(F.col("e"), F.col("a")), e=expected, a=actual) == want


def test_safe_ratio_and_guards(spark):
    assert value(spark, measures.safe_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) == 0.0
    assert value(spark, measures.confidence(F.col("a")), a=float("nan")) is None
    assert value(spark, measures.non_negative(F.col("a")), a=float("inf")) is None
    assert value(spark, measures.overlap_over_smaller(*[F.lit(float(x)) for x in (0, 0, 2, 2, 1, 1, 3, 3)]), a=1.0) == 0.25


def test_blank_names_stay_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "id long, name string")
    kept = latest.latest(rows, [latest.identity_key(F.col("name"), F.col("id"))], [F.desc("id")])
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]


def test_rules_of_choice(spark):
    ddl = "k string, pos long, value string, method string, provider string, conf double, low boolean"
    rows = [
        ("one", 1, "x", "a", "p", 0.1, True), ("pref", 1, "x", "a", "p", 0.99, False), ("pref", 2, "y", "b", "q", 0.2, True), ("vote", 1, "x", "a", "p", 0.7, False), ("vote", 2, "x", "b", "p", 0.7, False),
        ("vote", 3, "y", "c", "p", 0.9, False), ("low", 1, "x", "a", "p", 0.7, None), ("low", 2, "y", "b", "p", 0.6, True), ("lead", 1, "x", "a", "p", 0.95, None), ("lead", 2, "y", "b", "p", 0.7, None),
        ("open", 1, "x", "a", "p", 0.7, None), ("open", 2, "y", "b", "p", 0.71, None),
        ("null", 1, None, "a", "p", 0.7, None), ("null", 2, None, "b", "p", 0.7, None), ("nulls", 1, None, "a", "p", 0.9, None), ("nulls", 2, "y", "b", "p", 0.7, None), ("mine", 1, None, "a", "q", 0.1, None), ("mine", 2, "y", "b", "p", 0.9, None),
        ("own", 1, "x", "a", "p", 0.95, None), ("own", 2, "x", "a", "p", None, None), ("own", 3, "y", "b", "p", 0.7, None), ("unknown", 1, "x", "a", "p", 0.95, None), ("unknown", 2, "y", "b", "p", None, None),
        ("empty", 1, "x", "", "p", 0.7, None), ("empty", 2, "x", "m", "p", 0.7, None), ("empty", 3, "y", "c", "p", 0.72, None), ("weak", 1, "x", "a", "p", 0.95, True), ("weak", 2, "y", "b", "p", 0.1, None), ("two", 1, "x", "a", "q", 0.7, None), ("two", 2, "y", "a", "q", 0.9, None),
    ]
    got = {r["k"]: (r["value"], r["rule"], r["disputed"]) for r in arbitration.choose(spark.createDataFrame(rows, ddl), ["k"], "q").collect()}
    assert got == {"one": ("x", "unanimous", False), "pref": ("y", "preferred", False), "vote": ("x", "vote", False), "low": ("x", "others_low", False), "lead": ("x", "confidence", False), "open": ("y", "rank", True),
                   "null": (None, "unanimous", False), "nulls": (None, "confidence", False), "mine": (None, "preferred", False), "own": ("x", "confidence", False), "unknown": ("x", "rank", True), "empty": ("y", "rank", True), "weak": ("x", "rank", True), "two": ("y", "preferred", True)}


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 4), ("a", 5, 6), ("a", 8, 9), ("a", 7, 2), ("a", None, 3)], "k string, start long, end long")
    assert intervals.covered(rows, ["k"]).first().asDict() == {"k": "a", "covered": 7, "envelope": 9, "islands": 2}
    assert [tuple(r) for r in intervals.gaps(rows, ["k"]).collect()] == [("a", 6, 8)]


def test_merge_pages_keeps_orphans(spark):
    ddl = "k string, id long, page long, kind string, status string, footer string, confidence double"
    rows = [("a", 1, 0, "receipt", "通过", "f", 0.9), ("a", 2, 1, "continuation", "通过", "g", 0.5), ("a", 3, 2, "continuation", "不通过", "", 0.8), ("b", 4, 1, "continuation", "通过", "h", 0.7)]
    got = {r["id"]: (r["pages"], r["footer"], r["status"], r["confidence"], r["orphan"]) for r in reconcile.merge_pages(spark.createDataFrame(rows, ddl), ["k"]).collect()}
    assert got == {1: (3, "g", "不通过", 0.5, False), 4: (1, "h", "通过", 0.7, True)}


def test_truth_file_and_overlay(spark, tmp_path):
    from docketry.sources import tables

    (tmp_path / "truth.json").write_text('{"a.jpg": {"n": 1}, "b.jpg": {"n": null}}')
    assert sorted(tuple(r) for r in tables.truth_file(spark, str(tmp_path / "truth.json"), "struct<n:int>").select("name", "entry.n").collect()) == [("a.jpg", 1), ("b.jpg", None)]
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    over = spark.createDataFrame([("a", 9, False), ("b", 0, True), ("c", 3, None)], "k string, v int, gone boolean")
    assert sorted(tuple(r) for r in tables.overlay(base, over, "k", "gone").collect()) == [("a", 9), ("c", 3)]


def test_late_events_do_not_displace(spark, tmp_path):
    from datetime import datetime

    from docketry.streaming import queue

    ddl, at = "job long, id long, at timestamp, type string", [datetime(2024, 1, d) for d in (1, 2, 3)]
    for n, rows in enumerate([[(1, 2, at[2], "purchase")], [(1, 1, at[0], "signup"), (2, 3, at[1], "error")]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = queue.drain(queue.fold_stream(stream), str(tmp_path))
    last = latest.newest_by(rows, ["job"], ["events", "attempts", "last_type"], ["batch"])
    assert sorted(tuple(r) for r in last.collect()) == [(1, 2, 1, "purchase"), (2, 1, 0, "error")]


REQUIRED = "2016-09-05"


@pytest.mark.parametrize(
    ("raw", "day"),
    [
        ("2016-9-16", "2016-09-16"), ("2017-9-16", None), ("20168月16日", "2016-08-16"), ("8月16日", "2016-08-16"), ("月16日", "2016-09-16"),
        ("1105年2月23日", None), ("21127年9月5日", None), ("8月16曰", "2016-08-16"), ("8月T", None), ("2016年8月16", "2016-08-16"), ("8月32日", None),
        ("2019月16日", "2016-09-16"), ("2011月16日", None), ("2O16年8月1 6日", "2016-08-01"), ("2O16 年8月1 6日", "2016-08-16"), ("16日", None), ("", None), (None, None),
    ],
)
def test_receipt_date(spark, raw, day):
    assert value(spark, dates.receipt_date(F.col("x"), F.lit(REQUIRED).cast("date")).cast("string"), x=raw) == day


def test_receipt_date_without_requirement(spark):
    none = F.lit(None).cast("date")
    assert value(spark, dates.receipt_date(F.col("x"), none).cast("string"), x="20258月16日") == "2025-08-16"
    assert value(spark, dates.receipt_date(F.col("x"), none).cast("string"), x="8月16日") is None


@pytest.mark.parametrize(("raw", "out"), [("2025年3月4日", "2025-03-04"), ("2025-02-30", "2025-02-30"), ("about 2025-3-4", "about 2025-3-4"), (None, None)])
def test_loose_date(spark, raw, out):
    assert value(spark, dates.loose_date(F.col("x")), x=raw) == out


@pytest.mark.parametrize(("a", "b", "ok"), [("1 .50", "1.5", True), ("1", "2", False), ("x", "x", False), (None, None, False)])
def test_same_decimal(spark, a, b, ok):
    assert value(spark, text.same_decimal(F.col("a"), F.col("b")), a=a, b=b) is ok


def test_two_nearest_of_few(spark):
    from docketry.operators import vectors

    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "a", [0.0, 1.0]), (4, "b", [1.0, 0.0]), (5, "b", [1.0, 0.0])], "id long, k string, v array<double>")
    rows = {r["id"]: r for r in vectors.two_nearest(v, v, "id", "k", "v", 0.9).collect()}
    assert (rows[1]["nearest"], rows[1]["second"], rows[1]["accepted"]) == (2, 3, True)
    assert (rows[4]["nearest"], rows[4]["second"], rows[4]["accepted"]) == (5, None, False)  # no second one


def test_dates_without_a_label_are_never_right(spark):
    from docketry.operators import evaluation

    rows = [("a", True, None, "2025-01-01", None), ("b", True, "", "2025-01-01", None), ("c", True, "2025-01-01", "2025-01-01", "2025-01-01"), ("d", None, None, None, "")]
    joined = spark.createDataFrame([(*r, True, "", False) for r in rows], "k string, present boolean, day string, required string, actual string, tested boolean, status string, reliable boolean")
    assert {r["k"]: r["accuracy"] for r in evaluation.date_metrics(joined, ["k"]).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 0.0}


def test_greedy_pairs(spark):
    import random

    from docketry.operators import pairing

    r = random.Random(4)
    edges = [(a, b, r.randrange(3)) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.1] + [(100 + i, 101 + i, 40 - i) for i in range(12)] + [(200, 200, 1), (3, 1, 0), (1, 3, 0), (None, 5, 0)]
    want, used = [], set()
    for a, b, w in sorted((e for e in edges if None not in e), key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
        if a != b and not {a, b} & used:
            used |= {a, b}
            want.append((min(a, b), max(a, b), w))
    got = pairing.greedy_pairs(spark.createDataFrame(edges, "a int, b int, w int"), "a", "b", ["w"]).collect()
    assert sorted({(min(x["a"], x["b"]), max(x["a"], x["b"]), x["w"]) for x in got}) == sorted(want)
    assert pairing.greedy_pairs(spark.createDataFrame([], "a int, b int, w int"), "a", "b", ["w"]).count() == 0


def test_fingerprint_has_every_row(spark):
    import hashlib

    from docketry.operators import matching

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, 3, "O"), (1, 2, None), (1, 3, "O"), (2, 2, "F")]
    want = {k: digest("".join(sorted(digest(f"{n}\x01" + ("\0" if t is None else t)) for i, n, t in rows if i == k))) for k in (1, 2)}
    frame = spark.createDataFrame(rows, "k int, n int, t string").repartition(3)
    assert {r["k"]: (r["n"], r["digest"]) for r in matching.fingerprint(frame, "k", ["n", "t"]).collect()} == {1: (3, want[1]), 2: (1, want[2])}


def test_signature_modes_read_the_lines_once(spark, sf_dir):
    from docketry.plans import review

    plan = review.signature_modes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") > 0 and plan.count("Relation [l_orderkey") == 1


def test_slope_needs_more_than_one_value(spark):
    """29 / 7 * 7 isn't 29 in doubles, so merged means of equal values differ from them."""
    rows = [("one", float(i * i), 29.0) for i in range(28)] + [("two", 2.0 * i, float(i)) for i in range(28)] + [("null", None, 1.0), ("null", 1.0, 2.0), ("null", 2.0, 2.0)]
    frame = spark.createDataFrame(rows, "k string, y double, x double")
    # Seven rows of each key in a partition.
    dealt = frame.rdd.zipWithIndex().map(lambda r: (r[1] // 7 % 4, r[0])).partitionBy(4, int).values().toDF(frame.schema)
    got = {r["k"]: r["s"] for r in dealt.groupBy("k").agg(measures.slope(F.col("y"), F.col("x")).alias("s")).collect()}
    assert got["one"] is None and got["null"] is None and abs(got["two"] - 2) < 1e-12


def test_greedy_pairs_within_groups(spark):
    import random

    from docketry.operators import pairing

    r = random.Random(5)
    edges = [(g, a, b, r.randrange(3), a * b) for g in range(40) for a in range(8) for b in range(a + 1, 8) if r.random() < 0.4] + [(1, 2, 2, 0, 0), (None, 1, 2, 0, 0), (2, None, 3, 0, 0)]
    want, used = set(), set()
    for g, a, b, w, n in sorted((e for e in edges if None not in e[:3] and e[1] != e[2]), key=lambda e: (e[0], e[3], e[1], e[2])):
        if not {(g, a), (g, b)} & used:
            used |= {(g, a), (g, b)}
            want.add((g, a, b, n))
    frame = spark.createDataFrame(edges, "g int, a int, b int, w int, n int")
    assert {tuple(x) for x in pairing.greedy_pairs_within(frame, "g", "a", "b", ["w"], ["n"]).collect()} == want


def test_slopes_on_a_rounding_edge(spark, tmp_path):
    """An order's exact slope is half a unit of the sixth decimal: it's rounded away from zero, however its rows are dealt."""
    from decimal import ROUND_HALF_UP, Decimal

    from docketry.plans import analytics

    half = lambda v, places: float(Decimal(repr(v)).quantize(Decimal(places), ROUND_HALF_UP))
    rng, rows, want = random.Random(1), [], {}
    while len(want) < 300:
        x = rng.sample(range(1, 51), 5)
        cents = rng.choice([-1, 1]) * (4950 + 10000 * rng.randrange(15))
        y, (i, j, k), m = [5_000_000 + cents * (v - 25) for v in x], rng.sample(range(5), 3), rng.randrange(-30000, 30000)
        # What is added has no slope of its own.
        for at, by in ((i, x[j] - x[k]), (j, x[k] - x[i]), (k, x[i] - x[j])):
            y[at] += m * by
        key = len(want)
        rows += [(key, float(a), b / 100) for a, b in zip(x, y)]
        want[key] = int(half(half(cents / 100 / 1e6, "0.000001") * 1e4, "1"))
    for n, parts in enumerate((1, 7)):
        rng.shuffle(rows)
        spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double").repartition(parts).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        assert {r["l_orderkey"]: r["slope_e4"] for r in analytics.skew_slope(spark, f"{tmp_path}/{n}").collect()} == want


@pytest.mark.parametrize(("rows", "want"), [
    ([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (7.0, None)], 0.5), ([(1.0, 2.0), (5.0, 2.0)], None), ([(None, 1.0)], None), ([(1.005, 1.0), (1.015, 2.0)], 0.01), ([(3e12, 1.0), (5e12, 2.0)], 2e12), ([(0.1, 0.3), (0.2, 0.1)], -0.5), ([(float("inf"), 1.0), (2.0, 1.0)], None),
])
def test_slope_of_cents(spark, rows, want):
    got = spark.createDataFrame(rows, "y double, x double").agg(measures.slope_of_cents(F.col("y"), F.col("x")).alias("s")).first()["s"]
    assert got == want if want is None else abs(got - want) <= 1e-9 * abs(want)
