"""Boxes and similarities against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docketry.functions import similarity
from docketry.operators import boxes

DDL = "page long, text string, x double, y double, width double, height double, confidence double"


def box(page, text, x, y, conf=0.9, w=0.1, h=0.01):
    return (page, text, x, y, w, h, conf)


def test_lines_follow_a_running_mean(spark):
    rows = [box(1, "a", 0.1, 0.100), box(1, "b", 0.2, 0.106), box(1, "c", 0.3, 0.1105), box(1, "d", 0.1, 0.2), box(2, "e", 0.1, 0.2)]
    got = {r["text"]: r["line"] for r in boxes.lines(spark.createDataFrame(rows, DDL), "page").collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 0}


def test_table_rows_need_numbers_and_cells(spark):
    edges = [("no", 0.0), ("item", 0.2), ("qty", 0.6)]
    rows = [box(1, "1", 0.0, 0.1), box(1, "AB", 0.2, 0.1, 0.5), box(1, "C", 0.31, 0.1), box(1, "7", 0.6, 0.1), box(1, "2", 0.0, 0.2), box(1, "X", 0.2, 0.2), box(1, "12345", 0.0, 0.3), box(1, "Y", 0.2, 0.3), box(1, "9", 0.6, 0.3)]
    got = boxes.table_rows(spark.createDataFrame(rows, DDL), "page", edges, "no").select("no", "item", "qty", "confidence").collect()
    assert [tuple(r) for r in got] == [("1", "ABC", "7", 0.5)]


def test_labels_take_inline_text_before_neighbours(spark):
    rows = [box(1, "Name: Ann", 0.1, 0.1), box(1, "Bob", 0.3, 0.1), box(1, "Date", 0.1, 0.2), box(1, "far", 0.8, 0.2), box(1, "near", 0.3, 0.201), box(1, "Code:", 0.1, 0.4)]
    got = {r["field"]: r["value"] for r in boxes.right_of_labels(spark.createDataFrame(rows, DDL), "page", {"name": ["Name"], "date": ["Date"], "code": ["Code"], "none": ["None"]}).collect()}
    assert got == {"name": "Ann", "date": "near", "code": ""}


def test_page_types(spark):
    rows = [box(1, "receipt no", 0.0, 0.0), box(1, "total", 0.0, 0.1), box(2, "receipt", 0.0, 0.0), box(3, "receipt total page next", 0.0, 0.0)]
    got = {r["page"]: r["type"] for r in boxes.page_type(spark.createDataFrame(rows, DDL), "page", {"a": ["receipt", "total"], "b": ["page", "next"]}).collect()}
    assert got == {1: "a", 2: "unknown", 3: "unknown"}


def test_overlaps_keep_the_best(spark):
    rows = [box(1, "a", 0.1, 0.1, 0.9, 0.2, 0.2), box(1, "b", 0.12, 0.1, 0.8, 0.2, 0.2), box(1, "c", 0.5, 0.5, 0.1, 0.2, 0.2), box(2, "d", 0.1, 0.1, 0.2, 0.2, 0.2)]
    assert sorted(r["text"] for r in boxes.suppress_overlaps(spark.createDataFrame(rows, DDL), "page").collect()) == ["a", "c", "d"]


def test_band_pairs_match_all_pairs(spark):
    r = random.Random(4)
    rows = [box(r.randrange(3), f"t{i}", 0.0, r.random()) for i in range(120)]
    df = spark.createDataFrame(rows, DDL)
    got = sorted((p, a, b) for p, a, b, _ in boxes.band_pairs(df, df, "page", 0.05).collect())
    centre = lambda b: b[3] + b[5] / 2
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and abs(centre(a) - centre(b)) <= 0.05)


def test_skew_is_clamped(spark):
    rows = [box(1, "h", 0.1 * i, 0.1 + 0.002 * i) for i in range(4)] + [box(2, "h", 0.1 * i, 0.1 + 0.05 * i) for i in range(4)] + [box(3, "h", 0.1, 0.1)]
    got = {r["page"]: round(r["slope"], 6) for r in boxes.skew(spark.createDataFrame(rows, DDL), "page", F.col("text") == "h").collect()}
    assert got == {1: 0.02, 2: 0.05, 3: 0.0}


@pytest.mark.parametrize("seed", range(5))
def test_lcs_and_ratios(seed):
    r = random.Random(seed)
    for _ in range(200):
        a, b = ("".join(r.choices("abcd", k=r.randrange(12))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs_length(a, b) == table[-1][-1]
        assert similarity.common_run(a, b) == max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        assert similarity.partial_ratio(a, b) >= (similarity.ratio(a, b) if len(a) == len(b) > 0 else 0)


def test_similarity_columns(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "x")], "a string, b string")
    got = df.select(similarity.sequence_ratio("a", "b").alias("r"), similarity.lcs_coverage("a", "b").alias("c"), similarity.longest_common_run("a", "b").alias("n"), similarity.windowed_ratio("a", "b").alias("w")).collect()
    assert got[0]["r"] == SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio()
    assert (got[0]["c"], got[0]["n"]) == (0.75, 3)
    assert got[1]["r"] is None
    assert (got[2]["c"], got[2]["w"]) == (0.0, 0.0)


def test_boxes_of_no_page_are_one_page(spark):
    """Keys reach the passes as they are: a null among numbers isn't NaN, and large keys stay apart."""
    rows = [(p, t, 0.1, y, 0.1, 0.01, c) for p in (None, 2**60, 2**60 + 1) for t, y, c in (("a", 0.1, 0.9), ("b", 0.5, 0.8), ("c", 0.501, 0.7))]
    frame = spark.createDataFrame(rows, DDL)
    lines = {(r["page"], r["text"]): r["line"] for r in boxes.lines(frame, "page").collect()}
    kept = {(r["page"], r["text"]) for r in boxes.suppress_overlaps(frame, "page").collect()}
    assert lines == {(p, t): n for p in (None, 2**60, 2**60 + 1) for t, n in (("a", 0), ("b", 1), ("c", 1))}
    assert kept == {(p, t) for p in (None, 2**60, 2**60 + 1) for t in "ab"}


def test_lines_of_pages_are_those_of_lines(spark):
    rng = random.Random(3)
    pages = [rng.choice([1, 2, 3, None]) for _ in range(200)]
    # A box without a place comes first and keeps its page's line open.
    rows = [(p, f"{i}", rng.random(), rng.choice([rng.random() / 3, 0.2, *[None] * (p == 3)]), 0.1, rng.choice([0.01, 0.03, *[None] * (p == 3)]), 0.5) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, DDL)
    want = {(r["page"], r["text"]): r["line"] for r in boxes.lines(frame, "page").collect()}
    got = {(r["page"], b["text"]): r["line"] for r in boxes.lines_of_pages(frame, "page").collect() for b in r["boxes"]}
    assert got == want and max(got.values()) > 5
