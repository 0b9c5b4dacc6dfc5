"""Records of any depth against plain Python: merge patch, difference, rewriting and searching."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import trees


def merged(target, patch):
    if not isinstance(patch, dict):
        return patch
    target = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = merged(target.get(k), v)
    return target


def nulls_inside(x):
    return isinstance(x, dict) and any(v is None or nulls_inside(v) for v in x.values())


def tree(r, deep):
    kind = r.random()
    if deep == 0 or kind < 0.35:
        return r.choice([1, -2.5, "text", 'q"\\\n é', "", True, False, None, [], [1, None, {"x": []}], {}, "{[", 12345678901])
    if kind < 0.85:
        return {r.choice(["a", "b", "c", "d.e", "f[0]", ""]): tree(r, deep - 1) for _ in range(r.randrange(0, 4))}
    return [tree(r, deep - 1) for _ in range(r.randrange(0, 12))]


def change(r, x):
    if not isinstance(x, dict) or r.random() < 0.15:
        return tree(r, 3)
    out = {k: (change(r, v) if r.random() < 0.5 else v) for k, v in x.items() if r.random() < 0.8}
    return out | ({r.choice("abz"): tree(r, 2)} if r.random() < 0.4 else {})


RFC = [
    ({"a": "b"}, {"a": "c"}), ({"a": "b"}, {"b": "c"}), ({"a": "b"}, {"a": None}), ({"a": "b", "b": "c"}, {"a": None}), ({"a": ["b"]}, {"a": "c"}), ({"a": "c"}, {"a": ["b"]}), ({"a": {"b": "c"}}, {"a": {"b": "d", "c": None}}),
    ({"a": [{"b": "c"}]}, {"a": [1]}), (["a", "b"], ["c", "d"]), ({"a": "b"}, ["c"]), ({"a": "foo"}, None), ({"a": "foo"}, "bar"), ({"e": None}, {"a": 1}), ([1, 2], {"a": "b", "c": None}), ({}, {"a": {"bb": {"ccc": None}}}),
    ({"a": 5}, {"a": {"b": {"c": None}}}), ({"a": {}}, {"a": {"b": None}}), ({"a": {"b": 1}}, {"a": {}}), ({"a": 1}, {}), ({"a": {"b": 1}}, {"a": {"b": None}}), (3, {}), ({"a": {"b": 1}}, {"a": {"b": {}}}),
]


def test_merge_patch(spark):
    r = random.Random(1)
    pairs = RFC + [(t := tree(r, 4), change(r, t)) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(t), json.dumps(p)) for i, (t, p) in enumerate(pairs)], "id int, t string, p string")
    got = {x["id"]: json.loads(x["merged"]) for x in trees.merge_patch(rows, ["id"], "t", "p").collect()}
    for i, (t, p) in enumerate(pairs):
        assert got[i] == merged(t, p), (t, p)


def nested_objects(x, n):
    for i in range(n):
        x = {"k": x, "n": i}
    return x


@pytest.mark.parametrize("levels", [8, 1, 0])
def test_patches_are_merged_within_their_rows(spark, monkeypatch, levels):
    """Nothing is shuffled or taken apart, a repeated key is a row of its own; deeper patches give the same by their leaves."""
    monkeypatch.setattr(trees, "IN_ROW", levels)
    pairs = [({"a": {"b": 1, "c": [{"x": None}]}, "k": 1.50}, {"a": {"b": None}, "z": {"y": {"x": None}}}), ({"a": 1}, {"a": 2}), ({"a": 1}, {"b": {"c": {"d": {}}}}), (nested_objects({"z": 1}, 12), nested_objects({"y": 2, "n": None}, 12))]
    rows = spark.createDataFrame([(i, json.dumps(t), json.dumps(p)) for i, (t, p) in enumerate(pairs)], "id int, t string, p string")
    got = {x["id"]: x["merged"] for x in trees.merge_patch(rows, ["id"], "t", "p").collect()}
    assert {i: json.loads(x) for i, x in got.items()} == {i: merged(t, p) for i, (t, p) in enumerate(pairs)}
    assert got[0] == '{"a":{"c":[{"x":null}]},"k":1.5,"z":{"y":{}}}'
    if levels == 8:
        flat = trees.merge_patch(rows.filter("id < 3").unionByName(rows.filter("id = 1")), ["id"], "t", "p")
        assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
        assert sorted((x["id"], x["merged"]) for x in flat.collect()) == [(0, got[0]), (1, got[1]), (1, got[1]), (2, got[2])]


def test_difference_brings_back_the_new_record(spark):
    r = random.Random(2)
    pairs = [(t, merged(t, p)) for t, p in RFC] + [(t := tree(r, 4), change(r, t)) for _ in range(150)] + [({"a": {"b": 1, "c": {"d": 2, "e": 3}}, "k": 1}, {"a": {"b": 1}, "k": 1})]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    patches = {x["id"]: (json.loads(x["patch"]), x["exact"]) for x in trees.merge_diff(rows, ["id"], "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        patch, exact = patches[i]
        if exact:
            assert merged(a, patch) == b, (a, b, patch)
        else:
            assert nulls_inside(b)
        assert not (a == b and isinstance(a, dict)) or patch == {}
    assert patches[len(pairs) - 1][0] == {"a": {"c": None}}
    assert sum(e for _, e in patches.values()) > 100


@pytest.mark.parametrize("levels", [8, 1, 0])
def test_differences_are_found_within_their_rows(spark, monkeypatch, levels):
    """Nothing is shuffled or taken apart; deeper records give the same by their leaves."""
    r = random.Random(3)
    pairs = [(x := tree(r, 4), change(r, x)) for _ in range(60)] + RFC + [(3, 3), ({"a": 5}, {"a": {"b": None}}), ({"a": 5}, {"a": {}}), ({"a": {"x": 1}}, {"a": {"b": None}}), ({"a": None}, {"a": None}), (nested_objects({"z": 1}, 12), nested_objects({"y": 2}, 12))]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(-1, None, None), (-2, '{"a":1}', "no json"), (-3, "no json", '{"b":{}}')], "id int, a string, b string")
    want = {x["id"]: (x["patch"], x["exact"]) for x in trees._diff_leaves(rows, ["id"], "a", "b", "patch").collect()}
    monkeypatch.setattr(trees, "IN_ROW", levels)
    assert {x["id"]: (x["patch"], x["exact"]) for x in trees.merge_diff(rows, ["id"], "a", "b").collect()} == want
    assert want[-2] == ('{"a":null}', True) and -1 not in want and False in {e for _, e in want.values()}
    if levels == 8:
        flat = trees.merge_diff(rows.filter(f"id < {len(pairs) - 1}").unionByName(rows.filter("id = -3")), ["id"], "a", "b")
        assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
        assert [x["patch"] for x in flat.filter("id = -3").collect()] == ['{"b":{}}'] * 2


def test_missing_and_broken_records(spark):
    rows = spark.createDataFrame([(1, None, '{"a":1}'), (2, '{"a":1}', None), (3, "no json", '{"b":{}}'), (4, None, None)], "id int, t string, p string")
    assert {x["id"]: x["merged"] for x in trees.merge_patch(rows, ["id"], "t", "p").collect()} == {1: '{"a":1}', 2: '{"a":1}', 3: '{"b":{}}'}


def nest(x, n):
    for i in range(n):
        x = {"k": [0, x]} if i % 2 else {f"m{i}": x}
    return x


@pytest.mark.parametrize("deep", range(1, 7))
def test_strings_are_rewritten_at_any_depth(spark, deep):
    record = nest({"url": "/old/a.png?v=1", "other": "/old/b.png", "n": 1, "again": ["/old/a.png", None]}, deep)
    want = nest({"url": "/new/a.png?v=1", "other": "/old/b.png", "n": 1, "again": ["/new/a.png", None]}, deep)
    rows = spark.createDataFrame([(1, json.dumps(record))], "id int, payload string")
    names = spark.createDataFrame([("/old/a.png", "/new/a.png")], "old string, new string")
    assert json.loads(trees.rewrite_strings(rows, ["id"], "payload", names).first()["payload"]) == want


def inside(x, n):
    for i in range(n):
        x = {"recognition_variants": {"stage": [{"method": "m"}, {"details" if i % 2 else "result": x}]}}
    return x


HUMAN = [
    ({"review_status": "确认通过"}, True), ({"review_status": "待复核"}, False), ({"human_note": "x"}, True), ({"human_note": ""}, False), ({"page_review_override": {"a": 1}}, True), ({"page_review_override": {}}, False),
    ({"date_check": {"source": "人工修改"}}, True), ({"date_check": {"source": "ocr"}}, False), ({"seal_check": {"human_confirmed": True}}, True), ({"seal_check": {"human_confirmed": False}}, False),
    ({"signature_check": {"human_confirmed_match": False}}, True), ({"field_metadata": {"客户": {"backend": "人工"}}}, True), ({"fields": {"source": "人工"}}, False), ({"product_table": {"rows": [{"sources": {"数量": "人工"}}]}}, True), ({}, False),
]


@pytest.mark.parametrize("deep", [0, 1, 3])
def test_human_edits_are_found_at_any_depth(spark, deep):
    rows = spark.createDataFrame([(i, json.dumps(inside(x, deep))) for i, (x, _) in enumerate(HUMAN)], "id int, payload string")
    assert {x["id"]: x["edited"] for x in trees.has_human_edits(rows, ["id"], "payload").collect()} == {i: want for i, (_, want) in enumerate(HUMAN)}


def test_numbers_of_elements_sort_as_numbers(spark):
    rows = spark.createDataFrame([(1, json.dumps({"a": list(range(25))}))], "id int, payload string")
    assert json.loads(trees.assemble(trees.leaves(rows, ["id"], "payload"), ["id"]).first()["payload"]) == {"a": list(range(25))}
    assert rows.select(trees.depth(F.lit('{"a":"{{[","b":[{}]}')).alias("d")).first()["d"] == 3
