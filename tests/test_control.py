"""The queue under control: outcomes of events, streams in several micro-batches, admission."""

from datetime import datetime, timedelta

import pytest

from docketry.streaming import control

DDL = "job long, at timestamp, id long, kind string, attempt int, revision int, paused boolean"
START = datetime(2024, 1, 1)


def log(kinds, job=1, step=60):
    """Events a minute apart; a kind may be (kind, attempt, revision, paused)."""
    rows = [k if isinstance(k, tuple) else (k, 1, 1, False) for k in kinds]
    return [(job, START + timedelta(seconds=i * step), i + 1, *r) for i, r in enumerate(rows)]


LIFE = ["submit", "upload", "start", "claim", "progress", "finish"]
CASES = [
    (LIFE, ["ok"] * 6, "succeeded"), (["upload"], ["illegal"], ""), ([*LIFE[:3], ("claim", 1, 1, True), "claim"], ["ok"] * 3 + ["paused", "ok"], "running"), ([*LIFE[:4], ("finish", 2, 1, False)], ["ok"] * 4 + ["stale"], "running"),
    ([*LIFE[:4], "fail", "retry", "claim", ("finish", 1, 1, False), ("finish", 2, 1, False)], ["ok"] * 7 + ["stale", "ok"], "succeeded"), ([*LIFE, "remote"], ["ok"] * 7, "succeeded"), ([*LIFE, "edit", "remote"], ["ok"] * 7 + ["conflict"], "succeeded"),
    ([*LIFE[:4], "remote"], ["ok"] * 4 + ["waiting"], "running"), ([*LIFE[:3], "withdraw", "claim", "start", "prioritize"], ["ok"] * 4 + ["illegal", "ok", "ok"], "queued"), ([*LIFE, "delete", "retry"], ["ok"] * 6 + ["kept", "illegal"], "succeeded"),
    ([*LIFE[:4], "retry", "recover", "remove", "delete"], ["ok"] * 4 + ["kept", "ok", "illegal", "ok"], "removed"), ([*LIFE[:2], "remove", "submit"], ["ok"] * 3 + ["illegal"], "removed"), (["dance"], ["illegal"], ""),
]


@pytest.fixture(scope="module")
def all_cases():
    return [e for job, (kinds, _, _) in enumerate(CASES) for e in log(kinds, job)]


def check(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["job"], r["id"])):
        got.setdefault(r["job"], []).append(r)
    for job, (_, outcomes, last) in enumerate(CASES):
        assert [r["outcome"] for r in got[job]] == outcomes, CASES[job]
        assert got[job][-1]["after"] == last


def test_outcomes_in_a_batch(spark, all_cases):
    rows = control.fold_log(spark.createDataFrame(all_cases, DDL).repartition(3)).collect()
    check(rows)
    priorities = [r["priority"] for r in sorted(rows, key=lambda r: r["id"]) if r["job"] == 8]
    assert priorities == [0, 0, 0, 0, 0, 0, 7]


def micro_batches(spark, folder, batches, ddl=DDL):
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


def test_outcomes_in_a_shuffled_stream_and_forgotten_jobs(spark, tmp_path, all_cases):
    far = [(-1, START + timedelta(days=9), 0, "submit", 1, 0, False)]
    stream = micro_batches(spark, str(tmp_path / "in"), [all_cases[1::3], all_cases[0::3], all_cases[2::3], far, [(-1, START + timedelta(days=10), 1, "upload", 1, 0, False)]])
    rows, folder = control.drain(control.fold_stream(stream, "1 hour", 3600))
    check([r for r in rows.collect() if r["job"] >= 0])
    left = spark.read.format("statestore").option("stateVarName", "job").load(f"{folder}/checkpoint").select("key.job", "value.status").collect()
    assert {r["job"] for r in left} == {-1} | {j for j, (_, _, last) in enumerate(CASES) if last in ("running", "queued", "ready", "awaiting")}


def test_closed_jobs_are_forgotten(spark):
    rows = log([*LIFE, "edit", "submit"], step=3000)
    assert [r["outcome"] for r in sorted(control.fold_log(spark.createDataFrame(rows, DDL), 3000).collect(), key=lambda r: r["id"])][-2:] == ["illegal", "ok"]
    assert [r["outcome"] for r in sorted(control.fold_log(spark.createDataFrame(rows, DDL), 3001).collect(), key=lambda r: r["id"])][-2:] == ["ok", "illegal"]


def test_what_comes_twice_and_late(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [[(1, at(0), "a"), (2, at(1), "a"), (3, at(50), "b")], [(4, at(55), "a"), (5, at(56), "c")], [(6, at(300), "d")], [(7, at(10), "c"), (8, at(290), "e")], [(9, at(301), "a")]]
    stream = micro_batches(spark, str(tmp_path / "in"), batches, "id long, at timestamp, target string")
    rows, _ = control.drain(control.admit_once(stream, ["target"], "at", "1 hour"))
    kept = sorted(tuple(r) for r in rows.select("id", "target").collect())
    assert len(kept) == 6 and [t for _, t in kept] == ["a", "b", "c", "d", "e", "a"] and {i for i, _ in kept} >= {3, 5, 6, 8, 9}  # 4 within the hour is dropped, 9 is a new one
    late, _ = control.late_rows(stream, "at", 3600)
    assert [r["id"] for r in late.collect()] == [7]


def test_requests_are_admitted_as_a_whole(spark):
    requests = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 10), (3, 10), (3, 99), (4, 12), (4, 10), (5, 13), (6, None), (7, 10), (7, 11), (7, 14)], "r long, t long")
    results = spark.createDataFrame([(10, "f"), (11, "f"), (12, ""), (13, "f"), (14, "f")], "t long, source string")
    active = spark.createDataFrame([(13,)], "t long")
    got = {x["r"]: x["refused"] for x in control.admit_batch(requests, results, active, "r", "t", 2).collect()}
    assert got == {1: None, 2: "repeated", 3: "unknown", 4: "no source", 5: "active", 6: "empty", 7: "too many"}


def test_a_batch_of_a_job_sets_one_timer():
    from pyspark.sql import Row

    calls = []

    class Handle:
        def getValueState(self, *a):
            return self

        getListState = getValueState

        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

    fold = control._Fold(3600)
    fold.init(Handle())
    list(fold.handleInputRows((1,), iter([Row(job=1, id=i, t=(9 - i) * 5_000_000, kind="submit", attempt=None, revision=1, paused=None) for i in range(8)]), None))
    assert [c[0] for c in calls] == ["appendList", "registerTimer"]
    assert len(calls[0][1]) == 8 and calls[1][1] == 10_001  # that of the earliest
