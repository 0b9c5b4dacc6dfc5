"""Replays of saved checks: what is compared again, what stays, and that a second replay finds nothing to do."""

from pyspark.sql import functions as F

from docketry.constants import MATCH, MISMATCH, PARTIAL, UNREAD
from docketry.operators import replay

SAVED = "k string, status string, reading string, revision string, human boolean, busy boolean"


def test_only_what_changed_is_compared_again(spark):
    requirements = spark.createDataFrame([(k, "（甲乙）丙") for k in ("match", "part", "none", "human", "busy", "off", "tie")], "k string, requirement string")
    readings = spark.createDataFrame(
        [("match", 2, "甲乙丙", True), ("match", 1, "甲丙", True), ("part", 1, "丁", True), ("part", 2, "甲 丙", True), ("human", 1, "丁", True), ("busy", 1, "丁", True), ("off", 1, "甲乙丙", False), ("off", 2, None, True), ("gone", 1, "甲乙丙", True), ("tie", 2, "戊", True), ("tie", 1, "己", True)],
        "k string, pos int, text string, active boolean",
    )
    keys = ("match", "part", "none", "human", "busy", "off", "gone", "tie")
    saved = spark.createDataFrame([(k, "old", "old", "", k == "human", k == "busy") for k in keys], SAVED)
    plan = replay.planned(saved, requirements, readings, "k")
    assert {r["k"] for r in plan.filter("state = 'changed'").collect()} == {"match", "part", "none", "off", "tie"}
    done = replay.replay(plan, "k")
    got = {r["k"]: (r["status"], r["reading"], r["outcome"]) for r in done.collect()}
    assert got == {
        "match": (MATCH, "甲乙丙", "updated"), "part": (PARTIAL, "甲 丙", "updated"), "none": (UNREAD, None, "updated"), "human": ("old", "old", "human"), "busy": ("old", "old", "busy"), "off": (UNREAD, "", "updated"), "gone": ("old", "old", "gone"), "tie": (MISMATCH, "己", "updated"),
    }
    assert {r["outcome"]: r["n"] for r in replay.dry_run(plan, "k").collect()} == {"updated": 5, "human": 1, "busy": 1, "gone": 1}
    again = done.select("k", "status", "reading", "revision", (F.col("k") == "human").alias("human"), (F.col("k") == "busy").alias("busy"))
    states = {r["k"]: r["state"] for r in replay.planned(again, requirements, readings, "k").collect()}
    assert states == dict.fromkeys(("match", "part", "none", "off", "tie"), "same") | {"human": "human", "busy": "busy", "gone": "gone"}
    # Another way to write the same requirement changes nothing, another requirement only its own record.
    other = requirements.withColumn("requirement", F.when(F.col("k") == "tie", "己").otherwise("甲乙丙"))
    assert [r["k"] for r in replay.planned(again, other, readings, "k").filter("state = 'changed'").collect()] == ["tie"]
    scope = spark.createDataFrame([("match",)], "k string")
    assert [r["k"] for r in replay.replay(replay.planned(saved, requirements, readings, "k", scope), "k").collect()] == ["match"]


def test_the_comparison_reads_changed_records_only(spark):
    """A reading that the comparison can't take harms nobody while its record is unchanged."""
    requirements = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, requirement string")
    readings = spark.createDataFrame([("a", 1, "x", True), ("b", 1, "x", True)], "k string, pos int, text string, active boolean")
    saved = spark.createDataFrame([("a", "", "", "", False, False), ("b", "", "", "", False, False)], SAVED)
    first = replay.replay(replay.planned(saved, requirements, readings, "k"), "k").select("k", "status", "reading", "revision", F.lit(False).alias("human"), F.lit(False).alias("busy"))
    plan = replay.planned(first, requirements.withColumn("requirement", F.when(F.col("k") == "a", "y").otherwise("x")), readings, "k")
    poisoned = plan.withColumn("readings", F.when(F.col("state") == "changed", F.col("readings")).otherwise(F.raise_error(F.lit("read")).cast("array<struct<pos: bigint, text: string>>")))
    assert {r["k"]: r["outcome"] for r in replay.replay(poisoned, "k").collect()} == {"a": "updated", "b": "same"}
