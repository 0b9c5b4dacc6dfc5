"""Saved checks brought up to date after requirements changed, without reading any image again.

Each saved check carries the revision of what it was made from: a digest of
the requirement and of the stamps' readings.  Only records whose revision has
changed are compared again, each stamp on its own; what a person decided stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seal_key
from .decision import strict_status
from .matching import status_rank


def revision(requirement: Column, readings: Column) -> Column:
    """Digest of the requirement's key and of all readings (pos, text) in order."""
    return F.sha2(F.concat_ws("\u0001", seal_key(requirement), F.to_json(F.array_sort(readings))), 256)


def planned(saved: DataFrame, requirements: DataFrame, readings: DataFrame, key: str, scope: DataFrame | None = None) -> DataFrame:
    """What a replay would do with each saved check: state is same, changed, human, busy or gone (REC-14).

    ``saved`` has the key, status, reading, revision, human and busy;
    ``requirements`` the key and requirement; ``readings`` the key, pos, text
    and active.  A check without a requirement any more is gone, one that a
    person decided or that a job works on is left alone.  ``scope`` limits the
    replay to its keys (MCH-42).  Readings that aren't active don't count.
    """
    own = F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))
    read = readings.filter(F.coalesce("active", F.lit(False))).groupBy(key).agg(own.alias("readings"))
    asked = saved if scope is None else saved.join(scope.select(key).distinct(), key, "left_semi")
    joined = asked.join(requirements.select(key, "requirement").withColumn("__known", F.lit(True)), key, "left").join(read, key, "left")
    none = F.array().cast("array<struct<pos: bigint, text: string>>")
    now = joined.withColumn("readings", F.transform(F.coalesce("readings", none), lambda x: F.struct(x["pos"].cast("bigint").alias("pos"), x["text"].alias("text"))))
    now = now.withColumn("now", revision(F.col("requirement"), F.col("readings")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(~yes("__known"), "gone").when(F.col("revision").eqNullSafe(F.col("now")), "same").when(yes("human"), "human").when(yes("busy"), "busy").otherwise("changed")
    return now.withColumn("state", state).drop("__known")


def recompare(changed: DataFrame, key: str) -> DataFrame:
    """The best comparison of each record's stamps with its requirement, every stamp on its own (MCH-41, MCH-43): status and reading.

    Ties go to the first stamp; a record without readings is unread.
    """
    need = seal_key(F.col("requirement"))
    judged = F.transform("readings", lambda x: F.struct(strict_status(F.col("__need"), seal_key(x["text"])).alias("status"), x["pos"].alias("pos"), x["text"].alias("text")))
    each = changed.withColumn("__need", need).withColumn("__judged", judged)
    ranked = F.array_sort(F.transform("__judged", lambda j: F.struct((-status_rank(j["status"])).alias("r"), j["pos"].alias("pos"), j["status"].alias("status"), j["text"].alias("text"))))
    best = F.get(ranked, F.lit(0))
    return each.select(key, "now", F.coalesce(best["status"], strict_status(F.col("__need"), F.lit(""))).alias("new_status"), best["text"].alias("new_reading"))


def replay(plan: DataFrame, key: str) -> DataFrame:
    """All planned records: status, reading and revision after the replay, and outcome (updated, confirmed, or the state).

    Only records that have changed go through the comparison.
    """
    done = recompare(plan.filter("state = 'changed'"), key)
    joined = plan.drop("now").join(done, key, "left")
    redone = F.col("state") == "changed"
    outcome = F.when(redone, F.when(F.col("new_status").eqNullSafe(F.col("status")) & F.col("new_reading").eqNullSafe(F.col("reading")), "confirmed").otherwise("updated")).otherwise(F.col("state"))
    pick = lambda new, old: F.when(redone, F.col(new)).otherwise(F.col(old))
    return joined.select(key, pick("new_status", "status").alias("status"), pick("new_reading", "reading").alias("reading"), pick("now", "revision").alias("revision"), outcome.alias("outcome"))


def dry_run(plan: DataFrame, key: str) -> DataFrame:
    """How many records a replay would leave with each outcome, without writing any."""
    return replay(plan, key).groupBy("outcome").agg(F.count("*").alias("n"))
