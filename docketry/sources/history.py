"""Reviewed writes with history: every write makes a version, or is refused, and any time can be asked for.

A record has a current value and a baseline, the machine's first reading, that
reviews never change.  Writes are folded in order, so a write is judged by the
versions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seal_key

# Statuses that a review may set.
REVIEW_STATUSES = ("待复核", "确认通过", "确认不通过")
PENDING = REVIEW_STATUSES[0]
#: What leaves a before and after image in the audit, and what counts as a change of its own time.
AUDITED = ("rerun", "review", "remote", "repair")
_STATE = "version int, payload string, baseline string, review_status string, final_result string, note string, error_type string, attempt int, updated timestamp"


def versions(writes: DataFrame, record: str) -> DataFrame:
    """Every write of each record with its outcome and the record after it (SNK-01, SNK-03, SNK-04, SNK-05).

    ``writes`` has the record, at (a timestamp), seq (unique), action, payload,
    review_status, final_result, note, error_type, original and based_on.

    * ``create`` makes version 1, whose payload is the baseline.
    * ``rerun`` is a new machine reading: attempt + 1, the error is cleared.
    * ``review`` sets payload, review, result, note and error; the baseline stays.
    * ``remote`` sets payload, review and result, and the baseline as well; the note stays, the error is cleared.
    * ``restore`` brings back saved values without audit, attempt or time.
    * ``repair`` is audited and keeps note and error; its ``original``, if any, becomes the baseline.
    * ``delete`` ends the record.

    Refused are writes to a record that is not there (``missing``), or is
    already (``exists``), or has another version than ``based_on`` says
    (``stale``; null: not asked), and reviews with a status that there isn't
    (``status``).  ``before`` is the payload that a write found, ``valid_to``
    the time of the next version.  A group is one record's writes.
    """
    held = F.array_sort(F.collect_list(F.struct("at", "seq", "action", "payload", "review_status", "final_result", "note", "error_type", "original", "based_on")))
    nothing = F.lit(None).cast(f"struct<{_STATE.replace(' ', ':').replace(',:', ',')}>")
    row = f"struct<seq:bigint,at:timestamp,action:string,outcome:string,before:string,now:struct<{_STATE.replace(' ', ':').replace(',:', ',')}>>"

    def step(s: Column, w: Column) -> Column:
        return F.element_at(F.transform(F.array(_outcome(s["now"], w)), lambda o: _write(s, w, o)), 1)

    def _write(s: Column, w: Column, o: Column) -> Column:
        now = F.when(o != "ok", s["now"]).when(w["action"] == "delete", nothing).otherwise(_after(s["now"], w))
        made = F.struct(w["seq"].cast("bigint").alias("seq"), w["at"].alias("at"), w["action"].alias("action"), o.alias("outcome"), s["now"]["payload"].alias("before"), now.alias("now"))
        return F.struct(now.alias("now"), F.concat(s["log"], F.array(made)).alias("log"))

    start = F.struct(nothing.alias("now"), F.array().cast(f"array<{row}>").alias("log"))
    folded = writes.groupBy(record).agg(held.alias("held")).select(record, F.explode(F.aggregate("held", start, step, lambda s: s["log"])).alias("r")).select(record, "r.*")
    following = F.lead("at").over(Window.partitionBy(record, F.col("outcome") == "ok").orderBy("at", "seq"))
    return folded.withColumn("valid_to", F.when(F.col("outcome") == "ok", following)).select(
        record, "seq", "at", "action", "outcome", "before", "now.*", ((F.col("outcome") == "ok") & F.col("action").isin(*AUDITED)).alias("audited"), "valid_to"
    )


def _outcome(now: Column, w: Column) -> Column:
    create, review = w["action"] == "create", w["action"] == "review"
    return (
        F.when(create & now.isNotNull(), "exists").when(~create & now.isNull(), "missing").when(w["based_on"].isNotNull() & (w["based_on"] != F.coalesce(now["version"], F.lit(0))), "stale")
        .when(review & ~F.coalesce(w["review_status"].isin(*REVIEW_STATUSES), F.lit(False)), "status").when(w["action"].isin("create", "delete", "restore", *AUDITED), "ok").otherwise("action")
    )


def _after(now: Column, w: Column) -> Column:
    a = w["action"]
    of = lambda *names: a.isin(*names)
    status = F.coalesce(w["review_status"], F.lit(PENDING))
    return F.struct(
        (F.coalesce(now["version"], F.lit(0)) + 1).alias("version"), w["payload"].alias("payload"),
        F.when(of("create", "remote"), w["payload"]).when(of("repair") & w["original"].isNotNull(), w["original"]).otherwise(now["baseline"]).alias("baseline"),
        status.alias("review_status"), w["final_result"].alias("final_result"),
        F.when(of("create", "review"), F.coalesce(w["note"], F.lit(""))).otherwise(now["note"]).alias("note"),
        F.when(of("rerun", "remote"), "").when(of("create", "review"), F.coalesce(w["error_type"], F.lit(""))).otherwise(now["error_type"]).alias("error_type"),
        (F.coalesce(now["attempt"], F.lit(0)) + F.when(of("create", "rerun"), 1).otherwise(0)).alias("attempt"), F.when(of("restore"), now["updated"]).otherwise(w["at"]).alias("updated"),
    )


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The records as they were at a time: the version that was valid then; deleted ones are left out."""
    return history.filter((F.col("outcome") == "ok") & (F.col("at") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)) & F.col("version").isNotNull())


def audit(history: DataFrame, record: str) -> DataFrame:
    """Before and after images of all audited writes."""
    return history.filter("audited").select(record, "seq", "at", "action", "before", F.col("payload").alias("after"))


def standards(changes: DataFrame, requirement: str, order: str, columns: list[str]) -> DataFrame:
    """The newest standard of each requirement, told apart by its key, and its revision, the number of its changes (SNK-08).

    Combines before the shuffle; changes without a requirement are left out.
    """
    keyed = changes.withColumn("requirement_key", seal_key(F.col(requirement))).filter("requirement_key <> ''")
    newest = F.max(F.struct(F.col(order).alias("__order"), *[F.col(c) for c in (requirement, *columns)])).alias("b")
    return keyed.groupBy("requirement_key").agg(F.count("*").cast("int").alias("revision"), newest).select("requirement_key", "revision", f"b.{requirement}", *[f"b.{c}" for c in columns])
