"""Review of receipts: several readings under a policy, what a confirmation lacks, counts of the work list, merged projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FAILED, MATCH, MISMATCH, PASS, REJECT, REVIEW, WAITING

# Name of receipts with an active job, and the statuses that the work list counts.
PROCESSING, CONFIRMED = "处理中", "确认通过"
COUNTED = [PROCESSING, PASS, REVIEW, REJECT, FAILED]


def _sure(status: Column, reliable: Column, wanted: str) -> Column:
    return F.coalesce((status == wanted) & reliable, F.lit(False))


def signature_mode(checks: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """One signature check per key from all readings (``status``, ``reliable``): any or every one has to match (MCH-26).

    Reliable mismatches throughout are a mismatch, anything else needs review.
    """
    return signature_modes(checks, keys).filter(F.col("every") == every).drop("every")


def signature_modes(checks: DataFrame, keys: list[str]) -> DataFrame:
    """The signature check of each key under both modes, from one pass over the readings: a row for each value of ``every``."""
    fit = _sure(F.col("status"), F.col("reliable"), MATCH)
    against = F.bool_and(_sure(F.col("status"), F.col("reliable"), MISMATCH))
    found = checks.groupBy(*keys).agg(F.bool_or(fit).alias("one"), F.bool_and(fit).alias("each"), against.alias("against"))
    mode = lambda matched, every: F.struct(F.col(matched).alias("matched"), F.lit(every).alias("every"))
    both = found.select(*keys, "against", F.inline(F.array(mode("one", False), mode("each", True))))
    status = F.when(F.col("matched"), MATCH).when(F.col("against"), MISMATCH).otherwise(REVIEW)
    return both.select(*keys, status.alias("status"), (F.col("matched") | F.col("against")).alias("reliable"), "every")


def date_variant(variants: DataFrame, keys: list[str], mode: str | None = None) -> DataFrame:
    """The date reading of each key that stands, with its status, and whether usable readings differ (MCH-23, SET-08).

    ``variants`` has pos, usable, status, reliable, actual and required (dates);
    required is the key's, taken from the first usable reading that has one.
    The first reliable match goes before the date nearest to the required one,
    that before the first usable reading, that before the first of all.  With
    the policy ``all`` every reading must be usable and a reliable match, else
    it is up for review; with ``any`` and ``none`` the chosen one stands; with
    others, readings that differ are up for review, and unreliable ones make
    the chosen one unreliable.  A group is one key's readings.
    """
    own = F.struct("pos", F.coalesce("usable", F.lit(False)).alias("usable"), "status", F.coalesce("reliable", F.lit(False)).alias("reliable"), "actual", "required")
    read = variants.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("all"), F.first(F.col(mode) if mode else F.lit(None).cast("string"), ignorenulls=True).alias("mode"))
    read = read.withColumn("used", F.filter("all", lambda v: v["usable"]))
    read = read.withColumn("due", F.get(F.filter(F.transform("used", lambda v: v["required"]), F.isnotnull), F.lit(0)))
    sure = lambda v: F.coalesce(v["status"] == MATCH, F.lit(False)) & v["reliable"]
    first = lambda found: F.get(found, F.lit(0))
    dated = F.transform(F.filter("used", lambda v: v["actual"].isNotNull() & F.col("due").isNotNull()), lambda v: F.struct(F.abs(F.datediff(v["actual"], F.col("due"))).alias("days"), v["pos"].alias("pos"), v.alias("v")))
    chosen = F.coalesce(first(F.filter("used", lambda v: sure(v) & v["actual"].isNotNull())), first(F.array_sort(dated))["v"], first(F.col("used")), first(F.col("all")))
    differ = F.size(F.array_distinct(F.transform("used", lambda v: F.struct(F.coalesce(v["actual"].cast("string"), F.lit("")), F.coalesce(v["status"], F.lit("")))))) > 1
    held = read.select(*keys, "mode", chosen.alias("b"), differ.alias("conflict"), (F.size("used") > 0).alias("some"), ((F.size("used") == F.size("all")) & F.forall("used", sure)).alias("every"), F.forall("used", lambda v: v["reliable"]).alias("firm"))
    policy = F.coalesce("mode", F.lit(""))
    review = F.col("some") & F.when(policy == "all", ~F.col("every")).when(policy.isin("any", "none"), False).otherwise(F.col("conflict"))
    firm = F.when(review, False).when(F.col("some") & ~policy.isin("all", "any", "none") & ~F.col("firm"), False).otherwise(F.col("b.reliable"))
    return held.select(*keys, "b.pos", "b.actual", F.when(review, REVIEW).otherwise(F.col("b.status")).alias("status"), firm.alias("reliable"), "conflict")


def confirmation_gaps(standard: Column, date: Column, seal: Column, signature: Column, verdict: Column) -> Column:
    """Names of what a confirmation lacks; each argument tells whether its part is in order, null: not asked for (MCH-44).

    The verdict counts only where nothing else is missing.
    """
    parts = [("standard", standard), ("date", date), ("seal", seal), ("signature", signature)]
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in parts]))
    return F.when((F.size(missing) == 0) & (F.coalesce(verdict, F.lit("")) != PASS), F.array(F.lit("verdict"))).otherwise(missing)


def confirmation_missing(c: dict[str, Column]) -> Column:
    """What a review that would confirm a receipt lacks, by the gate's own rules; empty where nothing is to be confirmed (MCH-44).

    ``c`` names review_status, final_result, overall; the policies seal_mode,
    date_mode and signature_mode; standard_requirement, standard_status and
    human_match of the standard stamp; date_actual, date_status, date_reliable;
    seal_read, seal_status, seal_reliable; signature_status, signature_reliable.
    """
    said = lambda name, value: F.coalesce(c[name] == value, F.lit(False))
    there = lambda name: F.coalesce(c[name], F.lit("")) != ""
    true = lambda name: F.coalesce(c[name], F.lit(False))
    seal, date = ~said("seal_mode", "none"), ~said("date_mode", "none")
    gaps = confirmation_gaps(
        F.when(seal & there("standard_requirement"), said("standard_status", "matched") | true("human_match")),
        F.when(date, there("date_actual") & said("date_status", MATCH) & true("date_reliable")),
        F.when(seal, there("seal_read") & said("seal_status", MATCH) & true("seal_reliable")),
        F.when(said("signature_mode", "any") | said("signature_mode", "all"), said("signature_status", MATCH) & true("signature_reliable")), c["overall"],
    )
    return F.when(said("review_status", CONFIRMED) | said("final_result", PASS), gaps).otherwise(F.array().cast("array<string>"))


def list_status(active: Column, final: Column, overall: Column) -> Column:
    """Status in the work list: processing, else the final or overall verdict; waiting ones are up for review (FLT-10)."""
    verdict = F.coalesce(F.nullif(final, F.lit("")), overall)
    return F.when(F.coalesce(active, F.lit(False)), PROCESSING).when(verdict == WAITING, REVIEW).otherwise(verdict)


def list_counts(rows: DataFrame, status: Column) -> DataFrame:
    """Receipts of each status that the work list counts, and all of them under the empty one (AGG-06)."""
    by = rows.groupBy(status.alias("status")).agg(F.count("*").alias("n")).filter(F.col("status").isin(COUNTED))
    return by.union(rows.agg(F.lit("").alias("status"), F.count("*").alias("n")))


def list_order(created: Column, id_: Column, job: Column) -> list[Column]:
    """The newest first, then the greatest id, then the greatest job (SRT-02)."""
    return [F.coalesce(created, F.lit("")).desc(), F.coalesce(id_, F.lit(0)).desc(), F.coalesce(job, F.lit("")).desc()]


def last_file_wins(rows: DataFrame, name: str, position: str) -> DataFrame:
    """The last row of each file name, with the position of its first one as ``first``; blank names stay apart (WIN-06)."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    keyed = rows.withColumn("__key", F.when(blank, F.concat(F.lit("\u0000"), F.col(position).cast("string"))).otherwise(F.trim(name)))
    best = F.max(F.struct(position, *[c for c in rows.columns if c != position])).alias("b")
    return keyed.groupBy("__key").agg(best, F.min(position).alias("first")).select("b.*", "first")


def apart(spans: DataFrame, key: str, start: str, end: str, id_: str) -> DataFrame:
    """Whether no span of a key begins before its predecessor ends (WIN-18)."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end, id_))
    ok = F.coalesce(F.col(start) >= before, F.lit(True))
    return spans.withColumn("__ok", ok).groupBy(key).agg(F.bool_and("__ok").alias("apart"))


def merge_calls(calls: DataFrame, task: str, method: str, position: str, protected: list[str], others: list[str]) -> DataFrame:
    """Rows of one remote task as one: the last value that isn't null; calls without a task stay apart (JOIN-23).

    Once a call was ``invoked``, later ones that weren't leave its ``protected`` columns alone.
    """
    own = F.coalesce(F.nullif(F.col(task).cast("string"), F.lit("")), F.concat(F.lit("\u0000"), F.col(position).cast("string")))
    keyed = calls.withColumn("__task", own).withColumn("invoked", F.coalesce("invoked", F.lit(False)))
    since = keyed.groupBy(method, "__task").agg(F.min(F.when(F.col("invoked"), F.col(position))).alias("__since"))
    valid = F.col("invoked") | F.coalesce(F.col(position) < F.col("__since"), F.lit(True))

    def last(column: str, ok: Column) -> Column:
        return F.max(F.when(ok & F.col(column).isNotNull(), F.struct(position, column)))[column].alias(column)

    values = [last(c, valid) for c in protected] + [last(c, F.lit(True)) for c in others]
    merged = keyed.join(since, [method, "__task"]).groupBy(method, "__task")
    return merged.agg(F.min(position).alias(position), F.first(task).alias(task), F.bool_or("invoked").alias("invoked"), *values).drop("__task")


def merge_lists(*sources: Column) -> Column:
    """Items of all lists once, in the order in which they first come; null lists have none (REC-12, SET-02)."""
    return F.array_distinct(F.flatten(F.array_compact(F.array(*sources))))


def overridden(rows: DataFrame, override: str, columns: list[str]) -> DataFrame:
    """Columns replaced by those members of the struct ``override`` that aren't null; ``applied`` tells whether it is there (REC-03)."""
    new = {c: F.coalesce(F.col(f"{override}.{c}"), F.col(c)) for c in columns}
    return rows.withColumns(new | {"applied": F.col(override).isNotNull()}).drop(override)


def rerun_plan(samples: DataFrame, name: str, accepted: Column, expected: Column, candidate: Column) -> DataFrame:
    """Files to run again (``blocked`` false), or only the accepted negatives that forbid it (AGG-47)."""
    named = samples.filter(accepted & (F.coalesce(F.col(name), F.lit("")) != ""))
    blocked = named.filter(~expected).select(name, F.lit(True).alias("blocked")).distinct()
    wanted = named.filter(expected & candidate).select(name, F.lit(False).alias("blocked")).distinct()
    any_ = blocked.limit(1).select(F.lit(True).alias("__any"))
    return blocked.union(wanted.join(F.broadcast(any_), F.lit(True), "left_anti"))


def separability(rows: DataFrame, keys: list[str], score: str, expected: Column) -> DataFrame:
    """Greatest score of the positives and of the negatives, and whether the positives' is above (AGG-46)."""
    best = lambda c: F.max(F.when(c, F.col(score)))
    return rows.groupBy(*keys).agg(best(expected).alias("positive"), best(~expected).alias("negative")).withColumn("separable", F.coalesce(F.col("positive") > F.col("negative"), F.lit(False)))


def standard_groups(standards: DataFrame, key: str, requirement: str, id_: str) -> DataFrame:
    """Standards of one requirement together, those without one apart: first id and number of each group (AGG-49)."""
    alone = F.coalesce(F.trim(requirement), F.lit("")) == ""
    return standards.groupBy(F.col(key), F.when(alone, F.col(id_)).alias("own")).agg(F.min(id_).alias("first"), F.count("*").alias("n")).drop("own")


def batch_times(batches: DataFrame, jobs: DataFrame, batch: str) -> DataFrame:
    """Batches (``total``, ``completed``) with the first start and, once complete, the last end of their jobs (JOIN-04)."""
    seen = jobs.groupBy(batch).agg(F.min(F.nullif("started", F.lit(""))).alias("started"), F.max("finished").alias("finished"))
    done = F.when(F.col("completed") >= F.col("total"), F.coalesce("finished", F.lit(""))).otherwise("")
    return batches.join(seen, batch, "left").withColumns({"started": F.coalesce("started", F.lit("")), "finished": done})
