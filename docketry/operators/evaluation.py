"""Accuracy, coverage and disagreement of channels, over long cells (sample, channel, state, decision)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CORRECT, ERROR, MATCH, MISMATCH, NOT_RUN, NO_TRUTH, PARTIAL, SCORED, TESTING, UNREAD, UNTESTED, WRONG
from ..functions.measures import safe_ratio
from .latest import newest_by


def cell_state(job: Column, planned: Column, expected: Column, value: Column, decision: Column, failed: Column) -> Column:
    """State of a seal cell, the first that holds (MCH-34)."""
    blank = F.coalesce(value, F.lit("")) == ""
    return (
        F.when(job.isNull(), UNTESTED).when(~planned, NOT_RUN).when(job == "running", TESTING).when(~job.isin("succeeded", "failed"), NOT_RUN)
        .when(expected.isNull(), NO_TRUTH).when(failed, ERROR).when(blank, UNREAD).when(~decision.isin(MATCH, MISMATCH, PARTIAL), WRONG)
        .when(decision == expected, CORRECT).otherwise(WRONG)
    )


def is_scored(state: Column) -> Column:
    return state.isin(*SCORED)


def channel_counts(cells: DataFrame) -> DataFrame:
    """Cells by state and accuracy per channel; accuracy is null without a scored cell (AGG-18)."""
    n = {s: F.count_if(F.col("state") == s) for s in SCORED}
    scored = F.count_if(is_scored(F.col("state")))
    return cells.groupBy("channel").agg(
        n[CORRECT].alias("correct"), n[WRONG].alias("wrong"), n[UNREAD].alias("unread"), n[ERROR].alias("failed"), scored.alias("scored"), F.round(F.try_divide(n[CORRECT], scored), 4).alias("accuracy")
    )


def common_sample(cells: DataFrame, channels: int) -> DataFrame:
    """Accuracy on the samples that all ``channels`` scored (AGG-22)."""
    scored = cells.filter(is_scored(F.col("state")))
    shared = scored.groupBy("sample").agg(F.count_distinct("channel").alias("n")).filter(F.col("n") == channels).select("sample")
    return scored.join(shared, "sample", "left_semi").groupBy("channel").agg(F.count("*").alias("scored"), F.count_if(F.col("state") == CORRECT).alias("correct"))


def disagreements(cells: DataFrame) -> DataFrame:
    """For each two channels that decided on the same samples: how often they differ, and who was right (AGG-23)."""
    decided = cells.filter(F.col("state").isin(CORRECT, WRONG)).select("sample", "channel", "decision", (F.col("state") == CORRECT).alias("right"))
    a, b = decided.alias("a"), decided.alias("b")
    pairs = a.join(b, (F.col("a.sample") == F.col("b.sample")) & (F.col("a.channel") < F.col("b.channel")))
    ra, rb = F.col("a.right"), F.col("b.right")
    return pairs.groupBy(F.col("a.channel").alias("channel_a"), F.col("b.channel").alias("channel_b")).agg(
        F.count("*").alias("total"), F.count_if(~F.col("a.decision").eqNullSafe(F.col("b.decision"))).alias("differ"), F.count_if(ra & ~rb).alias("only_a"),
        F.count_if(~ra & rb).alias("only_b"), F.count_if(ra & rb).alias("both"), F.count_if(~ra & ~rb).alias("neither"),
    )


def error_types(cells: DataFrame) -> DataFrame:
    """Wrong cells by kind and channel (AGG-19)."""
    d, e = F.col("decision"), F.col("expected")
    kind = F.when((e == MISMATCH) & (d == MATCH), "false_accept").when((e == MATCH) & (d == MISMATCH), "false_reject").when(d == PARTIAL, "partial").otherwise("other")
    return cells.filter(F.col("state") == WRONG).groupBy("channel", kind.alias("kind")).agg(F.count("*").alias("n"))


def field_accuracy(truth: DataFrame, results: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Correct and evaluated samples of each field; samples without a result count nowhere (AGG-09, AGG-10).

    ``fields`` maps a field to the condition, on the joined row, that it is right; null: not labelled.
    """
    joined = truth.join(results, keys)
    cells = joined.select(F.explode(F.array(*[F.struct(F.lit(name).alias("field"), ok.alias("ok")) for name, ok in fields.items()])).alias("c")).select("c.*")
    return cells.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count("ok").alias("evaluated"), safe_ratio(F.count_if("ok"), F.count("ok")).alias("accuracy"))


def against_truth(truth: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Truth with the result of the same key, and whether there is one (JOIN-10)."""
    return truth.join(results.withColumn("tested", F.lit(True)), key, "left").withColumn("tested", F.coalesce("tested", F.lit(False)))


def date_metrics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, detection and abstention of dates, coverage and accuracy of reliable decisions (AGG-12, AGG-13).

    Takes ``present``, ``day``, ``required`` of the truth and ``actual``,
    ``status``, ``reliable`` of the result; untested samples count nowhere.  A
    label without a day (null) is never right; one that says there is none (an
    empty text) is, where nothing was read.
    """
    present, read = F.coalesce("present", F.lit(True)), F.coalesce("actual", F.lit("")) != ""
    expected = F.when(F.col("day") == F.col("required"), MATCH).otherwise(MISMATCH)
    decided = present & F.coalesce("reliable", F.lit(False)) & F.coalesce(F.col("status").isin(MATCH, MISMATCH), F.lit(False))
    n = F.count_if
    right = F.coalesce(F.coalesce("actual", F.lit("")) == F.col("day"), F.lit(False))
    return joined.filter("tested").groupBy(*keys).agg(
        F.count("*").alias("samples"), safe_ratio(n(right), F.count("*")).alias("accuracy"), safe_ratio(n(present & read), n(present)).alias("detection"),
        safe_ratio(n(~present & ~read), n(~present)).alias("abstention"), safe_ratio(n(decided), F.count("*")).alias("decision_coverage"),
        safe_ratio(n(decided & (F.col("status") == expected)), n(decided)).alias("decision_accuracy"),
    )


def backend_metrics(truth: DataFrame, results: DataFrame, key: str, backend: str, order: str) -> DataFrame:
    """The same for each backend over its newest result of each sample, with mean seconds (AGG-15)."""
    rest = [c for c in results.columns if c not in (key, backend, order)]
    own = newest_by(results.filter(F.trim(backend) != ""), [backend, key], rest, [order])
    tested = against_truth(truth, own, key).filter("tested")
    timing = tested.groupBy(backend).agg(F.coalesce(F.round(F.avg("seconds"), 2), F.lit(0.0)).alias("mean_seconds"), F.count("seconds").alias("timed"))
    return date_metrics(tested, [backend]).join(timing, backend)


def coverage(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Images, labelled ones and the share that is labelled (AGG-17)."""
    both = images.select(key).distinct().join(labels.select(key).distinct().withColumn("labelled", F.lit(True)), key, "left")
    n, k = F.count("*"), F.count("labelled")
    return both.agg(n.alias("images"), k.alias("labelled"), (n - k).alias("unlabelled"), safe_ratio(k, n).alias("ratio"))


def coverage_card(cells: DataFrame) -> DataFrame:
    """Samples that are labelled, tested, can be evaluated, or went wrong in one channel or more (AGG-20)."""
    s = F.col("state")
    samples = cells.groupBy("sample").agg(F.bool_or(s != NO_TRUTH).alias("l"), F.bool_or(~s.isin(UNTESTED, NOT_RUN)).alias("t"), F.bool_or(is_scored(s)).alias("e"), F.bool_or(s.isin(WRONG, UNREAD, ERROR)).alias("a"))
    return samples.agg(F.count_if("l").alias("labelled"), F.count_if("t").alias("tested"), F.count_if(~F.col("t")).alias("untested"), F.count_if("e").alias("evaluable"), F.count_if("a").alias("abnormal"))


def label_counts(rows: DataFrame, explicit: str, reasons: str, place: str) -> DataFrame:
    """How often each label occurs, a row counting once; an explicit label stands for the row's reasons (AGG-16, SRT-06).

    ``first_place`` is the least ``place``: lists go by count, ties by it.
    """
    named = F.filter(F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    label = F.when(F.trim(explicit) != "", F.array(F.trim(explicit))).otherwise(F.array_distinct(named))
    return rows.select(place, F.explode(label).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.min(place).alias("first_place"))


# Labels of groups without a name.
UNNAMED, NO_REQUIREMENT = "未分类", "未标注签章要求"


def group_statistics(samples: DataFrame, by: str, unnamed: str = UNNAMED) -> DataFrame:
    """Samples of each group, and how many are annotated, can be evaluated and went wrong (AGG-21); nameless ones are one group.

    ``samples`` has ``by`` and the flags annotated, evaluable and anomalous.
    """
    key = F.trim(F.coalesce(F.col(by), F.lit("")))
    n = lambda flag: F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    return samples.groupBy(F.when(key == "", unnamed).otherwise(key).alias("label")).agg(F.count("*").alias("total"), n("annotated").alias("annotated"), n("evaluable").alias("evaluable"), n("anomalous").alias("anomalies"))


def group_order() -> list[Column]:
    """Groups with the most anomalies first, then the largest, then by their labels in Chinese order: digits, Han by sound, Latin (SRT-07)."""
    return [F.desc("anomalies"), F.desc("total"), F.collate(F.col("label"), "zh").asc(), F.col("label").asc()]
