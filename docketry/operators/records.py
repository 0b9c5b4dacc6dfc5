"""Record-level operators: row accuracy, issues, revisions, cascades, claims and recovered spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_accuracy(truth: DataFrame, result: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells and rows that are right, over all and those labelled (AGG-11, JOIN-11, JOIN-12).

    Cells count where the truth has the row; a row is right if all its cells
    are. Rows that only the result has raise the number of rows, not of cells.
    """
    t = truth.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns], F.lit(True).alias("in_t"))
    r = result.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("in_r"))
    j = t.join(r, keys, "full_outer")
    known = F.col("in_t").isNotNull()
    right = [known & F.col("in_r").isNotNull() & F.col(f"t_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns]
    cells = sum((x.cast("int") for x in right), F.lit(0))
    return j.agg(
        F.count("*").alias("rows"), F.count_if(known & (cells == len(columns))).alias("rows_right"), (F.count_if(known) * len(columns)).alias("cells"), F.sum(cells).alias("cells_right"), F.count_if(~known).alias("extra_rows"), F.count_if(known & F.col("in_r").isNull()).alias("missing_rows")
    )


def blocking_issues(issues: DataFrame, keys: list[str], excluded: list[str], ignore_low: bool) -> DataFrame:
    """Distinct issues that block: not of excluded scopes, not low confidence if that is ignored (FLT-13)."""
    keep = F.col("blocking") & ~F.col("scope").isin(*excluded)
    if ignore_low:
        keep = keep & (F.col("code") != "low_confidence")
    return issues.filter(keep).select(*keys, "code", "scope").distinct()


def revision(parts: list[str], version: str = "v2") -> Column:
    """A digest of the named columns as compact JSON, by name (JSN-07, STM-05)."""
    return F.concat(F.lit(f"{version}:"), F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256))


def delete_with_related(rows: DataFrame, chosen: Column, relation: list[str]) -> DataFrame:
    """Rows without the chosen ones and all that share their relation; null relations share nothing (SNK-11)."""
    gone = rows.filter(chosen).select(*relation).distinct()
    return rows.filter(~F.coalesce(chosen, F.lit(False))).join(gone, relation, "left_anti")


def renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Keys put through a table old, new; others stay (SNK-14)."""
    return rows.join(names.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", F.col(column))).drop("new")


def displayed_job(jobs: DataFrame, keys: list[str], active: Column, cancelled: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The newest job that isn't cancelled, an active one before all others (JOIN-21)."""
    best = F.max(F.struct(F.coalesce(active, F.lit(False)).alias("a"), F.struct(*order).alias("o"), *columns))
    return jobs.filter(~F.coalesce(cancelled, F.lit(False))).groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def lane_heads(jobs: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    """The first job of each lane, and the rank of the lanes' heads among each other (LIM-04, LIM-05, STM-12)."""
    head = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    heads = jobs.withColumn("__h", head).filter("__h = 1").drop("__h")
    return heads.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # one row a lane


def recovered_spans(spans: DataFrame, start: str, end: str, seconds: str) -> DataFrame:
    """Missing ends from start and seconds, flagged approximate; spans that stay open or run backwards are left out (TIM-01, TIM-03)."""
    made = F.coalesce(F.col(end), F.col(start) + F.col(seconds))
    return spans.withColumn("approximate", F.col(end).isNull()).withColumn(end, made).filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))


def self_time(spans: DataFrame, id_: str, parent: str, seconds: str) -> DataFrame:
    """Seconds of each span without those of its children, not below zero (TIM-08)."""
    inner = spans.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(id_)).agg(F.sum(seconds).alias("__inner"))
    return spans.join(inner, id_, "left").withColumn("own", F.greatest(F.col(seconds) - F.coalesce("__inner", F.lit(0)), F.lit(0))).drop("__inner")


def best_date(observations: DataFrame, keys: list[str], date: str, percent: str, required: str) -> DataFrame:
    """The date with the highest score: its best reading, 12 for each further one up to 36, and 35 if it is the required one (WIN-12).

    Scores are whole hundredths; the earlier of equal dates wins.
    """
    d = observations.filter(F.col(date).isNotNull()).groupBy(*keys, date).agg(F.max(percent).alias("p"), F.count("*").alias("n"), F.max((F.col(date) == F.col(required)).cast("int")).alias("eq"))
    score = (F.col("p") + F.least(12 * (F.col("n") - 1), F.lit(36)) + 35 * F.coalesce("eq", F.lit(0))).cast("long")
    first = F.max(F.struct(score.alias("score"), (-F.unix_date(date)).alias("o"), F.col(date).alias("date"), F.col("n").alias("readings"))).alias("b")
    return d.groupBy(*keys).agg(first).select(*keys, "b.date", "b.score", "b.readings")
