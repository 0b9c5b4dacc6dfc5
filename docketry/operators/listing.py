"""Lists of receipts: what can be reviewed, in which order, and joins by containment and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import REVIEW


def review_order(status: Column, failed: Column, updated: Column, created: Column, id_: Column) -> list[Column]:
    """Finished receipts, then those that wait for review, then failed ones; the latest change and the greatest id first (SRT-01)."""
    group = F.when(F.coalesce(failed, F.lit(False)), 2).when(status == REVIEW, 1).otherwise(0)
    return [group.asc(), F.coalesce(updated, created).desc_nulls_last(), id_.desc()]


def reviewable(rows: DataFrame, busy: DataFrame, id_: str, pages: str) -> DataFrame:
    """Receipts of which neither the first page nor a continuation page is busy (FLT-08); ``pages`` holds the continuation pages' ids."""
    own = F.array_union(F.array(F.col(id_)), F.coalesce(F.col(pages), F.array().cast(rows.schema[pages].dataType)))
    taken = rows.select(id_, F.explode(own).alias("__page")).join(busy.select(F.col(id_).alias("__page")), "__page", "left_semi")
    return rows.join(taken.select(id_).distinct(), id_, "left_anti")


def jobs_then_records(jobs: DataFrame, records: DataFrame, result: str, order: str) -> DataFrame:
    """The first job of each result, jobs without a result, and records that no job has (JOIN-22)."""
    rest = [c for c in jobs.columns if c not in (result, order)]
    known = jobs.filter(F.col(result).isNotNull())
    first = known.groupBy(result).agg(F.min(F.struct(order, *rest)).alias("r")).select(result, *[F.col(f"r.{c}").alias(c) for c in (order, *rest)])
    listed = first.unionByName(jobs.filter(F.col(result).isNull()).select(*first.columns))
    return listed.unionByName(records.join(known.select(result), result, "left_anti"), allowMissingColumns=True)


def hydrate(narrow: DataFrame, wide: DataFrame, key: str, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page chosen on narrow columns, and only its rows of the wide table (LIM-03)."""
    return wide.join(F.broadcast(narrow.orderBy(*order).offset(offset).limit(size).select(key)), key, "left_semi")


def within(inner: DataFrame, outer: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that lie inside a span of the same key in ``outer`` (JOIN-24).

    One sorted pass over a key's spans: of the outer ones that began by then,
    the latest end decides.  No pair of spans is formed.
    """
    rows = inner.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), F.struct(*inner.columns).alias("__row"))
    spans = outer.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    begun = Window.partitionBy("__key").orderBy("__start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("__row").isNull(), F.col("__end"))).over(begun)
    return rows.union(spans).withColumn("__last", last).filter(F.col("__row").isNotNull() & (F.col("__end") <= F.col("__last"))).select("__row.*")


# Least gap, greatest distance of the centres and least share of the height for two regions side by side.
GAP, CENTRES, SHARE = 0.03, 0.15, 0.25


def left_of_another(boxes: DataFrame, page: str) -> DataFrame:
    """Regions (x1, y1, x2, y2 as shares of the page) with another region at their right on the same page (JOIN-25)."""
    other = boxes.select(F.col(page).alias("__page"), *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")])
    height = F.least(F.col("y2") - F.col("y1"), F.col("__y2") - F.col("__y1"))
    common = F.least("y2", "__y2") - F.greatest("y1", "__y1")
    beside = (F.col("__x1") - F.col("x2") >= GAP) & (F.abs(F.col("y1") + F.col("y2") - F.col("__y1") - F.col("__y2")) / 2 <= CENTRES) & (common >= SHARE * height)
    return boxes.join(other, (F.col(page) == F.col("__page")) & beside, "left_semi")
