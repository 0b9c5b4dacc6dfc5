"""Sinks: keyed merges into Parquet tables, reports and content deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Held


def merge_rows(current: DataFrame, changes: DataFrame, keys: list[str], order: str, guard: Column | None = None) -> DataFrame:
    """Current rows with changes upserted, the greatest ``order`` of a key winning (SNK-02, SNK-06, SNK-07, STM-17).

    ``guard`` may name changes that are refused.
    """
    wanted = changes.filter(guard) if guard is not None else changes
    both = current.unionByName(wanted.select(*current.columns))
    rest = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__order"), *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_or_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows only where their key is free, the least ``order`` of a key first (SNK-09)."""
    rest = [c for c in current.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("__order"), *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return current.unionByName(first.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def expired(rows: DataFrame, at: Column, days: int, now: Column, active: DataFrame, key: str) -> DataFrame:
    """Rows older than the retention that nothing active refers to (SNK-12, SNK-13)."""
    return rows.filter(at < now - F.make_interval(days=F.lit(days))).join(active.select(key), key, "left_anti")


def content_groups(rows: DataFrame, content: str, kept_order: list[str]) -> DataFrame:
    """Of each row ``kept_order``, the content's digest and ``is_first``: whether it is the least of equal contents (SNK-20).

    Contents are read and digested once; only digests and ``kept_order`` are
    shuffled.  The least is an aggregate that combines before the shuffle, and
    AQE splits the join back, so a content of very many rows isn't one task's work.
    """
    digested = Held(rows.select(*kept_order, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("digest"))).rows
    first = digested.groupBy("digest").agg(F.min(F.struct(*kept_order)).alias("__first"))
    return digested.join(first, "digest").withColumn("is_first", F.struct(*kept_order) == F.col("__first")).drop("__first")


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, replaced as a whole (SNK-10, SNK-17)."""
    df.write.mode("overwrite").json(path)
