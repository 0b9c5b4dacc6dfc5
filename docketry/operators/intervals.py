"""Covered time, gaps and envelopes of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans merged where they overlap or touch (TIM-07); spans that end before they start, or lack an end, are left out."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    valid = spans.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    marked = valid.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("spans")).drop("__island")


def covered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Length that the spans cover, and the envelope's (TIM-05, TIM-07, TIM-10)."""
    merged = islands(spans, keys, start, end)
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), (F.max("end") - F.min("start")).alias("envelope"), F.count("*").alias("islands"))


def gaps(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What the spans leave between them (TIM-04, WIN-17)."""
    w = Window.partitionBy(*keys).orderBy("start")
    merged = islands(spans, keys, start, end)
    return merged.withColumn("__next", F.lead("start").over(w)).filter("__next IS NOT NULL").select(*keys, F.col("end").alias("start"), F.col("__next").alias("end"))
