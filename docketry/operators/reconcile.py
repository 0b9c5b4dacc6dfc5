"""Merging physical pages into logical receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PASS, REJECT, REVIEW


def merge_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per logical receipt, and orphans unchanged (REC-01, REC-02, REC-04, REC-05, JOIN-13).

    ``pages`` has the keys and id, page, kind (receipt or continuation),
    status, footer and confidence.  The cover is the receipt of page 0 with
    the greatest id; continuations follow by page.  The footer is that of the
    last continuation with one, else the cover's.  Any rejected page rejects,
    any other page that didn't pass needs review; the confidence is the least.
    Pages of a group without a cover are orphans, returned as they are.
    """
    cover = (F.col("kind") == "receipt") & (F.col("page") == 0)
    follow = (F.col("kind") == "continuation") & (F.col("page") > 0)
    grouped = pages.groupBy(*keys).agg(
        F.max(F.when(cover, F.struct("id", "footer", "status", "confidence"))).alias("cover"),
        F.count_if(follow).alias("follows"),
        F.max(F.when(follow & (F.coalesce("footer", F.lit("")) != ""), F.struct("page", "id", "footer"))).alias("last"),
        F.count_if(follow & (F.col("status") == REJECT)).alias("rejects"),
        F.count_if(follow & (F.coalesce("status", F.lit("")) != PASS)).alias("open"),
        F.min(F.when(follow, F.col("confidence"))).alias("least"),
    )
    whole = grouped.filter("cover IS NOT NULL")
    status = F.when((F.col("cover.status") == REJECT) | (F.col("rejects") > 0), REJECT).when((F.coalesce("cover.status", F.lit("")) != PASS) | (F.col("open") > 0), REVIEW).otherwise(PASS)
    merged = whole.select(
        *keys, F.col("cover.id").alias("id"), (F.col("follows") + 1).alias("pages"), F.coalesce("last.footer", "cover.footer").alias("footer"), status.alias("status"),
        F.least("cover.confidence", "least").alias("confidence"), F.lit(False).alias("orphan"),
    )
    orphans = pages.join(whole.select(*keys), keys, "left_anti")
    return merged.union(orphans.select(*keys, "id", F.lit(1).cast("long"), "footer", "status", "confidence", F.lit(True)))


def numeric_row_order(rows: DataFrame, keys: list[str], number: str, position: str) -> DataFrame:
    """Add ``place``: by row number if all of a key's are digits and unique, else by position (WIN-20)."""
    from pyspark.sql import Window

    n = F.when(F.col(number).cast("string").rlike("^[0-9]+$"), F.col(number).cast("long"))
    sound = rows.withColumn("__n", n).groupBy(*keys).agg((F.count("*") == F.count_distinct("__n")).alias("numeric"))
    placed = rows.withColumn("__n", n).join(sound, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("numeric"), F.col("__n")), position))
    return placed.withColumn("place", place).drop("__n")
