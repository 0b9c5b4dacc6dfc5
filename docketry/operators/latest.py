"""Current versions of records, and pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, which must end in a unique column (WIN-01, WIN-04, WIN-05)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def newest_by(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The same by an aggregate that combines before the shuffle: the row with the greatest ``order`` of each key."""
    best = F.max(F.struct(*[F.struct(*order).alias("__order"), *columns])).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in columns])


def latest_preferring(df: DataFrame, keys: list[str | Column], preferred: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, rows that are preferred before all others (WIN-02)."""
    return latest(df, keys, [F.desc(F.coalesce(preferred, F.lit(False))), *order])


def identity_key(name: Column, id_: Column) -> Column:
    """The name; rows with a blank one are keys of their own."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.concat(F.lit("__result_"), id_.cast("string"))).otherwise(name)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of rows (LIM-02)."""
    return df.orderBy(*order).offset(offset).limit(size)


def counts_with_total(df: DataFrame, status: str) -> DataFrame:
    """Rows by status, and the total under the empty status (AGG-05)."""
    grouped = df.groupBy(F.coalesce(status, F.lit("?")).alias("status")).agg(F.count("*").alias("n"))
    return grouped.union(df.agg(F.lit("").alias("status"), F.count("*").alias("n")))
