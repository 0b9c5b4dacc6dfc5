"""Sources: star-schema tables, truth maps, folders of artifacts, overlays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; only the columns and row groups that a query needs are read (SRC-01, SRC-02)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows that one task sorts and groups at once, and how many of those on which much work is done.
ROWS_A_TASK, HEAVY_ROWS_A_TASK = 250_000, 20_000


def dealt(rows: DataFrame, *keys: str, heavy: bool = False) -> DataFrame:
    """Rows dealt by their keys, in more partitions than the session's where those would hold more than ``ROWS_A_TASK`` rows each (``HEAVY_ROWS_A_TASK`` if heavy).

    Joins and groups by these keys, or by more columns, need no other shuffle,
    and a task's memory doesn't grow with the input.  Rows are counted first,
    so they should be a table's, whose files know their numbers.
    """
    n = math.ceil(rows.count() / (HEAVY_ROWS_A_TASK if heavy else ROWS_A_TASK))
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def by_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is in ``ids``: a semi join instead of lists in chunks (SRC-04, FLT-09)."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def truth_file(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A JSON file that maps names to entries, as rows name, entry (SRC-06); ``entry`` is the DDL of an entry."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("name", "entry"))


def artifacts(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,webp}", recursive: bool = True) -> DataFrame:
    """Files of a folder: path, modificationTime, length, content (SRC-07, SRC-08)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def offline_runs(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Result files of named backends, later files winning per filename (SRC-18)."""
    parts = [df.withColumns({"backend": F.lit(name), "__file": F.lit(i)}) for i, (name, df) in enumerate(runs)]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p, allowMissingColumns=True)
    rest = [c for c in joined.columns if c not in ("backend", "filename", "__file")]
    best = joined.groupBy("backend", "filename").agg(F.max_by(F.struct(*rest), "__file").alias("r"))
    return best.select("backend", "filename", "r.*")


def overlay(base: DataFrame, over: DataFrame, key: str, deleted: str) -> DataFrame:
    """Rows of ``base`` with those of ``over`` put over them, without what ``over`` marks deleted (SRC-11, MAP-01)."""
    b, o = base.alias("b"), over.alias("o")
    joined = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer").filter(~F.coalesce(F.col(f"o.{deleted}"), F.lit(False)))
    return joined.select(*[F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) if c in over.columns else F.col(f"b.{c}").alias(c) for c in base.columns])
