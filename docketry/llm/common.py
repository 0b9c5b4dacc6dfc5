"""What the training-data operators share: tables, scratch space, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the contracts: everything but the six ASCII white-space characters.
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table whose values take at most so many bytes may be broadcast.
BROADCAST_BYTES = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (jdir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = jdir.get()
    return shared


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: cuts lineage, outlives executors.

    What the write shuffled is deleted at its end.  The table goes when it is
    discarded, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docketry-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other frames are left alone."""
    for frame in frames:
        if path := _tables.pop(frame, None):
            files, at = _hadoop(frame.sparkSession, path)
            files.delete(at, True)


def _width(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.aggregate(value, F.lit(24).cast("long"), lambda n, x: n + F.coalesce(_width(kind.elementType, x), F.lit(8).cast("long")))
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_width(f.dataType, value[f.name]), F.lit(8).cast("long")) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the table's values are counted to take at most ``most`` bytes; else Spark shuffles it.

    The table is materialized first (unless it is already), so it is computed once.
    """
    held = df if df in _tables else materialize(df)
    size = held.agg(F.sum(_width(held.schema, F.struct(*held.columns)))).first()[0] or 0
    return F.broadcast(held) if size <= most else held


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns k1, k2 that tell documents apart, also with null or repeated ids; rows alike in both columns share them."""
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return [F.coalesce(F.col(doc_id).cast("long"), whole).alias("k1"), whole.alias("k2")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """Columns row (all columns, out of the way of names that operators use), text, k1 and k2."""
    return docs.select(F.struct("*").alias("row"), "text", *doc_key())


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
