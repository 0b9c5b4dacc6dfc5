"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
            set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = set_dir.get()
    return shared


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A folder of its own, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/docketry-{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


class Held:
    """A table written to the shared folder and read back: it cuts lineage, outlives executors and is deleted on ``drop``."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
