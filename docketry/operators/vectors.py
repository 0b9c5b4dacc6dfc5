"""Nearest neighbours and consensus over array columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cosine_distance, dot
from ..sources.tables import HEAVY_ROWS_A_TASK


def two_nearest(queries: DataFrame, gallery: DataFrame, id_: str, key: str, vector: str, ratio: float) -> DataFrame:
    """The two nearest of the gallery with the same key for each query, itself left out, and the ratio test (JOIN-15, JOIN-16).

    Spark limits a rank to its first two before the shuffle, so a hot key's
    candidates are never gathered.  Ties go to the smaller id.
    """
    own = lambda rows, *cols: rows.select(*cols, F.col(vector).cast("array<double>").alias("__w")).withColumn("__ww", dot(F.col("__w"), F.col("__w")))
    # Keys are few, so each key's gallery is dealt to tasks and its queries go to all of them; what a vector needs for itself is made once.
    shares = math.ceil(gallery.count() / HEAVY_ROWS_A_TASK) or 1
    q = own(queries, F.col(id_).alias("__q"), F.col(key).alias("__key")).select("__q", "__key", F.col("__w").alias("__v"), F.col("__ww").alias("__vv"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share"))
    g = own(gallery, id_, key, F.pmod(F.xxhash64(id_), F.lit(shares)).cast("int").alias("__part")).repartition(key, "__part")
    pairs = q.join(g, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__share"))).filter(F.col(id_) != F.col("__q"))
    far = 1 - dot(F.col("__v"), F.col("__w")) / F.sqrt(F.col("__vv") * F.col("__ww"))
    near = pairs.select("__q", "__key", F.struct(far.alias("d"), F.col(id_).alias("id")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("__q", "__key").orderBy("n"))
    two = near.withColumn("__rank", rank).filter("__rank <= 2").groupBy("__q", "__key").agg(F.min("n").alias("a"), F.when(F.count("*") == 2, F.max("n")).alias("b"))
    return two.select(
        F.col("__q").alias(id_), F.col("__key").alias(key), F.col("a.id").alias("nearest"), F.col("b.id").alias("second"), F.round("a.d", 6).alias("distance"), F.coalesce(F.col("a.d") < ratio * F.col("b.d"), F.lit(False)).alias("accepted")
    )


def consensus(vectors: DataFrame, key: str, vector: str, within: float) -> DataFrame:
    """Vectors of each key, how many lie within a distance of the key's mean, and the least distance (AGG-33)."""
    parts = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centre = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    d = vectors.join(centre, key).withColumn("d", cosine_distance(F.col(vector), F.col("centre")))
    return d.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("d") <= within).alias("near"), F.round(F.min("d"), 6).alias("nearest"))
