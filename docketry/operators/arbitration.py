"""Choosing one value among the readings of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence thresholds of the rules.
LOW, HIGH, LEAD = 0.65, 0.85, 0.15


def quality(conf: Column, low: Column) -> Column:
    """0 if flagged low or below LOW, 3 from HIGH on, 2 if flagged not low or with any confidence, else 1."""
    return F.when(F.coalesce(low, F.lit(False)) | (conf < LOW), 0).when(conf >= HIGH, 3).when((low == F.lit(False)) | conf.isNotNull(), 2).otherwise(1)


def choose(readings: DataFrame, keys: list[str], preferred: str | None = None, with_pos: bool = False) -> DataFrame:
    """One row per key: value, rule and disputed, and the chosen reading's pos if asked for (MCH-21, WIN-11, AGG-32).

    ``readings`` has the keys and pos, value, method, provider, conf and low.
    A null value is a value like others.  Rules, in order: all agree; the
    preferred provider; two or more methods for one value and fewer for all
    others (readings of quality 0 and without a method don't vote); the best is
    good and all others are flagged low; the best is confident and leads all
    others, whose confidences are known; else the best, disputed.
    """
    q = quality(F.col("conf"), F.col("low"))
    rank = F.struct(q.alias("q"), F.coalesce("conf", F.lit(-1.0)).alias("c"), (-F.col("pos")).alias("p"))
    own = F.col("provider") == F.lit(preferred) if preferred is not None else F.lit(False)
    votes = (F.col("__q") > 0) & (F.coalesce("method", F.lit("")) != "")
    values = (
        readings.withColumns({"__rank": rank, "__own": F.coalesce(own, F.lit(False)), "__q": q})
        .groupBy(*keys, "value")
        .agg(
            F.max("__rank").alias("rank"), F.max(F.when(F.col("__own"), F.col("__rank"))).alias("own"), F.count_distinct(F.when(votes, F.col("method"))).alias("support"),
            F.bool_and(F.coalesce("low", F.lit(False))).alias("all_low"), F.max("conf").alias("conf"), F.bool_and(F.col("conf").isNotNull()).alias("known"),
        )
    )
    best = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.struct("rank", "value")).alias("best"), F.max(F.when(F.col("own").isNotNull(), F.struct("own", "value"))).alias("own"), F.count("own").alias("owns"),
        F.max("support").alias("most"), F.max(F.struct("support", "rank", "value")).alias("voted"), F.collect_list(F.struct("value", "support", "all_low", "conf", "known")).alias("each"),
    )
    others = F.filter("each", lambda v: ~v["value"].eqNullSafe(F.col("best.value")))
    sure = F.col("best.rank.c")
    rules = [
        ("unanimous", F.col("n") == 1, "best.value", F.lit(False)),
        ("preferred", F.col("owns") > 0, "own.value", F.col("owns") > 1),
        ("vote", (F.col("most") >= 2) & (F.size(F.filter("each", lambda v: v["support"] == F.col("most"))) == 1), "voted.value", F.lit(False)),
        ("others_low", (F.col("best.rank.q") >= 2) & F.forall(others, lambda v: v["all_low"]), "best.value", F.lit(False)),
        ("confidence", (F.col("best.rank.q") > 0) & (sure >= HIGH) & F.forall(others, lambda v: v["known"] & (sure - v["conf"] >= LEAD)), "best.value", F.lit(False)),
        ("rank", F.lit(True), "best.value", F.lit(True)),
    ]
    ruled = best.withColumn("rule", F.coalesce(*[F.when(holds, F.lit(name)) for name, holds, _, _ in rules]))
    of = lambda i: F.coalesce(*[F.when(F.col("rule") == r[0], i(r)) for r in rules])
    value = F.when(F.col("rule") == "preferred", F.col("own.value")).when(F.col("rule") == "vote", F.col("voted.value")).otherwise(F.col("best.value"))
    pos = F.when(F.col("rule") == "preferred", F.col("own.own.p")).when(F.col("rule") == "vote", F.col("voted.rank.p")).otherwise(F.col("best.rank.p"))
    return ruled.select(*keys, value.alias("value"), "rule", of(lambda r: r[3]).alias("disputed"), *[(-pos).alias("pos")] * with_pos)
