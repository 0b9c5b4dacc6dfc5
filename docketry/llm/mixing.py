"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

#: Hash digits that make the uniform number: 13 hexadecimal digits are 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from an MD5 digest of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 4 * DIGITS))


def poisson_cdf(rate: Column, terms: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... terms as an array, by the recurrence p(k) = p(k-1) * rate / k."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda s: s["cdf"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = 1.0) -> DataFrame:
    """Mean repetition rate of each source: weight share * budget * all rows / rows of the source.

    ``weights`` maps a source to its target share (normalised over the sources
    that exist); sources that it lacks get none.  None weighs all sources
    alike.  The null source counts as one of its own, with the key None.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        bad = [k for k, v in weights.items() if not (v >= 0 and math.isfinite(v))]
        if bad:
            raise ValueError(f"weights must be finite and not negative: {bad}")
        named = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        known = F.coalesce(F.try_element_at(F.create_map(*named), F.col("source")), F.lit(0.0)) if named else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(known)
    sizes = sizes.withColumn("weight", weight)
    whole = sizes.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rate = F.coalesce(F.try_divide(F.col("weight"), F.lit(whole["weight"])) * F.lit(float(budget) * (whole["n"] or 0)) / F.col("n"), F.lit(0.0))
    return sizes.select("source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float = 1.0, seed: int = 0) -> DataFrame:
    """Replicate documents so that sources reach their target weights, in random order.

    A row with hash-seeded uniform number u gets k copies, k being the least
    count whose Poisson distribution function (mean: the rate of its source,
    see ``rates``) reaches u.  Copies are exploded, numbered ``copy`` from 0,
    and shuffled globally by a hash of id, copy and seed.  u depends on id and
    text, so rows alike in both draw the same u, also with null ids.  A null id
    hashes as itself; null texts are kept; an empty
    table gives an empty one.  Other columns go along; a column named copy is
    replaced.

    Rates above 700 are split into a sum of whole parts of at most 700 each,
    since exp(-rate) would vanish: every part draws a number of its own.
    """
    parts = F.ceil(F.col("rate") / 700).cast("int")
    table = rates(docs, weights, budget).withColumn("parts", F.greatest(parts, F.lit(1))).withColumn("part_rate", F.col("rate") / F.col("parts"))
    terms = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 40).cast("int")
    table = table.select(F.col("source").alias("of"), "parts", poisson_cdf(F.col("part_rate"), terms).alias("cdf"))
    rows = docs.drop("copy").select(F.struct("*").alias("row"), "doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    joined = rows.join(broadcast_if_small(table), F.col("source").eqNullSafe(F.col("of")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(F.lit(seed), F.col("doc_id"), F.col("digest"), i))
    count = F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("cdf"), lambda c: c < u)))
    kept = joined.select("row", "doc_id", "digest", count.alias("k")).filter("k > 0")
    copies = kept.select("row", "doc_id", "digest", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    placed = copies.select("row", "copy", F.xxhash64(F.lit(seed), "doc_id", "copy", "digest").alias("place"))
    return placed.repartition("place").sortWithinPartitions("place").select("row.*", "copy")
