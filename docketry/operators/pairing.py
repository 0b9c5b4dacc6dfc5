"""Greedy pairing: every element has one partner at most, and better pairs come first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Held
from .matching import region_role


def greedy_pairs(edges: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """The pairs that are taken if edges are gone through in ascending ``order`` and each takes its ends if both are free (JOIN-26).

    ``order`` needs not tell all edges apart: ties go to the smaller ends.  Both
    ends must be of one type; repeated edges count once.  Instead of going
    through them one by one, each round takes all edges that are the first of
    both their ends, and drops what these ends touch: the same pairs, after as
    many rounds as the longest chain of edges each of which waits for the next.
    """
    rank = F.struct(*[F.col(c) for c in order], F.least(a, b).alias("__low"), F.greatest(a, b).alias("__high"))
    # Held until the application ends: the result reads the edges again, and their making may be a long way.
    every_edge = left = Held(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).withColumn("__rank", rank))
    taken: list[Held] = []
    while not left.rows.isEmpty():
        ends = left.rows.select(F.explode(F.array(a, b)).alias("__end"), "__rank").groupBy("__end").agg(F.min("__rank").alias("__first"))
        # An edge that is the first of both its ends is that of two ends.
        firsts = Held(ends.groupBy(F.col("__first").alias("__rank")).agg(F.count("*").alias("__n")).filter("__n = 2").select("__rank"))
        taken.append(firsts)
        gone = firsts.rows.select(F.explode(F.array("__rank.__low", "__rank.__high")).alias("__end"))
        rest = left.rows.join(gone.withColumnRenamed("__end", a), a, "left_anti").join(gone.withColumnRenamed("__end", b), b, "left_anti")
        further = Held(rest.select(*left.rows.columns))
        if left is not every_edge:
            left.drop()
        left = further
    if not taken:
        return every_edge.rows.drop("__rank")
    every = taken[0].rows
    for t in taken[1:]:
        every = every.union(t.rows)
    return every_edge.rows.join(every, "__rank", "left_semi").drop("__rank").dropDuplicates([a, b])


def greedy_pairs_within(edges: DataFrame, group: str, a: str, b: str, order: list[str], columns: list[str]) -> DataFrame:
    """``greedy_pairs`` where no edge leaves its group (a page): one shuffle and one pass over each group's edges in order.

    Returns the group, both ends and ``columns``.  A group's ends are held
    while it is passed, so groups must be small.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, set()
        for batch in batches:
            out = []
            for i, (key, one, other) in enumerate(zip(batch[group], batch[a], batch[b])):
                if key != at:
                    at, used = key, set()
                if one not in used and other not in used:
                    used.update((one, other))
                    out.append(i)
            yield batch.iloc[out]

    known = edges.filter(F.col(group).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    ordered = known.repartition(F.xxhash64(group)).sortWithinPartitions(group, *order, F.least(a, b), F.greatest(a, b)).select(group, a, b, *columns)
    return ordered.mapInPandas(take, ordered.schema)


# When two regions are halves of one round stamp, and how far their union is widened.
HALF_WIDTH, HALF_HEIGHT = (0.09, 0.24), (0.065, 0.15)
WIDTHS_ALIKE, HEIGHTS_ALIKE, SIDE_BY_SIDE, CENTRES_ACROSS = 0.88, 0.80, 0.82, 0.15
CENTRES_DOWN, COMMON_HEIGHT = (0.48, 0.78), (0.20, 0.55)
# The measures of a region that its other half takes over.
BOX = ("x", "y", "width", "height", "pixel_ratio")
PAD_X, PAD_X_AT_EDGE, EDGE, PAD_Y = 0.018, 0.04, 0.90, 0.010


def _common(x: str, size: str) -> Column:
    a, b, n, m = F.col(f"a.{x}"), F.col(f"b.{x}"), F.col(f"a.{size}"), F.col(f"b.{size}")
    return F.greatest(F.lit(0.0), F.least(a + n, b + m) - F.greatest(a, b)) / F.greatest(F.lit(1e-9), F.least(n, m))


def _apart(x: str, size: str) -> Column:
    a, b, n, m = F.col(f"a.{x}"), F.col(f"b.{x}"), F.col(f"a.{size}"), F.col(f"b.{size}")
    return F.abs(a + n / 2 - b - m / 2) / F.greatest(n, m)


def _alike(size: str) -> Column:
    return F.least(f"a.{size}", f"b.{size}") / F.greatest(f"a.{size}", f"b.{size}")


def halves(regions: DataFrame, page: str, id_: str) -> DataFrame:
    """Pairs of regions on a page that may be halves of one stamp: page, first, second, score, their places and the second's measures.

    Regions have x, y, width, height (shares of the page), color and role; the
    first of a pair is the one that begins higher, then further left.
    """
    place = F.struct("y", "x", id_)
    r = regions.withColumn("__place", place)
    a, b = r.alias("a"), r.alias("b")
    within = lambda c, bounds: c.between(*bounds)
    fits = (
        (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.color") == F.col("b.color")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.__place") < F.col("b.__place"))
        & within(F.col("a.width"), HALF_WIDTH) & within(F.col("b.width"), HALF_WIDTH) & within(F.col("a.height"), HALF_HEIGHT) & within(F.col("b.height"), HALF_HEIGHT)
        & (_alike("width") >= WIDTHS_ALIKE) & (_alike("height") >= HEIGHTS_ALIKE) & (_common("x", "width") >= SIDE_BY_SIDE) & (_apart("x", "width") <= CENTRES_ACROSS)
        & within(_apart("y", "height"), CENTRES_DOWN) & within(_common("y", "height"), COMMON_HEIGHT)
    )
    score = _common("x", "width") + _alike("width") + _alike("height") - _apart("x", "width")
    return a.join(b, fits).select(F.col(f"a.{page}").alias(page), F.col(f"a.{id_}").alias("first"), F.col(f"b.{id_}").alias("second"), score.alias("score"), F.col("a.__place").alias("place"), F.col("b.__place").alias("after"), *[F.col(f"b.{c}").alias(f"__{c}") for c in BOX])


def join_halves(regions: DataFrame, page: str, id_: str) -> DataFrame:
    """Regions with the halves of a stamp as one, which keeps the first one's id and colour and covers both, widened.

    The first in reading order takes the best later half that is free, ties by
    place.  ``id_`` tells regions apart across pages.
    """
    measures = [f"__{c}" for c in BOX]
    pairs = greedy_pairs_within(halves(regions, page, id_).withColumn("worse", -F.col("score")), page, "first", "second", ["place", "worse", "after"], measures)
    # A pair's row stands for both ends, so regions are joined once: the first gets the second's measures, the second goes.
    ends = pairs.select(F.col(page).alias("__page"), F.explode(F.array("first", "second")).alias("__id"), "first", "second", *measures)
    joined = regions.join(ends, (F.col(page) == F.col("__page")) & (F.col(id_) == F.col("__id")), "left").filter(F.col("__id").isNull() | (F.col("__id") == F.col("first")))
    two = F.col("second").isNotNull()
    left, top = F.least("x", "__x"), F.least("y", "__y")
    right, bottom = F.greatest(F.col("x") + F.col("width"), F.col("__x") + F.col("__width")), F.greatest(F.col("y") + F.col("height"), F.col("__y") + F.col("__height"))
    pad = F.when(right >= EDGE, PAD_X_AT_EDGE).otherwise(PAD_X)
    box = {"left": F.greatest(F.lit(0.0), left - pad), "top": F.greatest(F.lit(0.0), top - PAD_Y), "right": F.least(F.lit(1.0), right + pad), "bottom": F.least(F.lit(1.0), bottom + PAD_Y)}
    wide = joined.withColumns({f"__{k}": v for k, v in box.items()})
    return wide.select(
        page, id_, F.when(two, F.col("__left")).otherwise(F.col("x")).alias("x"), F.when(two, F.col("__top")).otherwise(F.col("y")).alias("y"),
        F.when(two, F.col("__right") - F.col("__left")).otherwise(F.col("width")).alias("width"), F.when(two, F.col("__bottom") - F.col("__top")).otherwise(F.col("height")).alias("height"), "color",
        F.when(two, region_role((F.col("__left") + F.col("__right")) / 2, (F.col("__top") + F.col("__bottom")) / 2)).otherwise(F.col("role")).alias("role"),
        F.when(two, F.round(F.greatest("pixel_ratio", "__pixel_ratio"), 4)).otherwise(F.col("pixel_ratio")).alias("pixel_ratio"), F.when(two, F.col("second")).alias("joined"),
    )
