"""Ratios, similarities and guards as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n/d with four decimals; zero where d is zero (MAT-01)."""
    return F.coalesce(F.round(F.try_divide(n, d), 4), F.lit(0.0))


def subsequence(actual: Column, expected: Column) -> Column:
    """Whether the characters of ``actual`` occur in this order in ``expected`` (MAT-05)."""
    step = lambda at, ch: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(F.call_function("locate", ch, expected, at + 1), F.lit(0)), F.lit(-1)))
    chars = F.filter(F.split(actual, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), step) >= 0


def character_coverage(expected: Column, actual: Column) -> Column:
    """Share of the distinct characters of ``expected`` that ``actual`` has (MAT-08)."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return safe_ratio(F.size(F.array_intersect(chars(expected), chars(actual))), F.size(chars(expected)))


def confidence(x: Column) -> Column:
    """A finite number from 0 to 1, else null (MAT-09)."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & d.between(0, 1), d)


def non_negative(x: Column) -> Column:
    """A finite number that isn't negative, else null (MAT-10)."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (d >= 0) & (d < float("inf")), d)


def overlap_over_smaller(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Intersection of two boxes over the smaller area (MAT-12)."""
    side = lambda a1, a2, b1, b2: F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0.0))
    area = lambda x1, y1, x2, y2: (x2 - x1) * (y2 - y1)
    return F.coalesce(F.try_divide(side(ax1, ax2, bx1, bx2) * side(ay1, ay2, by1, by2), F.least(area(ax1, ay1, ax2, ay2), area(bx1, by1, bx2, by2))), F.lit(0.0))


def strict_sum(x: Column) -> Column:
    """Aggregate: the sum, null if there is no row or any null (AGG-36)."""
    return F.when((F.count(F.lit(1)) == F.count(x)) & (F.count(x) > 0), F.sum(x))


def slope(y: Column, x: Column, over=lambda c: c) -> Column:
    """Aggregate: the least-squares slope of ``y`` over ``x``, null where ``x`` has one value only (AGG-31).

    Partial means of equal values differ by a rounding when they are merged, so
    whether ``x`` varies is not left to its variance.
    """
    own = F.when(y.isNotNull(), x)
    return F.when(over(F.min(own)) < over(F.max(own)), over(F.regr_slope(y, x)))


def slope_of_cents(y: Column, x: Column) -> Column:
    """Aggregate: ``slope`` by exact sums, for numbers of two decimals at most and below ten million; keys with others get ``slope``.

    Sums of doubles depend on the order of rows, and so does what a slope on a
    rounding edge is rounded to.
    """
    both = y.isNotNull() & x.isNotNull()
    fits = lambda c: (F.abs(c) < 1e7) & (F.round(c * 100) / 100 == c)
    exact = both & fits(y) & fits(x)
    a, b = (F.when(exact, F.round(c * 100)).cast("long") for c in (x, y))
    n, sum_a, sum_b, sum_ab, sum_aa = (c.cast("decimal(38,0)") for c in (F.count(a), F.sum(a), F.sum(b), F.sum((a * b).cast("decimal(19,0)")), F.sum((a * a).cast("decimal(19,0)"))))
    spread = n * sum_aa - sum_a * sum_a
    whole = F.when(spread > 0, (n * sum_ab - sum_a * sum_b).cast("double") / spread.cast("double"))
    return F.when(F.count(a) == F.count(F.when(both, 1)), whole).otherwise(slope(y, x))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine of two arrays of equal length."""
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
