"""Date and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, UNDECIDABLE, UNREAD


def strict_date(text: Column) -> Column:
    """The first 20yy date with - . / or 年月 between its parts; letters O count as zero; impossible dates are null (DAT-01)."""
    t = F.translate(text, "Oo", "00")
    pattern = r"(20[0-9]{2})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})"
    part = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(t.rlike(pattern), F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text with underscores for what is unknown (DAT-04)."""
    two = lambda c: F.coalesce(F.lpad(c.cast("string"), 2, "0"), F.lit("__"))
    return F.concat_ws("-", F.coalesce(F.lpad(year.cast("string"), 4, "0"), F.lit("____")), two(month), two(day))


def compare_dates(required: Column, actual: Column) -> tuple[Column, Column]:
    """Status and days late (negative: early): no requirement is undecidable before an unread date is unread (DAT-06)."""
    days = F.datediff(actual, required)
    status = F.when(required.isNull(), UNDECIDABLE).when(actual.isNull(), UNREAD).when(days == 0, MATCH).otherwise(MISMATCH)
    return status, F.when(required.isNotNull() & actual.isNotNull(), days)


def day_bucket(iso: Column) -> Column:
    """The writer's own day of an ISO text (DAT-10)."""
    return F.substring(iso, 1, 10)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with four decimals; null unless both are known and the end isn't earlier (DAT-12)."""
    d = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.when(d >= 0, F.round(d, 4))


def is_iso_date(text: Column) -> Column:
    """Whether the text is a real date in ISO form (DAT-14)."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def _dated(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _year_and_month(digits: Column, year: Column) -> Column:
    """The month at the end of digits that begin with two to four of the year's; null unless there is exactly one reading."""
    rests = [F.when(F.startswith(digits, F.left(year, F.lit(n))), F.substring(digits, n + 1, 9)) for n in (4, 3, 2)]
    fit = [F.when(F.length(r).between(1, 2), r.try_cast("int")) for r in rests]
    months = F.array_distinct(F.filter(F.array(*fit), lambda m: m.between(1, 12)))
    return F.when(F.size(months) == 1, months[0])


def receipt_date(text: Column, required: Column) -> Column:
    """The date of a reading that may lack parts (DAT-02).

    A whole date counts as it is.  One without a separator after the year
    counts too.  Otherwise the year, and the month if no digit stands before
    its sign, come from the required date; a damaged year must begin as the
    required one does.  Any other year than the required one gives null.
    """
    whole, year = strict_date(text), F.year(required)
    same_year = lambda d: F.when(required.isNull() | (F.year(d) == year), d)
    t = F.regexp_replace(F.translate(text, "Oo", "00"), r"(?U)\s", "")
    joined = r"(?<![0-9])(20[0-9]{2})年?([01]?[0-9])月[^0-9]{0,2}([0-3]?[0-9])日"
    explicit = F.nullif(F.regexp_extract(t, "(?<![0-9])([0-9]{4})年", 1), F.lit(""))
    ended = F.regexp_replace(t, "(?<=[0-9])[司曰目可「口Tt丁川]$", "日")  # signs that are misread for the last one
    ended = F.when(~F.contains(ended, F.lit("日")) & ended.rlike("年[^0-9]{0,2}[0-9]{1,2}月[^0-9]{0,2}[0-9]{1,2}$"), F.concat(ended, F.lit("日"))).otherwise(ended)
    rest = "([0-9]*)月[^0-9]{0,2}([0-9]{1,2})日"
    before, day = F.regexp_extract(ended, rest, 1), F.nullif(F.regexp_extract(ended, rest, 2), F.lit(""))
    month = F.when(before == "", F.month(required)).when(F.length(before) <= 2, before.try_cast("int")).otherwise(_year_and_month(before, year.cast("string")))
    return (
        F.when(whole.isNotNull(), same_year(whole))
        .when(t.rlike(joined), same_year(_dated(F.regexp_extract(t, joined, 1), F.regexp_extract(t, joined, 2), F.regexp_extract(t, joined, 3))))
        .when(required.isNull() | (explicit.cast("int") != year) | t.rlike("(?<![0-9])[0-9]{5,}年"), None)
        .otherwise(_dated(year, month, day))
    )


def partial_conflicts(required: Column, year: Column, month: Column, day: Column) -> tuple[Column, Column]:
    """Names of the components that are missing, and of those that differ from the required date (DAT-05)."""
    parts = (("年", year, F.year(required)), ("月", month, F.month(required)), ("日", day, F.day(required)))
    named = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return named([(n, c.isNull()) for n, c, _ in parts]), named([(n, c != r) for n, c, r in parts])


def loose_date(text: Column) -> Column:
    """A text that is nothing but year, month and day as ISO date, any other as it is (DAT-08)."""
    pattern = "^([0-9]{4})[-./年]([0-9]{1,2})[-./月]([0-9]{1,2})日?$"
    t = F.trim(text)
    found = _dated(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3))
    return F.coalesce(F.when(t.rlike(pattern), found.cast("string")), text)


def instant(text: Column) -> Column:
    """An ISO time that names its offset; one without is null (DAT-09)."""
    return F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def deadline(submitted: Column, seconds: int) -> Column:
    """When waiting ends (DAT-13)."""
    return submitted + F.make_dt_interval(secs=F.lit(seconds))
