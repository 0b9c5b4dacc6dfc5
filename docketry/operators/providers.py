"""Readings of several providers: which can be used, field by field choice, stamps of several channels, samples' decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PARTIAL, REVIEW, UNCONFIRMED
from ..functions.text import fold_width, seal_key
from .arbitration import choose
from .decision import strict_status
from .matching import status_rank

# States of evidence that isn't there, modes that are none, fields by their format, policies.
INACTIVE = (
    "failed", "error", "skipped", "pending", "waiting", "running", "submitted", "queued", "uploading", "submitting", "polling", "paused", "not_run", "not_executed", "unexecuted", "cancelled", "canceled",
    "未执行", "未运行", "识别失败", "运行失败", "待识别", "识别中", "测试中",
)
UNREAL_MODES = ("mock", "simulated", "demo")
CONTACTS, DUE, QUANTITIES = "仓库联系人", "要求到货", ("实收数量", "拒收数量", "合计数量")
DECISIONS = (MATCH, PARTIAL, MISMATCH)
POLICIES = {"danzhengtong_exact": "danzhengtong", "qingtong_exact": "qingtong"}
_DATE = r"^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?$"
_NUMBER = r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$"


def inactive(error: Column, simulated: Column, pending: Column, mode: Column, status: Column, execution: Column) -> Column:
    """Whether evidence failed, is made up, or isn't there yet (FLT-14)."""
    true = lambda c: F.coalesce(c, F.lit(False))
    off = lambda c: F.coalesce(F.lower(c).isin(*INACTIVE), F.lit(False))
    return (F.coalesce(error, F.lit("")) != "") | true(simulated) | true(pending) | true(mode.isin(*UNREAL_MODES)) | off(status) | off(execution)


def _iso(text: Column) -> Column:
    part = lambda i, n: F.lpad(F.regexp_extract(text, _DATE, i), n, "0")
    return F.when(text.rlike(_DATE), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd").cast("string"))


def _plain_number(text: Column) -> Column:
    digits = F.replace(text, F.lit(","), F.lit(""))
    whole, rest = F.regexp_replace(F.regexp_extract(digits, "^([0-9]+)", 1), "^0+(?=[0-9])", ""), F.regexp_replace(F.regexp_extract(digits, "([.][0-9]+)$", 1), "[.]?0+$", "")
    return F.when(text.rlike(_NUMBER), F.concat(whole, rest))


def canonical_field(field: Column, value: Column) -> Column:
    """A printed value in the form in which equal ones are equal: widths folded, no white space, dates as ISO, numbers without padding, names joined (STR-11)."""
    text = F.regexp_replace(fold_width(F.coalesce(value, F.lit(""))), r"(?U)\s+", "")
    names = F.array_join(F.filter(F.split(text, "[、,/;|]+"), lambda x: x != ""), "、")
    return F.when(field == CONTACTS, names).when(field == DUE, F.coalesce(_iso(text), text)).when(field.isin(*QUANTITIES), F.coalesce(_plain_number(text), text)).otherwise(text)


def valid_format(field: Column, canonical: Column) -> Column:
    return F.when(field == DUE, _iso(canonical).isNotNull()).when(field.isin(*QUANTITIES), _plain_number(canonical).isNotNull()).otherwise(F.lit(True))


def select_fields(readings: DataFrame, keys: list[str], preferred: str | None = None, printed: bool = True) -> DataFrame:
    """Each field's value from all usable readings: field, value (as read), method, rule and disputed (MCH-20, MCH-22).

    ``readings`` has the keys, field, pos (unique in a field), method, provider,
    value, conf, low, known (the value that conf and low belong to, null: this
    one) and inactive.  Printed fields are compared in canonical form, and
    readings of a valid format go before others, whose choice is flagged by the
    rule ``format``; handwriting is compared without white space.
    """
    form = (lambda c: canonical_field(F.col("field"), c)) if printed else (lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    own = readings.filter(~F.coalesce("inactive", F.lit(False)) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    told = own.withColumns({"raw": F.trim("value"), "form": form(F.col("value"))}).withColumn("__mine", F.col("known").isNull() | (form(F.col("known")) == F.col("form")))
    told = told.withColumns({"conf": F.when(F.col("__mine"), F.col("conf")), "low": F.when(F.col("__mine"), F.col("low")), "valid": valid_format(F.col("field"), F.col("form")) if printed else F.lit(True)})
    some = told.groupBy(*keys, "field").agg(F.bool_or("valid").alias("__some"))
    usable = told.join(some, [*keys, "field"]).filter(F.col("valid") | ~F.col("__some"))
    chosen = choose(usable.select(*keys, "field", "pos", F.col("form").alias("value"), "method", "provider", "conf", "low"), [*keys, "field"], preferred, with_pos=True).drop("value")
    return chosen.join(usable.select(*keys, "field", "pos", "raw", "method", "valid"), [*keys, "field", "pos"]).select(*keys, "field", F.col("raw").alias("value"), "method", F.when(F.col("valid"), F.col("rule")).otherwise("format").alias("rule"), "disputed")


def combine_channels(checks: DataFrame, keys: list[str], policy: str = "any_exact", match_mode: str = "any") -> DataFrame:
    """One stamp check per key from its channels' (MCH-24, WIN-15): source, recognized, status, reliable and all readings.

    ``checks`` has the keys, pos, provider, source, recognized, status,
    coverage, similarity, reliable and simulated.  The best comparison wins (the
    preferred provider's, if the policy names one that is there), the first of
    equals; simulated and empty readings never rank.  In the mode ``all`` one
    channel that doesn't match reliably makes a match partial and the whole
    unreliable; else a match is as reliable as the winner, and a mismatch only
    if all channels are reliable.
    """
    real = ~F.coalesce("simulated", F.lit(False))
    sure = F.coalesce("reliable", F.lit(False)) & real
    usable = (seal_key(F.col("recognized")) != "") & real & F.coalesce(F.col("status").isin(*DECISIONS), F.lit(False))
    wanted = F.col("provider") == POLICIES[policy] if policy in POLICIES else F.lit(True)
    rank = F.struct(
        F.coalesce(wanted, F.lit(False)).alias("w"), F.when(usable, status_rank(F.col("status"))).otherwise(0).alias("r"), F.coalesce("coverage", F.lit(0.0)).alias("c"), F.coalesce("similarity", F.lit(0.0)).alias("s"), (-F.col("pos")).alias("p")
    )
    fits = sure & F.coalesce(F.col("status") == MATCH, F.lit(False))
    best = checks.groupBy(*keys).agg(
        F.max_by(F.struct("source", "recognized", "status", F.coalesce("reliable", F.lit(False)).alias("reliable"), real.alias("real")), rank).alias("b"), F.bool_and(fits).alias("every"), F.bool_or(fits).alias("one"), F.bool_and(sure).alias("firm"),
        F.array_sort(F.collect_list(F.when(F.coalesce("recognized", F.lit("")) != "", F.struct("pos", "recognized")))).alias("read"),
    )
    status = F.col("b.status")
    if match_mode == "all":
        shown = F.when(~F.col("every") & F.col("one"), PARTIAL).otherwise(status)
        own = F.when(~F.col("every"), False)
    else:
        shown, own = status, F.lit(None).cast("boolean")
    reliable = F.coalesce(own, F.when(status == MATCH, F.col("b.reliable") & F.col("b.real")).otherwise((status == MISMATCH) & F.col("firm")), F.lit(False))
    return best.select(*keys, F.col("b.source").alias("source"), F.col("b.recognized").alias("recognized"), shown.alias("status"), reliable.alias("reliable"), F.array_distinct(F.transform("read", lambda x: x["recognized"])).alias("all_recognized"))


def sample_decision(status: Column, human: Column, blocked: Column, adjusted: Column, requirement: Column, value: Column) -> Column:
    """A sample's decision, always match, part or mismatch (MCH-27).

    A person's word goes first, then a code policy that makes the texts equal
    (``adjusted``), the check's own status, a match that awaits confirmation,
    no reading, and at last the strict comparison.  A blocked check (a
    candidate that wasn't adopted, a shape that wasn't proven) is no match.
    """
    blocked, text = F.coalesce(blocked, F.lit(False)), F.trim(F.coalesce(value, F.lit("")))
    strict = strict_status(seal_key(requirement), seal_key(text))
    held = lambda s: F.when(blocked & (s == MATCH), PARTIAL).otherwise(s)
    return (
        F.when(human.isNotNull(), F.when(human, MATCH).otherwise(MISMATCH)).when(F.coalesce(adjusted, F.lit(False)) & ~blocked & status.isin(*DECISIONS, "待确认", UNCONFIRMED, REVIEW), MATCH)
        .when(status.isin(*DECISIONS), held(status)).when(status == UNCONFIRMED, F.when(blocked, PARTIAL).otherwise(MATCH)).when(text == "", MISMATCH)
        .when((F.coalesce(requirement, F.lit("")) != "") & strict.isin(*DECISIONS), held(strict)).otherwise(PARTIAL)
    )
