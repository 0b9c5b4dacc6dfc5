"""Three-valued checks and the overall verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, PARTIAL, PASS, REJECT, REVIEW, UNCONFIRMED, UNDECIDABLE, UNREAD
from ..functions.measures import subsequence


def strict_status(expected: Column, actual: Column) -> Column:
    """Undecidable without a requirement, unread without a reading; then equal, ordered part, or mismatch."""
    e, a = F.coalesce(expected, F.lit("")), F.coalesce(actual, F.lit(""))
    return F.when(e == "", UNDECIDABLE).when(a == "", UNREAD).when(e == a, MATCH).when((F.length(a) < F.length(e)) & subsequence(a, e), PARTIAL).otherwise(MISMATCH)


def is_reliable(status: Column) -> Column:
    return status.isin(MATCH, MISMATCH)


def shown_status(status: Column, reliable: Column) -> Column:
    """The status that filters see: none is unread, an unreliable match awaits confirmation (FLT-05)."""
    s = F.coalesce(F.nullif(status, F.lit("")), F.lit(UNREAD))
    return F.when((s == MATCH) & ~F.coalesce(reliable, F.lit(False)), UNCONFIRMED).otherwise(s)


@dataclass(frozen=True)
class Policy:
    """Which checks count, and when a mismatch rejects: none, any_mismatch or all_mismatch."""

    date: bool = True
    seal: bool = True
    signature: bool = False
    reject: str = "any_mismatch"


@dataclass(frozen=True)
class Check:
    status: Column
    reliable: Column


def verdict(policy: Policy, date: Check, seal: Check, signature: Check | None = None, has_issue: Column | None = None) -> Column:
    """Issues or unreliable checks need review; mismatches reject as the policy says; all matches pass (MCH-29)."""
    checks = [c for on, c in ((policy.date, date), (policy.seal, seal), (policy.signature, signature)) if on and c is not None]
    issue = F.coalesce(has_issue, F.lit(False)) if has_issue is not None else F.lit(False)
    every = lambda f: _all([f(c) for c in checks])
    some = lambda f: ~_all([~f(c) for c in checks])
    reliable = every(lambda c: F.coalesce(c.reliable, F.lit(False)))
    wrong = lambda c: F.coalesce(c.status == MISMATCH, F.lit(False))
    rejects = F.lit(policy.reject == "any_mismatch") | (F.lit(policy.reject == "all_mismatch") & every(wrong))
    matched = every(lambda c: F.coalesce(c.status == MATCH, F.lit(False)))
    return F.when(issue | ~reliable, REVIEW).when(some(wrong), F.when(rejects, REJECT).otherwise(REVIEW)).when(matched, PASS).otherwise(REVIEW)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
