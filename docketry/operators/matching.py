"""Matching policies, name correction and joint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CORRECT, ERROR, FAILED, MATCH, MISMATCH, PARTIAL, PASS, REVIEW, UNREAD, WAITING, WRONG
from .decision import strict_status

# Order of statuses, best last.
STATUS_RANK = {MISMATCH: 1, PARTIAL: 2, MATCH: 3}


def status_rank(status: Column, mismatch_over_partial: bool = False) -> Column:
    """Rank of a comparison: match, then part, then mismatch; the last two may swap; all others are zero (WIN-09, WIN-14)."""
    swap = {MISMATCH: PARTIAL, PARTIAL: MISMATCH} if mismatch_over_partial else {}
    rank = F.lit(0)
    for s, n in STATUS_RANK.items():
        rank = F.when(status == swap.get(s, s), n).otherwise(rank)
    return rank


def best_candidate(candidates: DataFrame, keys: list[str], expected: str, actual: str, position: str) -> DataFrame:
    """The candidate of each key that compares best with the requirement, the first of equals (MCH-01, WIN-09, WIN-16)."""
    status = strict_status(F.col(expected), F.col(actual))
    order = F.struct(status_rank(status).alias("r"), (-F.levenshtein(expected, actual)).alias("d"), (-F.col(position)).alias("p"))
    best = candidates.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), status.alias("status"), F.col(actual).alias("reading"))).alias("b"))
    return best.select(*keys, "b.reading", "b.status")


def zero_letter_match(expected: Column, actual: Column, first: Column, length: Column) -> Column:
    """Equal but for 0 and O inside the span of the code (MCH-09)."""
    fold = lambda c: F.concat(F.substring(c, F.lit(1), first - 1), F.translate(F.substring(c, first, length), "O", "0"), F.substring(c, first + length, F.length(c)))
    return (F.length(expected) == F.length(actual)) & (expected != actual) & (fold(expected) == fold(actual))


def extra_dot(expected: Column, actual: Column, after: Column) -> Column:
    """One dot more than expected, right after the code's letters, and nothing else (MCH-10)."""
    inside = F.substring(actual, after + 1, F.lit(1))
    return (F.length(actual) == F.length(expected) + 1) & inside.isin(".", "·") & (F.concat(F.substring(actual, F.lit(1), after), F.substring(actual, after + 2, F.length(actual))) == expected)


def is_rotation(a: Column, b: Column) -> Column:
    """Whether a ring text is another read from a different start (MCH-12, MCH-13)."""
    return (F.length(a) == F.length(b)) & F.contains(F.concat(b, b), a)


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)


def correct_names(readings: DataFrame, names: DataFrame, reading: str, name: str, most: int = 2, share: float = 0.85) -> DataFrame:
    """Add ``corrected`` and ``edits``: the registered name within ``most`` edits, of the same digit groups (MCH-14, MAT-07).

    Names equally near reject each other, and so does a similarity below
    ``share``.  A name cut into most + 1 parts keeps one of them in any reading
    within ``most`` edits, moved by ``most`` at the most; so an equi-join on
    parts finds all candidates, without comparing everything with everything.
    """
    n = names.select(F.col(name).alias("name")).distinct().withColumn("len", F.length("name"))
    size = F.greatest(F.floor(F.col("len") / (most + 1)), F.lit(1)).cast("int")
    cut = [F.struct(F.col("len"), F.lit(i).alias("i"), F.substring(F.col("name"), F.lit(1) + size * i, size).alias("part")) for i in range(most + 1)]
    keyed = n.select("name", F.explode(F.array(*cut)).alias("k"))
    r = readings.select(F.col(reading).alias("reading")).filter(F.col("reading").isNotNull()).distinct()
    lengths = F.sequence(F.greatest(F.length("reading") - most, F.lit(1)), F.length("reading") + most)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i in range(most + 1) for d in range(-most, most + 1)])
    tried = r.select("reading", F.explode(lengths).alias("len")).withColumn("size", F.greatest(F.floor(F.col("len") / (most + 1)), F.lit(1)).cast("int")).select("reading", "len", "size", F.explode(places).alias("p"))
    at = F.col("size") * F.col("p.i") + F.col("p.d") + 1
    wanted = tried.filter(at >= 1).select("reading", F.struct("len", F.col("p.i").alias("i"), F.substring(F.col("reading"), at, F.col("size")).alias("part")).alias("k")).distinct()
    pairs = wanted.join(keyed, "k").select("reading", "name").distinct().withColumn("d", F.levenshtein("reading", "name", most)).filter("d >= 0").filter(digit_groups(F.col("reading")) == digit_groups(F.col("name")))
    ok = 1 - F.col("d") / F.greatest(F.length("reading"), F.length("name")) >= share
    best = pairs.filter(ok).groupBy("reading").agg(F.min(F.struct("d", "name")).alias("b"), F.sort_array(F.collect_list("d")).alias("all"))
    sure = best.filter((F.size("all") == 1) | (F.try_element_at("all", F.lit(2)) > F.col("b.d"))).select(F.col("reading").alias(reading), F.col("b.name").alias("corrected"), F.col("b.d").alias("edits"))
    return readings.join(sure, reading, "left")


def signature(receiver: Column, contacts: Column) -> Column:
    """Whether the receiver is one of the contacts, white space aside (MCH-25)."""
    tight = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    r = tight(F.coalesce(receiver, F.lit("")))
    return F.when(r == "", UNREAD).when(F.array_contains(F.transform(contacts, tight), r), MATCH).otherwise(MISMATCH)


def joint_standard(candidates: DataFrame, keys: list[str], text_ok: Column, shape_ok: Column) -> DataFrame:
    """Whether any one candidate has both the standard's text and its shape (MCH-28)."""
    both = F.coalesce(text_ok & shape_ok, F.lit(False))
    return candidates.groupBy(*keys).agg(F.bool_or(both).alias("both"), F.bool_or(F.coalesce(text_ok, F.lit(False))).alias("text"), F.bool_or(F.coalesce(shape_ok, F.lit(False))).alias("shape"))


def pending_verdict(verdict: Column, waiting: Column, needs_remote: Column) -> Column:
    """Waits for a remote result unless the verdict is a pass that needs none (MCH-30)."""
    return F.when(waiting & ((verdict != PASS) | needs_remote), WAITING).otherwise(verdict)


def final_verdict(verdict: Column, failed: Column, low: Column) -> Column:
    """Failed providers before all, then low confidence, then the verdict (MCH-31)."""
    return F.when(F.coalesce(failed, F.lit(False)), FAILED).when(F.coalesce(low, F.lit(False)), REVIEW).otherwise(verdict)


def region_role(x: Column, y: Column) -> Column:
    """Stamps in the right half or the lower part are the customer's, others the shipper's (MCH-47)."""
    return F.when((x >= 0.5) | (y >= 0.62), "customer").otherwise("shipping")


# Names of the filters.
def statistics_filters(state: Column, decision: Column, expected: Column) -> dict[str, Column]:
    """Conditions on one seal cell by the name of the filter (FLT-12)."""
    wrong = state == WRONG
    return {
        "errors": state.isin(WRONG, UNREAD, ERROR), "missing": state.isin(UNREAD, ERROR), "failed": state == ERROR, "wrong": wrong, "unrecognized": state == UNREAD, "pending_truth": expected.isNull(),
        "false_accept": wrong & (expected == MISMATCH) & (decision == MATCH), "false_reject": wrong & (expected == MATCH) & (decision == MISMATCH), "partial": wrong & (decision == PARTIAL), "correct": state == CORRECT,
    }


def newest_outcomes(history: DataFrame, keys: list[str], eligible: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The newest outcome of each slot, empty or failed ones too, of rows that are eligible (REC-11)."""
    return history.filter(eligible).groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("o"), *columns)).alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def combine_traces(calls: DataFrame, keys: list[str], start: str, end: str, seconds: str, branches: int) -> DataFrame:
    """One wall range per key; sums only where no part lacks its own, totals only if all branches are there (REC-10, TIM-10)."""
    known = F.count(F.lit(1)) == F.count(seconds)
    return calls.groupBy(*keys).agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.when(known, F.sum(seconds)).alias("sum"), F.when(F.count(end) == F.count(F.lit(1)), F.max(end) - F.min(start)).alias("wall"), (F.count_distinct("branch") >= branches).alias("complete")
    )


def fingerprint(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """A digest of a key's rows, whatever their order (AGG-44): the digests of equal multisets are equal, those of others differ.

    It is the digest of all rows' digests in order, so a key's digests, not its rows, are gathered.
    """
    line = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("digest"))
