"""Spelling variants: words one edit apart, found in a forward and a reversed dictionary.

Two words one edit apart keep a half intact: of the L code points of the
longer, they share the first or the last (L - 1) / 2.  The forward dictionary
is sorted by such leading halves, the reversed one by trailing halves, and a
merge join scans each range of equal halves.  A range of too many words is
subdivided: one edit leaves intact half of what its words don't yet share, at
its front or at its back, so each word goes to two narrower ranges.  At the
end, words differ in one place at most and a range has no more words than
there are letters.  A pair comes from one range only: the reversed dictionary
and every back range leave out pairs that the front range has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, broadcast_if_small, discard, materialize

RUN = "[a-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One code point is left out of every word whose hash this divides.
ONE_IN = 31
#: Ranges of more words are subdivided.
BLOCK = 128
_RANGE = ["length", "front", "back", "barred", "head", "tail"]


def dictionary(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """Words of at least ``least`` letters with their occurrences n, at least ``count``.

    A word is a run of letters, of which A-Z are lower-cased.  Where ``one_in``
    divides h, the crc32 of ``<doc_id>:<run>``, its code point h modulo its
    length is left out.  A null id counts as an empty text.
    """
    text = F.translate(F.coalesce("text", F.lit("")), ASCII_UPPER, ASCII_LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN}{{{least},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def _ranges(rows: DataFrame, shapes: Column) -> DataFrame:
    """A row for each range of a word; head and tail are what the range's words share."""
    shaped = rows.select("word", "n", F.explode(shapes).alias("s")).select("word", "n", "s.*")
    return shaped.withColumns({"head": F.substring("word", F.lit(1), F.col("front")), "tail": F.substring(F.col("word"), F.length("word") - F.col("back") + 1, F.col("back"))})


def _shape(length, front, back, barred) -> Column:
    return F.struct(length.cast("int").alias("length"), front.cast("int").alias("front"), back.cast("int").alias("back"), barred.cast("int").alias("barred"))


def _pairs(ranges: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, once each: word is the longer, or the smaller of two of one length."""
    a, b = ranges.filter(F.length("word") == F.col("length")), ranges.select(*_RANGE, F.col("word").alias("other"), F.col("n").alias("n_other"))
    fits = (F.length("other") < F.col("length")) | (F.col("word") < F.col("other"))
    apart = F.substring("word", F.lit(1), F.col("barred")) != F.substring("other", F.lit(1), F.col("barred"))
    near = F.levenshtein("word", "other", 1) == 1
    return a.hint("merge").join(b, _RANGE).filter(fits & apart & near).select("word", "n", "other", "n_other")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of different words of ``words`` (word, n) one insertion, deletion or replacement apart, once each.

    Returns word, n, other and n_other, materialized.
    """
    size = F.length("word")
    none = F.lit(2**31 - 1)  # nothing is barred: words always differ within so many letters
    of = lambda n: [_shape(n, F.ceil((n - 1) / 2), F.lit(0), none), _shape(n, F.lit(0), F.ceil((n - 1) / 2), F.ceil((n - 1) / 2))]
    ranges, found = materialize(_ranges(words, F.array(*of(size), *of(size + 1)))), []
    while True:
        large = materialize(ranges.groupBy(*_RANGE).agg(F.count("*").alias("held")).filter((F.col("held") > block) & (F.col("length") - F.col("front") - F.col("back") > 1)).drop("held"))
        if large.isEmpty():
            found.append(materialize(_pairs(ranges)))
            discard(ranges, large)
            break
        few = broadcast_if_small(large)
        found.append(materialize(_pairs(ranges.join(few, _RANGE, "left_anti"))))
        rest = F.col("length") - F.col("front") - F.col("back")
        more = F.ceil((rest - 1) / 2)
        front = F.when(F.col("front") + more < F.col("barred"), _shape(F.col("length"), F.col("front") + more, F.col("back"), F.col("barred")))
        back = _shape(F.col("length"), F.col("front"), F.col("back") + more, F.least("barred", F.col("front") + more))
        narrower = materialize(_ranges(ranges.join(few, _RANGE, "left_semi"), F.filter(F.array(front, back), F.isnotnull)))
        discard(ranges, large)
        ranges = narrower
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Every word of ``words`` (word, n) with its form, root, n_near and form_n.

    The form is the near word of largest n, the smallest in code-point order of
    equals, if its n is ``ratio`` times the word's at least, else null; the root
    is the last of the forms that follow from the word, itself if it has none.
    """
    words = materialize(words)
    pairs = near_pairs(words, block)
    both = pairs.select("word", F.col("other").alias("near"), F.col("n_other").alias("n")).union(pairs.select(F.col("other"), F.col("word"), F.col("n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best"))
    near = words.join(best, "word", "left")
    takes = -F.col("best.minus") >= ratio * F.col("n")
    formed = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")))
    # A form has ratio times the occurrences, which bounds the steps to a root; each round doubles those that are done.
    steps = math.log(max(2, formed.agg(F.max("n")).first()[0] or 2), max(2, ratio))
    roots = materialize(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(steps + 1)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        discard(roots)
        roots = further
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; repeated rows count again; an empty
    table gives an empty result; other columns are ignored.
    """
    return variants(dictionary(docs))
