"""Line deduplication by a fixed-depth log-template tree.

A line's words are masked (those with digits become a wildcard).  The tree's
levels are the number of words and the leading words.  Within a leaf, a word's
support at a position is the number of different lines that have it there; a
line's template keeps its best supported words and has wildcards at the 1 -
SIMILARITY share of positions with the least support, which is where the lines
of a leaf vary.  Supports are counted by position, so a leaf is never gathered,
however many lines it has, and its size changes no rule.  Templates that recur
across documents are dropped from all documents but the first, and so are long
lines that two documents share unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, doc_key, materialize

MIN_DOCS = 3
#: Lines of so many words or more that are alike to the digit recur from two documents on.
LONG_WORDS = 10
MIN_WORDS = 3
LEADING = 3
#: Share of a line's positions that its template keeps.
SIMILARITY = 0.7
WILDCARD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def _hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\n".join(words)) - (1 << 63)


def parse(line: bytes) -> tuple[list[bytes], list[bytes]] | None:
    """The words of a line as they are and masked; None for lines too short or variable to judge.

    Words are parted by the six ASCII white-space characters; digits are 0 to 9.
    """
    own = masked = line.split()
    if _DIGIT.search(line):
        masked = [WILDCARD if _DIGIT.search(w) else w for w in own]
    if len(own) < MIN_WORDS or masked.count(WILDCARD) * 2 > len(own):
        return None
    return own, masked


def _parsed(docs: DataFrame, with_words: bool) -> DataFrame:
    """One row for each judged line: k1, k2, at (its index in the text), leaf, line (hash of the masked words) and own (hash of the words of long lines).

    With words instead one row for each different masked line of a document: line and its words.
    """
    names = ["line", "words"] if with_words else ["k1", "k2", "at", "leaf", "line", "own"]
    kinds = [pa.int64(), pa.binary()] if with_words else [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]

            def put(*values) -> None:
                for col, value in zip(cols, values):
                    col.append(value)

            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
                seen = set()
                for at, raw in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if not (p := parse(raw)):
                        continue
                    own, masked = p
                    line = _hash(masked)
                    if not with_words:
                        put(k1, k2, at, _hash([b"%d" % len(masked), *masked[:LEADING]]), line, _hash(own) if len(own) >= LONG_WORDS else None)
                    elif line not in seen:
                        seen.add(line)
                        put(line, b"\n".join(masked))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    schema = "line long, words binary" if with_words else "k1 long, k2 long, at int, leaf long, line long, own long"
    return docs.select(*doc_key(), "text").mapInArrow(run, schema)


def _template(places: Column, similarity: float) -> Column:
    """Hash of a line's words with wildcards at its least supported positions; ``places`` has (support, at, word) of each."""
    allowed = F.floor(F.size(places) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    least = F.array_sort(F.transform(places, lambda p: F.struct(p["support"], -p["at"])))
    last = F.when(allowed > 0, F.element_at(least, F.greatest(allowed, F.lit(1))))
    in_order = F.array_sort(F.transform(places, lambda p: F.struct(p["at"], p["support"], p["word"])))
    dropped = lambda p, v: F.coalesce(F.struct(p["support"], -p["at"]) <= v["last"], F.lit(False))
    # Bound as a lambda's variable, the least supported places are sorted once and not again for every word.
    made = F.transform(
        F.array(F.struct(in_order.alias("places"), last.alias("last"))),
        lambda v: F.xxhash64(F.transform(v["places"], lambda p: F.when(dropped(p, v), F.lit(WILDCARD)).otherwise(p["word"]))),
    )
    return F.get(made, 0)


def templates(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Columns line and template of the lines whose leaves hold ``min_docs`` lines or more.

    A word's support at a position is the number of different lines of the leaf
    with that word there.  A template has wildcards at floor((1 - similarity) *
    words) positions, those of the least support, the later ones of equals, so
    never the leading words.  A line that is alone in its leaf is a template by itself.
    """
    known = materialize(lines.groupBy("leaf", "line").agg(F.count("*").alias("n")))
    busy = known.groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("m")).filter(F.col("all") >= min_docs)
    placed = materialize(known.join(broadcast_if_small(busy), "leaf").select("leaf", "line", "m"))
    discard(known)
    several = materialize(placed.filter("m > 1").select("leaf", "line"))
    words = materialize(_parsed(docs, True).join(broadcast_if_small(several), "line").groupBy("leaf", "line").agg(F.first("words").alias("words")))
    each = words.select("leaf", "line", F.posexplode(F.transform(F.split(F.col("words").cast("string"), "\n"), lambda w: w.cast("binary"))).alias("at", "word"))
    shared = each.groupBy("leaf", "at", "word").agg(F.count("*").alias("support")).filter("support > 1")
    counted = each.join(materialize(shared), ["leaf", "at", "word"], "left").select("line", F.struct(F.coalesce("support", F.lit(1)).alias("support"), "at", "word").alias("place"))
    named = counted.groupBy("line").agg(F.collect_list("place").alias("places")).select("line", _template(F.col("places"), similarity).alias("template"))
    return placed.filter("m = 1").select("line", F.col("line").alias("template")).union(named)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """Lines to drop: k1, k2 and at, for templates in ``min_docs`` documents or more and unchanged long lines in two or more, but for the first document of each.

    The first document is that of the smallest id, and of those alike in id of the smallest text hash.
    """
    lines = materialize(_parsed(docs, False))
    held = materialize(lines.join(materialize(templates(lines, docs, min_docs, similarity)), "line").select("template", "k1", "k2", "at"))
    often = held.select("template", "k1", "k2").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("first"))
    copied = lines.filter("own IS NOT NULL").groupBy("own").agg(F.min(F.struct("k1", "k2")).alias("first"), F.max(F.struct("k1", "k2")).alias("last"))
    later = F.struct("k1", "k2") != F.col("first")
    gone = held.join(broadcast_if_small(often.filter(F.col("n") >= min_docs).select("template", "first")), "template").filter(later)
    return gone.select("k1", "k2", "at").union(lines.join(broadcast_if_small(copied.filter("first <> last").select("own", "first")), "own").filter(later).select("k1", "k2", "at"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with lines of recurring templates, and recurring long lines, removed from text; n_chars, where there is one, follows.

    Documents are told apart by id and text, so rows alike in both count as
    one document and change alike.  Lines of fewer than MIN_WORDS words, or of
    more wildcards than others, stay, as do all rows, also those left empty; null texts stay null.  Lines are
    parted by line feeds.  An empty table gives an empty one; other columns go along, whatever their names.
    """
    gone = recurring(docs, min_docs, similarity).groupBy("k1", "k2").agg(F.collect_set("at").alias("gone"))
    keyed = docs.select(F.struct("*").alias("row"), *doc_key()).join(materialize(gone), ["k1", "k2"], "left")
    kept = F.filter(F.split(F.col("row")["text"], "\n", -1), lambda line, at: ~F.array_contains("gone", at))
    joined = keyed.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(F.array_join(kept, "\n")).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(length)
    return joined.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
