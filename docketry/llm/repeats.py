"""Windows of text that occur more than once: candidate fragments and their spans.

Documents are cut into overlapping fragments by content-defined anchors (see
anchors).  Only fragments whose anchor gram occurs again can hold a repeat.
Equal fragments collapse into one with a weight; groups of fragments with one
anchor are then searched by a finder, and the spans it returns go back to all
occurrences.  Groups of too many different fragments for one task are parted
further by the operator's own splitter, until every part fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import fragments
from .common import broadcast_if_small, discard, doc_key, materialize

#: Symbols that are scanned at once, and fragments that a finder gets at once unless one anchor has more.
SCAN_AT_ONCE = 1 << 20
FRAGMENTS_AT_ONCE = 8192
#: Groups of more fragments are parted further.
GROUP = 16_384
SPANS = "array<struct<`from`:int,`to`:int>>"
_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

#: Where repeats begin: index of the fragment, symbol in it (rising in each fragment), and how many symbols repeat from there, a window or more.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Fragments as bytes or words, anchors' places in them, their weights -> all places in them where strings begin that occur again.
Finder = Callable[[list, np.ndarray, np.ndarray], Found]
#: Fragments (akey, ckey, n, anchor, data) of large groups and the most of a group -> akey, ckey and spans.
Splitter = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``window`` bytes or words, anchored by grams of ``gram`` of them (a power of two).

    A finder gets whole groups, of ``at_once`` fragments or more together.
    """

    words: bool
    window: int
    gram: int
    at_once: int = FRAGMENTS_AT_ONCE

    def symbols(self, text: bytes) -> list[bytes] | bytes:
        return text.split() if self.words else text


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(found: Found, n: int) -> list[list[dict[str, int]]]:
    """Maximal runs of symbols that the repeats cover, for each of ``n`` fragments."""
    owner, start, depth = (x.astype(np.int64) for x in found)
    out: list[list[dict[str, int]]] = [[] for _ in range(n)]
    if len(owner):
        shift = owner * (int((start + depth).max()) + 2)  # keeps fragments apart
        until = np.maximum.accumulate(start + depth + shift)
        first = np.flatnonzero(np.concatenate(([True], start[1:] + shift[1:] > until[:-1])))
        last = np.append(first[1:], len(owner)) - 1
        for o, a, b in zip(owner[first].tolist(), start[first].tolist(), (until[last] - shift[last]).tolist()):
            out[o].append({"from": a, "to": b})
    return out


def united(starts: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs in the order of starts as maximal runs; runs that touch become one."""
    if not len(starts):
        return [], []
    until = np.maximum.accumulate(stops)
    new = np.flatnonzero(starts[1:] > until[:-1]) + 1
    return starts[np.append(0, new)].tolist(), until[np.append(new - 1, len(starts) - 1)].tolist()


class _Scanned:
    """Documents joined to one array of symbols, with the bytes of any run of them."""

    def __init__(self, parts: list[list[bytes] | bytes], unit: Unit) -> None:
        self.unit = unit
        sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        if unit.words:
            words = [w for p in parts for w in p]
            self.joined = b" ".join(words)
            stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            self.stop, self.start = stop, np.concatenate(([0], stop[:-1] + 1)) if len(words) else stop
            digest = xxhash.xxh32_intdigest
            self.symbols = np.fromiter((digest(w) for w in words), np.uint32, len(words))
        else:
            self.joined = b"".join(parts)
            self.symbols = np.frombuffer(self.joined, np.uint8)

    def keys(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs first..last of symbols, last included."""
        a, b = (self.start[first], self.stop[last]) if self.unit.words else (first, last + 1)
        digest, data = xxhash.xxh3_64_intdigest, self.joined
        return np.array([digest(data[i:j]) for i, j in zip(a.tolist(), b.tolist())], np.uint64).view(np.int64)


_OCCURRENCE = ["k1", "k2", "akey", "ckey", "at", "size", "anchor"]


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """All fragments: document key, hashes of the anchor gram and of the whole fragment, its start, its size, the anchor's place in it."""

    def scanned(keys: list[tuple[int, int]], parts: list) -> pa.RecordBatch:
        s = _Scanned(parts, unit)
        anchor, first, last = fragments(s.symbols, s.starts, s.ends, unit.window, unit.gram)
        doc = np.searchsorted(s.ends, first, side="right")
        k = np.array(keys, np.int64).reshape(-1, 2)
        cols = [k[doc, 0], k[doc, 1], s.keys(anchor, anchor + unit.gram - 1), s.keys(first, last + unit.window - 1)]
        cols += [(first - s.starts[doc]).astype(np.int32), (last - first + unit.window).astype(np.int32), (anchor - first).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _OCCURRENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for batch in batches:
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
                symbols = unit.symbols(encode(text.as_py()))
                if len(symbols) >= unit.window:
                    keys.append((k1, k2))
                    parts.append(symbols)
                    held += len(symbols)
                if held >= SCAN_AT_ONCE:
                    yield scanned(keys, parts)
                    keys, parts, held = [], [], 0
        if keys:
            yield scanned(keys, parts)

    return docs.select(*doc_key(), "text").mapInArrow(run, "k1 long, k2 long, akey long, ckey long, at int, size int, anchor int")


def fetch(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The texts (as binary) of one occurrence of each different fragment: akey, ckey, n, anchor, data."""
    per_doc = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("akey", "ckey", "n", "at", "size", "anchor")).alias("wanted"))
    names = ["akey", "ckey", "n", "anchor", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, some in zip(batch.column("text"), batch.column("wanted")):
                symbols = unit.symbols(encode(text.as_py()))
                for w in some.as_py():
                    piece = symbols[w["at"] : w["at"] + w["size"]]
                    for col, value in zip(out, (w["akey"], w["ckey"], w["n"], w["anchor"], b" ".join(piece) if unit.words else piece)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

    texts = docs.select(*doc_key(), "text").join(per_doc, ["k1", "k2"]).select("text", "wanted")
    return texts.mapInArrow(run, "akey long, ckey long, n long, anchor int, data binary")


def batches_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows_at_once: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``rows_at_once`` rows or more; rows come sorted by the ``keys``."""

    def changes(rows: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([(v := rows.column(k).to_numpy())[1:] != v[:-1] for k in keys], axis=0)) + 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows_at_once:
            rows, begun = pa.Table.from_batches(held).combine_chunks(), 0
            for end in changes(rows).tolist():
                if end - begun >= rows_at_once:
                    yield rows.slice(begun, end - begun)
                    begun = end
            held = rows.slice(begun).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def search(found: DataFrame, unit: Unit, finder: Finder) -> DataFrame:
    """Run the finder over groups of fragments with one anchor: akey, ckey and the spans that are covered, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of(batches, ["akey"], unit.at_once):
            akey, ckey = (rows.column(c).to_numpy() for c in ("akey", "ckey"))
            once = np.concatenate(([True], (akey[1:] != akey[:-1]) | (ckey[1:] != ckey[:-1])))  # repeated rows fetch a fragment twice
            rows, akey, ckey = rows.filter(pa.array(once)), akey[once], ckey[once]
            data = [unit.symbols(x) for x in rows.column("data").to_pylist()]
            spans = runs(finder(data, rows.column("anchor").to_numpy().astype(np.int64), rows.column("n").to_numpy()), len(data))
            some = [i for i, s in enumerate(spans) if s]
            yield pa.RecordBatch.from_arrays([pa.array(akey[some]), pa.array(ckey[some]), pa.array([spans[i] for i in some], _SPANS)], ["akey", "ckey", "spans"])

    return found.repartition("akey").sortWithinPartitions("akey", "ckey").mapInArrow(run, f"akey long, ckey long, spans {SPANS}")


def repeated_spans(docs: DataFrame, unit: Unit, finder: Finder, splitter: Splitter, group: int = GROUP) -> DataFrame:
    """Columns k1, k2, starts and stops of runs of symbols that repeats cover, in the order of starts; runs may overlap.

    Rows alike in id and text share a key but count as several documents.
    """
    all_ = materialize(occurrences(docs, unit))
    again = materialize(all_.groupBy("akey").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("akey"))  # so that Spark can split hot keys of the join
    kept = materialize(all_.join(again, "akey", "left_semi"))
    discard(all_, again)
    different = kept.groupBy("akey", "ckey").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "size", "anchor")).alias("rep"))
    wanted = materialize(different.select("akey", "ckey", "n", "rep.*"))
    large = materialize(wanted.groupBy("akey").agg(F.count("*").alias("m")).filter(F.col("m") > group).select("akey"))
    if large.isEmpty():
        spans = materialize(search(fetch(docs, wanted, unit), unit, finder))
    else:
        large, fetched = broadcast_if_small(large), materialize(fetch(docs, wanted, unit))  # texts are shuffled once
        small = search(fetched.join(large, "akey", "left_anti"), unit, finder)
        hot = materialize(fetched.join(large, "akey", "left_semi").dropDuplicates(["akey", "ckey"]))
        spans = materialize(small.union(splitter(hot, group)))
        discard(fetched, hot)
    discard(wanted)
    placed = kept.select("akey", "ckey", "k1", "k2", "at").join(spans, ["akey", "ckey"]).select("k1", "k2", "at", F.explode("spans").alias("s"))
    all_runs = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct((F.col("at") + F.col("s.from")).alias("from"), (F.col("at") + F.col("s.to")).alias("to")))).alias("runs"))
    return all_runs.select("k1", "k2", F.col("runs.from").alias("starts"), F.col("runs.to").alias("stops"))


def cut(docs: DataFrame, unit: Unit, finder: Finder, splitter: Splitter, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n symbols long, spans removed (maximal runs, counted in symbols) and kept (binary).

    Null texts are empty.  Kept bytes are joined as they are, kept words by
    one space.  Texts shorter than a window, and empty ones, lose nothing; rows
    alike in id and text are repeats of each other; an empty table gives an
    empty one; other columns of docs are ignored.
    """
    found = repeated_spans(docs, unit, finder, splitter, group)
    names = ["doc_id", "n", "starts", "stops", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops = batch.column("starts"), batch.column("stops")
            first, last = starts.values.to_numpy(), stops.values.to_numpy()
            n, froms, tos, kept = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                symbols = unit.symbols(encode(text.as_py()))
                n.append(len(symbols))
                low, high = starts.offsets[i].as_py(), starts.offsets[i + 1].as_py()
                a, b = united(first[low:high], last[low:high])
                froms.append(a)
                tos.append(b)
                if not a:
                    kept.append(b" ".join(symbols) if unit.words else symbols)
                    continue
                pieces = [symbols[x:y] for x, y in zip([0, *b], [*a, len(symbols)])]
                kept.append(b" ".join(w for p in pieces for w in p) if unit.words else b"".join(pieces))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (froms, tos)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists, pa.array(kept, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text").join(found, ["k1", "k2"], "left").select("doc_id", "text", "starts", "stops")
    made = rows.mapInArrow(run, "doc_id long, n long, starts array<int>, stops array<int>, kept binary")
    return made.select("doc_id", "n", F.arrays_zip(F.col("starts").alias("from"), F.col("stops").alias("to")).alias("spans"), "kept")
