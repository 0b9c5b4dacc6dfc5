"""Byte-wise deduplication: repeated strings by a Burrows-Wheeler transform built column by column.

The fragments of a task's groups (see repeats) are a collection.  Each round
inserts one symbol of every fragment, from right to left: the new suffixes of
all fragments are placed among all suffixes so far, in one order.  A suffix's
place follows from its symbol and the place of the suffix that it lengthens.
The transform (the symbol before each suffix) and the common prefixes of
neighbours lie in external files, which each round reads in sequence and
writes anew with the inserted rows: the transform gives the symbols to insert,
range minima of the common prefixes give the new ones.

A symbol is SYMBOL bytes.  Equal windows start at the same offset from their
anchors, so fragments are read in SYMBOL alignments to the anchor, each a
collection of its own; a window is a whole number of symbols.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import broadcast_if_small, discard, materialize

WINDOW = 200
GRAM = 32
#: Fragments of a collection, unless one anchor has more; a round passes over all its suffixes, which should fit a core's cache.
AT_ONCE = 4096
#: Most bytes of a symbol; a window has to be a whole number of them.
SYMBOL = 8


class Columns:
    """External files of one value per suffix in order: read in sequence, written anew each round."""

    def __init__(self, folder: str, kinds: dict[str, type]) -> None:
        self.kinds, self.turn, self.rows = kinds, 0, 0
        self.files = {name: [open(os.path.join(folder, f"{name}{i}"), "w+b", buffering=0) for i in (0, 1)] for name in kinds}

    def read(self, name: str) -> np.ndarray:
        values, file = np.empty(self.rows, self.kinds[name]), self.files[name][self.turn]
        file.seek(0)
        file.readinto(memoryview(values).cast("B"))
        return values

    def write(self, **values: np.ndarray) -> None:
        """The next round's files."""
        self.turn = 1 - self.turn
        for name, some in values.items():
            file = self.files[name][self.turn]
            file.seek(0)
            file.write(memoryview(some.astype(self.kinds[name], copy=False)).cast("B"))
            self.rows = len(some)

    def close(self) -> None:
        for pair in self.files.values():
            for file in pair:
                file.close()


def minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both included and low <= high, from a table of runs of 1, 2, 4, ... values."""
    level = np.frexp(high - low + 1)[1] - 1
    table = np.empty((int(level.max(initial=0)) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half = 1 << (k - 1)
        table[k, len(values) - half :] = 0
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, : len(values) - half])
    return np.minimum(table[level, low], table[level, high + 1 - (1 << level)])


def build(symbols: np.ndarray, ends: np.ndarray, counts: np.ndarray, files: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes of all suffixes of a collection, as files; returns each suffix's text and length, in order.

    Text d is ``symbols[ends[d] - counts[d]:ends[d]]``, symbols are small numbers.
    ``keys`` has first symbol << 32 | place of the suffix without it + 1 (0 for the empty one)
    of all suffixes, and rises.  Before a whole text the transform has -1 - d; from these
    rows the places lead through all suffixes of the text.  At the end it has -1 there.
    Texts have fewer than 256 symbols.
    """
    low_half = np.int64(0xFFFFFFFF)
    keys = np.zeros(0, np.int64)
    text = np.flatnonzero(counts > 0)
    place = np.full(len(text), -1, np.int64)
    length = 0
    while len(text):
        length += 1
        before, common = files.read("transform"), files.read("common")
        symbol = (before[place] if length > 1 else symbols[ends[text] - 1]).astype(np.int64)
        mine = symbol << 32 | place + 1
        turn = np.argsort(mine)  # equal ones are empty but for a symbol, in any order
        text, mine = text[turn], mine[turn]
        at = np.searchsorted(keys, mine, side="right")
        spot = at + np.arange(len(at))
        new = np.zeros(len(keys) + len(at), bool)
        new[spot] = True
        old = ~new
        # Neighbours: each new suffix with the one before it, each old one after a new one with the last new one.
        follows = np.concatenate(([False], at[1:] == at[:-1]))
        prior = np.where(follows, np.roll(mine, 1), keys[at - 1] if len(keys) else 0)
        next_ = np.flatnonzero(np.append(at[1:] != at[:-1], True) & (at < len(keys)))
        left = np.concatenate((np.where(follows | (at > 0), prior, -1), mine[next_]))
        right = np.concatenate((mine, keys[at[next_]]))
        shared = (left >> 32 == right >> 32).astype(np.uint8)
        low, high = (left & low_half) - 1, (right & low_half) - 1
        deeper = np.flatnonzero((shared > 0) & (low >= 0) & (low < high))
        if len(deeper):
            shared[deeper] += minima(common, low[deeper] + 1, high[deeper])
        common[at[next_]] = shared[len(at) :]
        alive = counts[text] > length
        following = np.where(alive, symbols[ends[text] - np.minimum(length + 1, counts[text])], -1 - text)

        def inserted(values: np.ndarray, some: np.ndarray) -> np.ndarray:
            merged = np.empty(len(new), values.dtype)
            merged[old] = values
            merged[spot] = some
            return merged

        files.write(transform=inserted(before, following), common=inserted(common, shared[: len(at)]))
        # Places move up by the new suffixes before them.
        more = np.repeat(np.arange(len(at) + 1), np.diff(at, prepend=-1, append=len(keys)))
        for k in (keys, mine):
            k += more.take(k & low_half)
        keys = inserted(keys, mine)
        text, place = text[alive], spot[alive]
    transform = files.read("transform")
    place = np.flatnonzero(transform < 0)
    text = -1 - transform[place]
    files.write(transform=np.maximum(transform, -1), common=files.read("common"))
    length = counts[text]
    texts, lengths = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    while len(place):
        texts[place], lengths[place] = text, length
        rest = np.flatnonzero(length > 1)
        place, text, length = (keys[place[rest]] & low_half) - 1, text[rest], length[rest] - 1
    return texts, lengths


def repeated(data: list[bytes], anchors: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> repeats.Found:
    """The finder: all places in the fragments where a string of ``window`` bytes begins that occurs again, in this fragment's copies or in others."""
    width = next(w for w in (8, 4, 2, 1) if w <= SYMBOL and window % w == 0)
    sizes = np.array([len(d) for d in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    joined = b"".join(data)
    whole = np.ndarray(max(0, len(joined) - width + 1), f">u{width}", joined, strides=(1,))  # the symbol at each byte
    found = []
    for shift in range(width):
        first = (anchors + shift) % width
        counts = np.maximum(0, (sizes - first) // width)
        ends = np.cumsum(counts)
        step = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
        at = np.repeat(begin + first, counts) + step * width
        symbols = np.unique(whole[at], return_inverse=True)[1].astype(np.int32)
        with tempfile.TemporaryDirectory() as folder, contextlib.closing(Columns(folder, {"transform": np.int32, "common": np.uint8})) as files:
            text, length = build(symbols, ends, counts, files)
            common = files.read("common").astype(np.int64)
        deepest = np.maximum(common, np.append(common[1:], 0)) if len(common) else common
        deepest = np.where(weights[text] > 1, length, deepest)
        deep = np.flatnonzero(deepest * width >= window)
        found.append((text[deep], first[text[deep]] + (counts[text[deep]] - length[deep]) * width, deepest[deep] * width))
    owner, start, depth = map(np.concatenate, zip(*found))
    turn = np.lexsort((start, owner))
    return owner[turn], start[turn], depth[turn]


def by_columns(hot: DataFrame, group: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The splitter: ``hot`` fragments cut into pieces of fewer window starts, grouped by the bytes that all windows of a piece share.

    Windows start in one of ``window - gram + 1`` columns, counted from the
    anchor.  Each round halves the columns of a piece, so its windows share a
    longer string; pieces of one column share all of it and are alike.
    """
    span, made, left = window - gram + 1, None, hot.select("akey", "ckey", F.col("akey").alias("piece"), "n", "anchor", "data", F.lit(0).alias("from"))
    while span > 1:
        span = -(-span // 2)
        cut = materialize(left.mapInArrow(_pieces(span, window, gram), "akey long, ckey long, piece long, n long, anchor int, data binary, from int"))
        alike = materialize(cut.groupBy("piece", "data").agg(F.sum("n").alias("n"), F.first("anchor").alias("anchor")).withColumn("ckey", F.xxhash64("data")))
        over = broadcast_if_small(alike.groupBy("piece").agg(F.count("*").alias("m")).filter(F.col("m") > group).select("piece")) if span > 1 else None
        small = alike if over is None else alike.join(over, "piece", "left_anti")
        spans = search_pieces(small, window, gram)
        back = cut.select("akey", "ckey", "piece", F.xxhash64("data").alias("same"), "from").join(spans.select("piece", F.col("ckey").alias("same"), "spans"), ["piece", "same"])
        back = materialize(back.select("akey", "ckey", F.explode("spans").alias("s"), "from").select("akey", "ckey", (F.col("s.from") + F.col("from")).alias("from"), (F.col("s.to") + F.col("from")).alias("to")))
        made = back if made is None else made.union(back)
        if over is None:
            break
        left = materialize(cut.join(over, "piece", "left_semi"))
        discard(cut, alike)
        if left.isEmpty():
            break
    spans = F.sort_array(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"))))
    return made.groupBy("akey", "ckey").agg(spans.cast(repeats.SPANS).alias("spans"))


def _pieces(span: int, window: int, gram: int):
    names = ["akey", "ckey", "piece", "n", "anchor", "data", "from"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for akey, ckey, piece, n, anchor, data, at in zip(*(batch.column(c).to_pylist() for c in names)):
                column = window - gram - anchor  # of the fragment's first window; the last possible one starts at the anchor
                last = column + len(data) - window
                for k in range(column // span, last // span + 1):
                    a, b = max(column, k * span) - column, min(last, k * span + span - 1) - column
                    low = (k + 1) * span - 1 - column  # the bytes from here on are in all windows of piece k
                    shared = data[low : low + window - span + 1]
                    key = xxhash.xxh3_64_intdigest(shared + piece.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little")) - (1 << 63)
                    rows.append((akey, ckey, key, n, anchor - a, data[a : b + window], at + a))
            cols = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def search_pieces(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Spans of the pieces (columns piece, ckey, n, anchor and data), found by their groups' transforms."""
    named = pieces.select(F.col("piece").alias("akey"), "ckey", "n", "anchor", "data")
    return repeats.search(named, unit(window, gram), lambda d, a, w: repeated(d, a, w, window)).withColumnRenamed("akey", "piece")


def unit(window: int = WINDOW, gram: int = GRAM) -> repeats.Unit:
    return repeats.Unit(words=False, window=window, gram=gram, at_once=AT_ONCE)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """Remove every byte that a string of ``window`` bytes covers which also starts elsewhere: see repeats.cut."""
    return repeats.cut(docs, unit(window, gram), lambda d, a, w: repeated(d, a, w, window), lambda hot, most: by_columns(hot, most, window, gram), group)
