"""Word-wise deduplication by prefix-partitioned suffix trees.

Suffixes are parted by prefixes of variable length.  The first prefix is the
anchor gram that a suffix's window holds (see anchors): fragments that share it
travel together once, instead of one copy for each suffix.  Where a gram has
more fragments than a group may hold, its suffixes are parted by their own
first words, and the prefix is lengthened as long as a group doesn't fit; as
long as a window, the prefix is a deep node itself and its leaves need no
tree.  A group's subtree is kept as its sorted suffixes with the common
prefixes of neighbours.  Runs of common prefixes of a window or more are the
subtree's deep inner nodes, and the deepest node above a leaf is the longest
string that repeats from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import materialize

WINDOW = 35
GRAM = 4
_PLACE = "akey long, ckey long, w int, depth int"


def subtree(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes from ``starts`` to ``ends``, and the common prefix (in words) of each with the one before, 0 for the first.

    Suffixes are ranked by their first 1, 2, 4, ... words.  ``words`` parts texts by 0, which no word has.
    """
    rank, width = [np.append(np.unique(words, return_inverse=True)[1] + 1, 0).astype(np.int64)], 1
    while width < (ends - starts).max(initial=1):
        r = rank[-1]
        later = np.zeros_like(r)
        later[:-width] = r[width:]
        rank.append(np.unique(r * (len(r) + 1) + later, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(rank[-1][starts], kind="stable")
    a, b = starts[order][:-1], starts[order][1:]
    same = np.zeros(len(a), np.int64)
    for r in reversed(rank):
        width, last = 1 << (len(rank) - 1), len(r) - 1
        same += np.where(r[np.minimum(a + same, last)] == r[np.minimum(b + same, last)], width, 0)
        rank = rank[:-1]
    longest = np.minimum(ends - starts, len(words))[order]
    return order, np.concatenate(([0], np.minimum(same, np.minimum(longest[:-1], longest[1:]))))


def deepest(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each suffix the depth of the deepest inner node above it; one that stands for several copies is a node itself."""
    order, common = subtree(words, starts, ends)
    depth = np.empty(len(starts), np.int64)
    depth[order] = np.maximum(common, np.append(common[1:], 0))
    return np.where(weights > 1, ends - starts, depth)


def _coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers from 1, texts parted by 0; where texts start and end."""
    codes: dict[bytes, int] = {}
    words = np.array([x for t in texts for x in (*[codes.setdefault(w, len(codes) + 1) for w in t], 0)], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    return words, starts, starts + sizes


def repeated(data: list[list[bytes]], anchors: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> repeats.Found:
    """The finder of groups that share an anchor gram: all suffixes of the fragments as long as a window are in the subtree."""
    words, starts, ends = _coded(data)
    counts = ends - starts - window + 1
    owner = np.repeat(np.arange(len(data)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    depth = deepest(words, starts[owner] + within, ends[owner], weights[owner])
    deep = depth >= window
    return owner[deep], within[deep], depth[deep]


def prefix_lengths(window: int, gram: int) -> list[int]:
    """Lengths of the prefixes that part large groups: twice the gram, doubled up to the window."""
    out = [2 * gram]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return [n for n in out if n < window] + [window]


def by_prefixes(hot: DataFrame, group: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The splitter: suffixes of ``hot`` fragments in groups of one prefix, the shortest with at most ``group`` suffixes.

    Suffixes that share their prefix with no other repeat nothing and are left out.  Groups whose prefix is as long as a window are one node; its weight is summed and it is never gathered.
    """
    lengths = prefix_lengths(window, gram)
    names = ["akey", "ckey", "n", "w", *[f"p{n}" for n in lengths]]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cols: list[list[int]] = [[] for _ in names]
            for akey, ckey, n, data in zip(*(batch.column(c).to_pylist() for c in ("akey", "ckey", "n", "data"))):
                words = data.split()
                for w in range(len(words) - window + 1):
                    for col, value in zip(cols, (akey, ckey, n, w, *[digest(b" ".join(words[w : w + p]), akey & 0xFFFF) - (1 << 63) for p in lengths])):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "w" else pa.int64()) for k, c in zip(names, cols)], names)

    left = materialize(hot.mapInArrow(suffixes, "akey long, ckey long, n long, w int, " + ", ".join(f"p{n} long" for n in lengths)))
    placed = None
    for n in lengths[:-1]:
        key = f"p{n}"
        sizes = left.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("leaves")).filter("leaves > 1")  # a single leaf has no inner node above it
        counted = materialize(left.join(sizes, key).drop("leaves"))
        part = counted.filter(F.col("m") <= group).select("akey", "ckey", "n", "w", F.col(key).alias("prefix"))
        placed = part if placed is None else placed.union(part)
        left = counted.filter(F.col("m") > group).drop("m")
    whole = f"p{lengths[-1]}"
    texts = placed.join(hot.select("akey", "ckey", "data"), ["akey", "ckey"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in repeats.batches_of(batches, ["prefix"], repeats.FRAGMENTS_AT_ONCE):
            w = rows.column("w").to_numpy()
            words, starts, ends = _coded([d.split()[i:] for d, i in zip(rows.column("data").to_pylist(), w.tolist())])
            depth = deepest(words, starts, ends, rows.column("n").to_numpy())
            deep = pa.array(depth >= window)
            cols = [rows.column(c).combine_chunks().filter(deep) for c in ("akey", "ckey", "w")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(depth[depth >= window].astype(np.int32))], ["akey", "ckey", "w", "depth"])

    grown = texts.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(trees, _PLACE)
    nodes = left.groupBy(whole).agg(F.sum("n").alias("leaves")).filter("leaves > 1").select(whole)
    places = grown.union(left.join(nodes, whole, "left_semi").select("akey", "ckey", "w", F.lit(window).alias("depth")))
    spans = F.sort_array(F.collect_list(F.struct(F.col("w").alias("from"), (F.col("w") + F.col("depth")).alias("to"))))
    return places.groupBy("akey", "ckey").agg(spans.cast(repeats.SPANS).alias("spans"))


def unit(window: int = WINDOW, gram: int = GRAM) -> repeats.Unit:
    return repeats.Unit(words=True, window=window, gram=gram)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = repeats.GROUP) -> DataFrame:
    """Remove every word that a run of ``window`` words covers which also starts elsewhere: see repeats.cut."""
    return repeats.cut(docs, unit(window, gram), lambda d, a, w: repeated(d, a, w, window), lambda hot, most: by_prefixes(hot, most, window, gram), group)
