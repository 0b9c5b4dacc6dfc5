"""SimHash near-duplicates by segment popcounts and a grid range-join.

A fingerprint's 64 bits are cut into 32 segments of two.  The segments' bit
counts embed it in a small integer space in which the Manhattan distance
never exceeds the Hamming distance.  The axes make two halves.  Fingerprints
``distance`` or less apart are at most distance // 2 apart in the first half
or at most distance - distance // 2 - 1 in the second.  Each half is a grid of
unit cells, in which a range-join brings together what lies so close: every
fingerprint goes to its own cell and those one step away (upwards only, if the
range is one), so that any two within the range share a cell.  Within a cell,
the Manhattan distance of the whole embedding is the lower bound that comes
first, then the exact Hamming distance decides.  Cells return links that span
what they connect, not all pairs, so groups of copies cost no square.

Where a least similarity of the shingles is asked for as well, MinHash bands
find the candidates that lie further apart, and their exact Jaccard similarity
decides.  (A pair that shares 0.8 of its shingles lies about 10 of 64 bits
apart; cells for so wide a range would hold any two documents.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, doc_key, materialize, whole_rows

WORDS = 4
DISTANCE = 4
SEED = 42
#: Ranges in a half of the axes are two steps at most, so distances are at most this.
WIDEST = 4
#: Fingerprints of a cell that one task compares at once; larger cells are compared in blocks.
BLOCK = 4096
SEGMENTS = 32
HASHES_AT_ONCE = 1 << 16
#: MinHash bands of so many rows each: pairs of similarity 0.8 share a band with probability 0.998.
BANDS, ROWS = 20, 6
#: Odd factors, one for each row's order of the hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts that share a band and are compared at once; more are compared in blocks.
TEXTS_AT_ONCE = 1024


def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some at a time; all words are one shingle if there are fewer, and there is none without words."""
    if not text or not (tokens := text.encode("utf-8", "surrogatepass").lower().split()):
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE])], "<u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The signed number of the bits that most hashes have; zero without hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for some in hashes:
        n += len(some)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a whole text; zero without words."""
    return majority(shingle_hashes(text, words))


def band_keys(hashes: list[np.ndarray]) -> list[int]:
    """A key for each MinHash band; none without hashes."""
    if not hashes:
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for some in hashes:
        for at in range(0, len(some), 512):
            least = np.minimum(least, (some[at : at + 512, None] * FACTORS >> np.uint64(20)).min(axis=0))
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        h = (h ^ value) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int = WORDS, banded: bool = False) -> DataFrame:
    """Columns doc_id, k1, k2 (document key), fp and, if asked for, bands of each row; null text counts as empty."""
    names = ["doc_id", "k1", "k2", "fp", *["bands"] * banded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py(), words)
                if banded:
                    hashes = list(hashes)
                    keys.append(band_keys(hashes))
                fps.append(majority(hashes))
            made = [pa.array(fps, pa.int64()), *[pa.array(keys, pa.list_(pa.int64()))] * banded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), *made], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), "text")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long" + ", bands array<long>" * banded)


def segment_counts(fps: np.ndarray, bits: int) -> np.ndarray:
    """Bit counts per segment of ``bits`` bits: one row for each fingerprint."""
    ones = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return ones.reshape(len(fps), 64 // bits, bits).sum(axis=2, dtype=np.uint8)


def cells(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells that the range-join puts fingerprints in: cell and index of the fingerprint."""
    axes, n = segment_counts(fps, 64 // SEGMENTS), SEGMENTS // 2
    steps = np.int64(3) ** np.arange(n)
    cell, row = [], []
    for half, reach in enumerate((distance // 2, distance - distance // 2 - 1)):
        mine = axes[:, half * n : (half + 1) * n]
        own = mine.astype(np.int64) @ steps
        put = [(np.arange(len(fps)), 0)] if reach >= 0 else []
        if reach >= 1:
            i, axis = np.nonzero(mine < 2)
            put.append((i, steps[axis]))
        if reach >= 2:
            i, axis = np.nonzero(mine > 0)
            put.append((i, -steps[axis]))
        for i, step in put:
            cell.append((own[i] + step) * 2 + half)
            row.append(i)
    return np.concatenate(cell), np.concatenate(row)


def unary(fps: np.ndarray) -> np.ndarray:
    """The embedding with counts 0, 1, 2 spelled 00, 01, 11: Manhattan distances are numbers of differing bits."""
    x, every = fps.view(np.uint64), np.uint64(0x5555555555555555)
    low, high = x & every, x >> np.uint64(1) & every
    return (low | high) | (low & high) << np.uint64(1)


def spanning(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that connect what the given links connect."""
    nodes, inverse = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def cell_links(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of rows sorted by cell, comparing the rows of each cell with each other."""
    left, right = [fp[:0]], [fp[:0]]
    bits, counts = fp.view(np.uint64), unary(fp)
    gap, live = 1, np.arange(len(cell))
    while True:
        live = live[live + gap < len(cell)]
        live = live[cell[live] == cell[live + gap]]
        if not len(live):
            break
        close = live[np.bitwise_count(counts[live] ^ counts[live + gap]) <= distance]
        close = close[np.bitwise_count(bits[close] ^ bits[close + gap]) <= distance]
        left.append(fp[close])
        right.append(fp[close + gap])
        if sum(map(len, left)) > 1 << 18:
            a, b = spanning(fp, np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
        gap += 1
    return spanning(fp, np.concatenate(left), np.concatenate(right))


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all those at most ``distance`` (up to WIDEST) bits apart.

    Cells of more than ``block`` fingerprints are cut into blocks by hash, and
    each pair of blocks is compared on its own, so no task holds a whole cell.
    """
    if not 0 <= distance <= WIDEST:
        raise ValueError(f"distance must be 0 to {WIDEST}: {distance}")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            cell, row = cells(fp, distance)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[row])], ["cell", "fp"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[["cell", "part"]].to_numpy()
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield linked(rest[:cut])
                rest = rest[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield linked(rest)

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows["cell"].to_numpy() ^ (rows["part"].to_numpy() * 0x5851F42D4C957F2D)
        a, b = cell_links(cell, rows["fp"].to_numpy(), distance)
        return pd.DataFrame({"a": a, "b": b})

    flat = fps.select("fp").mapInArrow(expand, "cell long, fp long")
    sizes = flat.groupBy("cell").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block).select("cell", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks"))
    cut = flat.join(broadcast_if_small(large), "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block i meets block j (i <= j) in part i * blocks + j.
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j))
    )
    dealt = cut.select("cell", "fp", F.explode(parts).alias("part"))
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "fp").mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): columns node, root (the smallest node), for every node that has a link.

    Alternates large-star and small-star rounds until nothing changes; every
    round is written to the shared scratch folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The smallest neighbours are held before the joins, so that those can be split at a node of very many links.
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = materialize(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        down = materialize(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        last, edges = edges, materialize(small.filter("a <> b").distinct())
        discard(last, low, large, down)
        if (after := mark(edges)) == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2, fp and component (the root fingerprint).

    Documents link if their fingerprints differ in ``distance`` bits or less;
    components are what links connect.  Null and empty texts have fingerprint
    zero and link like others.  Repeated rows share a component.
    """
    marked = materialize(fingerprints(docs, words))
    roots = components(links(marked.select("fp").distinct(), distance))
    return marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "k1", "k2", "fp", F.coalesce("root", "fp").alias("component"))


def similar_links(shingles: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of ``similarity`` or more that connect what such pairs connect, given what equal labels connect."""
    sizes = np.array([len(x) for x in shingles], np.int64)
    codes = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    labels, mine, out = labels.copy(), np.zeros(len(codes), bool), []
    for i in range(len(sizes) - 1):
        if (labels == labels[i]).all():
            break
        own = codes[edges[i] : edges[i + 1]]
        mine[own] = True
        shared = np.add.reduceat(mine[codes[edges[i + 1] :]], edges[i + 1 : -1] - edges[i + 1], dtype=np.int64)
        mine[own] = False
        for j in (np.flatnonzero(shared >= similarity * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9) + i + 1).tolist():
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                out.append((i, j))
    return out


def jaccard_links(docs: DataFrame, marked: DataFrame, words: int, similarity: float, most: int = TEXTS_AT_ONCE) -> DataFrame:
    """Links (a, b) between fingerprints of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    ``marked`` has k2, fp, component and bands of each document.  Pairs are
    found by shared bands; those that a component connects already are left
    out.  Bands shared by more than ``most`` texts are compared block by block.
    """
    flat = materialize(marked.dropDuplicates(["k2"]).select("k2", "fp", "component", F.explode("bands").alias("band")))
    sizes = flat.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.xxhash64("k2").cast("decimal(38,0)")).alias("who"))
    # Bands shared by the same texts are compared once.
    shared = materialize(sizes.filter("lo <> hi").groupBy("who", "n").agg(F.min("band").alias("band")))
    members = materialize(flat.join(broadcast_if_small(shared.select("band", "n")), "band"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(np.concatenate(list(shingle_hashes(t.as_py(), words)))).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("k2"), pa.array(made, pa.list_(pa.int64()))], ["k2", "shingles"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[["band", "part"]].to_numpy()
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield linked(rest[:cut])
                rest = rest[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield linked(rest)

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        fp, out = rows["fp"].to_numpy(), []
        for at in rows.groupby(["band", "part"], sort=False).indices.values():
            found = similar_links([rows["shingles"].iat[i] for i in at], rows["component"].to_numpy()[at], similarity)
            out += [(fp[at[i]], fp[at[j]]) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    texts = docs.select(*doc_key(), "text").select("k2", "text").join(broadcast_if_small(members.select("k2").distinct()), "k2").dropDuplicates(["k2"])
    shingles = materialize(texts.mapInArrow(sets, "k2 long, shingles array<long>"))
    blocks = F.ceil(F.col("n") / (most // 2)).cast("int")
    mine = F.pmod(F.xxhash64("k2"), blocks).cast("int")
    # Block i meets block j (i <= j) in part i * blocks + j.
    parts = F.when(F.col("n") <= most, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(mine, j).cast("long") * blocks + F.greatest(mine, j))
    )
    dealt = members.select("band", "k2", "fp", "component", F.explode(parts).alias("part")).join(shingles, "k2")
    return dealt.repartition("band", "part").sortWithinPartitions("band", "part", "k2").mapInPandas(compare, "a long, b long").distinct()


def similar_documents(docs: DataFrame, words: int, distance: int, similarity: float) -> DataFrame:
    """As near_duplicates, but documents also link if the Jaccard similarity of their shingles is ``similarity`` or more."""
    marked = materialize(fingerprints(docs, words, banded=True))
    roots = materialize(components(links(marked.select("fp").distinct(), distance)))
    named = lambda roots: marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    more = materialize(jaccard_links(docs, named(roots), words, similarity))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return named(roots).select("doc_id", "k1", "k2", "fp", "component")


def component_ids(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Columns doc_id, fingerprint (hexadecimal) and component_id: the smallest id of the component (null if it has none)."""
    found = materialize(near_duplicates(docs, words, distance))
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))  # so that Spark can split a hot component
    return found.join(least, "component").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key; equal rows count once.

    With ``similarity``, documents that share so many of their shingles (Jaccard) are near duplicates as well.
    Of rows alike in id and text the one that comes first as JSON stays.  Null
    and wordless texts have fingerprint zero, so one of them all stays.  An
    empty table gives an empty one; other columns go along, whatever their names.
    """
    found = near_duplicates(docs, words, distance) if similarity is None else similar_documents(docs, words, distance, similarity)
    first = materialize(found.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2"))
    kept = whole_rows(docs).join(broadcast_if_small(first), ["k1", "k2"], "left_semi")
    twice = docs.select(*doc_key()).groupBy("k1", "k2").count().filter("count > 1")
    if not twice.isEmpty():  # repeated rows share a key
        kept = kept.groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row"))
    return kept.select("row.*")
