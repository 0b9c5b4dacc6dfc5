"""Ranked lexical search by a hierarchical max tree over document ranges.

The corpus is read once for the terms that any query has: each document's
length and term counts go to a narrow table, and its sums are the statistics.
Then each task takes segments of that table, sorts their documents by id and
builds, for every term, a tree over document ranges: a node holds the largest
impact of the term in its range.  A query descends from the root, the range of
highest summed bounds first, and stops when no bound can beat its k-th result.
Ranges whose bound equals that result's score are opened while they begin
before it, so ties come out by ascending id.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Terms of a text as UTF-8, of which only A-Z are lower-cased.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Ranges below a node.
FAN = 32
#: A segment ends at so many postings or documents.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1_000_000, 1 << 16
#: Queries are answered together as long as their texts take so many bytes.
QUERY_BYTES = 8 << 20
_FOUND = "q int, doc_id long, tie long, score long"


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, before its weight; n is the document's length."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (75 + (25 * n * n_docs) // max(1, total)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class MaxTree:
    """Trees of all terms of a segment, level by level; level 0 has the postings, sorted by term and document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        term, node = term[order], doc[order].astype(np.int64)
        self.nodes, self.most, self.below = [node], [impact[order]], [None]
        while True:
            node = self.nodes[-1] // FAN
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])))) if len(term) else np.zeros(0, np.int64)
            self.most.append(np.maximum.reduceat(self.most[-1], first) if len(first) else self.most[-1])
            self.below.append(np.append(first, len(term)))
            term, node = term[first], node[first]
            self.nodes.append(node)
            n_docs = -(-n_docs // FAN)
            if n_docs <= 1:
                break
        self.top = np.full(n_terms, -1, np.int64)  # each term's root
        self.top[term] = np.arange(len(term))

    def search(self, query: np.ndarray, weights: np.ndarray, keys: list[tuple], best: list[tuple], k: int) -> None:
        """Put the segment's results into ``best``, a sorted list of (-score, key) of k rows at most; keys are ascending."""
        at = self.top[query]
        at, weights = at[at >= 0], weights[at >= 0]
        level = len(self.nodes) - 1
        open_, n = [(-int((weights * self.most[level][at]).sum()), 0, 0, level, 0, at, weights)] if len(at) else [], 0
        while open_:
            bound, first, _, level, node, at, weights = heapq.heappop(open_)
            if bound >= 0 or len(best) == k and (bound, keys[first]) > best[-1]:
                break  # no other range can be better, or as good and begin earlier
            low, high = self.below[level][at], self.below[level][at + 1]
            count = high - low
            entry = np.arange(count.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            weights = np.repeat(weights, count)
            level -= 1
            child = self.nodes[level][entry] - node * FAN
            bounds = np.zeros(FAN, np.int64)
            np.add.at(bounds, child, weights * self.most[level][entry])
            if level == 0:
                for c in np.flatnonzero(bounds).tolist():
                    row = (-int(bounds[c]), keys[node * FAN + c])
                    if len(best) < k or row < best[-1]:
                        insort(best, row)
                        del best[k:]
                continue
            order = np.argsort(child, kind="stable")
            edges = np.searchsorted(child[order], np.arange(FAN + 1))
            for c in np.flatnonzero(bounds).tolist():
                first, own = (node * FAN + c) * FAN**level, order[edges[c] : edges[c + 1]]
                if len(best) < k or (-int(bounds[c]), keys[first]) <= best[-1]:
                    n += 1
                    heapq.heappush(open_, (-int(bounds[c]), first, n, level, node * FAN + c, entry[own], weights[own]))


def _forward(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Documents that have a term: doc_id, tie (hash of the text), n (terms with repeats), and numbers and counts of the queries' terms."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, keep, n, own, times = batch.slice(at, 512), [], [], [], []
                for i, text in enumerate(part.column("text")):
                    if found := terms(text.as_py()):
                        hits = Counter(map(get, found))
                        hits.pop(None, None)
                        keep.append(i)
                        n.append(len(found))
                        own.append(list(hits))
                        times.append(list(hits.values()))
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "tie", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, n long, terms array<int>, times array<int>")


def _best(forward: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, total: int, k: int, segment: int) -> DataFrame:
    """The k best documents of each query within each task."""
    asked = forward.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked.value]
        held, n_held, rows_held = [], 0, 0

        def answer() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, ties = t.column("doc_id").to_pylist(), t.column("tie").to_pylist()
            keys = [(i is None, i or 0, tie) for i, tie in zip(ids, ties)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            own, times = t.column("terms").combine_chunks(), t.column("times").combine_chunks()
            row = np.repeat(np.arange(t.num_rows), np.diff(own.offsets.to_numpy()))
            n = t.column("n").to_numpy()[row]
            tree = MaxTree(own.flatten().to_numpy(), place[row], impacts(times.flatten().to_numpy().astype(np.int64), n, n_docs, total), n_terms, len(keys))
            keys = [keys[i] for i in order]
            for (query, weights), found in zip(asked.value, best):
                tree.search(query, weights, keys, found, k)

        for batch in batches:
            for at in range(0, batch.num_rows, min(4096, segment)):
                part = batch.slice(at, min(4096, segment))
                held.append(part)
                n_held, rows_held = n_held + len(part.column("terms").flatten()), rows_held + part.num_rows
                if n_held >= SEGMENT_POSTINGS or rows_held >= segment:
                    answer()
                    held, n_held, rows_held = [], 0, 0
        if held:
            answer()
        out = [(q, None if key[0] else key[1], key[2], -score) for q, found in enumerate(best) for score, key in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["q", "doc_id", "tie", "score"])

    return forward.mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES, segment: int = SEGMENT_DOCS) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id and score, all scores above 0.

    Items alike in id and text count once; items with one id and several texts
    have a ranking for each.  Null and empty texts have no term: such items
    find nothing, such documents don't count.  Repeated documents rank one by
    one.  Equal scores are ordered by doc_id (nulls last), then by the text's
    hash.  Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups, out = -(-2 * size // query_bytes) if size > query_bytes else 1, None
    for g in range(groups):
        # No more texts than fit; what isn't bounded, the documents, stays with the executors.
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        counts = [Counter(terms(r["text"])) for r in rows]
        number = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        forward = materialize(_forward(docs, number))
        n_docs, total = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(number), np.int64)
        for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of these queries only
            df[r["term"]] = r["count"]
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        queries = []
        for c in counts:
            own, times = np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)
            use = weights[own] > 0 if len(own) else np.zeros(0, bool)
            queries.append((own[use], (weights[own] * times)[use]) if len(own) else (own, times))
        ids = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "q int, item_id long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))
        found = _best(forward, queries, len(number), n_docs, total, k, segment).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = found.join(ids, "q").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out
