"""Toxicity by Levenshtein automata over a learned lexicon, with scores of context windows.

Learning takes a bounded sample of labelled rows: word stems that mark toxic
documents become a lexicon, kept as a trie.  The trie is intersected with
Levenshtein automata of distance one; the product is walked as one automaton
whose states are built when first reached.  A hit's evidence is the log-odds
of its (stem, distance) among the labelled rows, so misspellings that clean
texts contain as well count for nothing.  Windows around the hits tell
quotation (hits between quotation marks, alone) from abuse (hits that crowd
together), and a logistic model turns both into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, materialize

#: At most about so many labelled rows are learned from; beyond, a hash of the id picks a share.
SAMPLE_ROWS = 40_000
MIN_STEM = 3
#: Stems shorter than this allow no misspelling.
MIN_FUZZY = 5
#: Least number of toxic documents with a stem, and how much more frequent it is in them.
MIN_TOXIC, MIN_RATIO = 3, 20.0
#: The same as a share of the toxic documents.
MIN_SHARE = 0.01
#: As many stems at most, of all that are as frequent, as chance alone may make as telling.
BY_CHANCE = 0.5
#: Hits with smaller log-odds than this count for nothing.
MIN_EVIDENCE = 1.5
#: Words on either side that make a hit's context.
WINDOW = 8
THRESHOLD = 0.3
#: Marks a stem that must be a whole word.
END = "\0"
TOKEN = re.compile(r"[^\W_]+(?:['’*@$!][^\W_]+)*|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
FEATURES = 5


class Lexicon:
    """Stems as a trie, walked with up to one edit; states are made when first reached."""

    def __init__(self, stems: list[str]) -> None:
        self.stems = stems
        self.children: list[dict[str, int]] = [{}]
        self.terminal: dict[int, int] = {}
        for i, stem in enumerate(stems):
            node = 0
            for ch in stem:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                node = self.children[node][ch]
            self.terminal[node] = i
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.memo: dict[str, tuple[tuple[int, int], ...]] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        for node, edits in list(items):  # a letter of the stem is missing in the word
            if edits == 0:
                items |= {(child, 1) for ch, child in self.children[node].items() if ch != END}
        best: dict[int, int] = {}
        for node, edits in items:
            best[node] = min(edits, best.get(node, 9))
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = ((self.terminal[n], e) for n, e in key if n in self.terminal and (e == 0 or len(self.stems[self.terminal[n]].rstrip(END)) >= MIN_FUZZY))
            self.found.append(tuple(sorted(hits)))
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if (child := self.children[node].get(ch)) is not None:
                out.add((child, edits))
            if edits == 0:
                out.add((node, 1))  # the word has a letter more
                out |= {(c, 1) for k, c in self.children[node].items() if k not in (ch, END)}  # or another one
        self.moves[state][ch] = to = self._state(out) if out else -1
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """Pairs (stem, edits) that the word begins with, or is where the stem ends in END; the fewest edits of each."""
        got = self.memo.get(word)
        if got is None:
            hits: dict[int, int] = {}
            state = self.start
            for ch in (*word, END):
                state = self.moves[state].get(ch) if ch in self.moves[state] else self._step(state, ch)
                if state < 0:
                    break
                for stem, edits in self.found[state]:
                    hits[stem] = min(edits, hits.get(stem, 9))
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[word] = tuple(sorted(hits.items()))
        return got


@dataclass
class Model:
    """A lexicon, the evidence of its hits and the weights of the score; picklable, its size bounded by the sample."""

    stems: list[str]
    evidence: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    _lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lexicon": None}

    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.stems)
        return self._lexicon

    def hits(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(position, stem, edits, quoted) of each word that matches, by its strongest stem."""
        if not text or not self.stems:
            return []
        match, out, opened, at = self.lexicon().match, [], False, 0
        for token in TOKEN.findall(text.lower()):
            if token in QUOTES:
                opened = not opened
                continue
            at += 1
            if got := match(token):
                stem, edits = max(got, key=lambda h: (self.evidence.get(h, 0.0), -h[1], -h[0]))
                out.append((at, stem, edits, opened))
        return out

    def features(self, text: str | None) -> list[float]:
        """Evidence of the strongest open and quoted hit, of all open and quoted hits (logarithms), and of the densest window."""
        hits = [(at, w, quoted) for at, stem, edits, quoted in self.hits(text) if (w := self.evidence.get((stem, edits), 0.0)) > 0]
        if not hits:
            return [0.0] * FEATURES
        open_, quoted = [w for _, w, q in hits if not q], [w for _, w, q in hits if q]
        densest, low, total = 0.0, 0, 0.0
        for i, (at, w, q) in enumerate(hits):
            total += 0.0 if q else w
            while hits[low][0] < at - WINDOW:
                total -= 0.0 if hits[low][2] else hits[low][1]
                low += 1
            densest = max(densest, total)
        return [max(open_, default=0.0), max(quoted, default=0.0), math.log1p(sum(open_)), math.log1p(sum(quoted)), math.log1p(max(densest, 0.0))]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of labelled rows that may be learned from, about ``rows`` at most.

    Rows whose toxic or id is null are left out; an id with several labels is toxic if one says so.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    share = min(1.0, rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def chance(bad: int, n: int, share: float) -> float:
    """How likely ``bad`` or more of n rows are toxic if each is with the probability ``share``."""
    if n > 2000:  # then nothing that passes the other bounds is left to chance
        return 0.0
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(bad, n + 1))


def choose_stems(sample: DataFrame, counts: dict[int, int]) -> list[str]:
    """Stems (word beginnings, or whole words marked by END) that mark toxic rows.

    Of stems that begin alike the shortest counts, made longer as long as that
    keeps 0.95 of its toxic documents times their log-odds.  A stem must be too
    telling for chance, given how many words are as frequent, so a small sample
    asks for more of its documents, not for a fixed number.  Texts count once,
    in ``counts`` (of distinct texts by label) as well.
    """
    positive, negative = max(1, counts.get(1, 0)), max(1, counts.get(0, 0))
    words = sample.dropDuplicates(["text", "toxic"]).select("toxic", F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    whole = F.concat("word", F.lit(END))
    starts = F.transform(F.sequence(F.lit(MIN_STEM), F.length(whole)), lambda n: F.substring(whole, F.lit(1), n))
    table = words.filter(F.length("word") >= MIN_STEM).select(F.explode(starts).alias("stem"), "bad", "n").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    ratio = ((F.col("bad") + 0.5) / positive) / ((F.col("n") - F.col("bad") + 0.5) / negative)
    good = table.filter((F.col("bad") >= max(MIN_TOXIC, MIN_SHARE * positive)) & (ratio >= MIN_RATIO))
    often = [(r["n"], r["count"]) for r in words.filter(F.col("n") >= MIN_TOXIC).groupBy("n").count().collect()]  # a row for each frequency in the bounded sample
    tried = lambda bad: sum(count for n, count in often if n >= bad)
    share = positive / (positive + negative)
    found = [(r["stem"], r["bad"], r["n"]) for r in good.collect()]  # of the bounded sample, each in MIN_SHARE of its toxic rows
    stats = {stem: (bad, n) for stem, bad, n in found if chance(bad, n, share) * tried(bad) <= BY_CHANCE}
    shortest: list[str] = []
    for stem in sorted(stats, key=lambda s: (len(s), s)):
        if not any(stem[:n] in shortest for n in range(MIN_STEM, len(stem))):
            shortest.append(stem)
    def worth(stem: str) -> float:
        bad, n = stats[stem]
        return bad * math.log(((bad + 0.5) / positive) / ((n - bad + 0.5) / negative))

    following: dict[str, list[str]] = {}
    for stem in stats:
        following.setdefault(stem[:-1], []).append(stem)
    out = []
    for stem in shortest:
        while (longer := max(following.get(stem, []), key=lambda s: (worth(s), s), default=None)) and worth(longer) > worth(stem) * (1 if longer[-1] == END else 0.95):
            stem = longer
        out.append(stem)
    return sorted(out, key=lambda s: (-stats[s][0], s))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Weights, the constant first, by Newton's method with a ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn stems, evidence and weights from the labelled sample.

    Without toxic rows to learn from, the lexicon is empty and every score is
    near the share of toxic rows (zero without any labelled row).
    """
    sample = materialize(labelled_sample(docs, labels, rows))
    counts = {int(r["toxic"] > 0): r["count"] for r in sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        base = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 0.0
        return Model([], {}, [math.log(base / (1 - base)) if base else -30.0] + [0.0] * FEATURES)
    distinct = sample.dropDuplicates(["text", "toxic"]).groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count()
    model = Model(choose_stems(sample, {r["toxic"]: r["count"] for r in distinct.collect()}))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(stem, edits, int(t)) for text, t in zip(batch["text"], batch["toxic"]) for stem, edits in {(s, e) for _, s, e, _ in model.hits(text)}]
            yield pd.DataFrame(rows, columns=["stem", "edits", "toxic"])

    seen = sample.mapInPandas(find, "stem int, edits int, toxic int").groupBy("stem", "edits").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()  # two rows a stem at most
    for r in seen:
        odds = math.log((r["bad"] + 0.1) / counts[1]) - math.log((r["n"] - r["bad"] + 0.1) / counts[0])
        model.evidence[r["stem"], r["edits"]] = odds if odds >= MIN_EVIDENCE else 0.0
    for i in range(len(model.stems)):  # misspellings that no row shows count half of the stem
        model.evidence.setdefault((i, 1), model.evidence.get((i, 0), 0.0) / 2)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([model.features(t) for t in batch["text"]], columns=[f"f{i}" for i in range(FEATURES)])
            yield out.assign(toxic=batch["toxic"].to_numpy())

    table = sample.mapInPandas(describe, ", ".join(f"f{i} double" for i in range(FEATURES)) + ", toxic int").toPandas()  # bounded by ``rows``
    model.weights = fit_logistic(table[[f"f{i}" for i in range(FEATURES)]].to_numpy(), table["toxic"].to_numpy(dtype=float))
    return model


def score(text: Column, model: Model) -> Column:
    """Toxicity of each whole text, 0 to 1; null and empty texts score like texts without hits.

    A word that several stems match counts for the one of the most evidence,
    then the fewest edits, then the first; equal texts score alike.
    """

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return run(text)


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: bool = True) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more (or only those, if not ``keep``); columns stay as they are.

    Null and empty texts have no hits and stay; repeated rows fare alike.
    Without labels all rows stay; an empty table gives an empty one.
    """
    marked = docs.select(F.struct("*").alias("row"), score(F.col("text"), train(docs, labels)).alias("score"))
    return marked.filter(F.col("score") < threshold if keep else F.col("score") >= threshold).select("row.*")
