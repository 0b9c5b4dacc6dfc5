"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  One binary classifier of byte n-grams
predicts each bit; decoding weighs each bit's loss by how well its classifier
told the learning rows apart and takes the nearest codeword.  Texts whose two
nearest codewords lie close together are flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: At most about so many labelled rows are learned from; beyond, a hash of the id picks a share.
SAMPLE_ROWS = 20_000
#: N-grams of 1 to ORDERS bytes fall into 2 ** BUCKET_BITS buckets.
ORDERS, BUCKET_BITS = 3, 14
BUCKETS = 1 << BUCKET_BITS
#: Texts are ambiguous if the score is below this.
AMBIGUOUS = 0.75
UNDETERMINED = "und"
TOGETHER = 64


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """One row of +1 and -1 for each language: all different splits for up to 6, else the best separated of random codes."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return (1 - 2 * ((splits[None, :] >> np.arange(languages)[:, None]) & 1)).astype(np.int8)
    bits, rng = 12 + 4 * int(np.ceil(np.log2(languages))), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -bits)
        least = (bits - agree.max()) // 2
        if least > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, least
    return best


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of a whole text, lower-cased."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    found, code = [], np.zeros(len(b), np.uint32)
    for order in range(1, ORDERS + 1):
        if len(b) < order:
            break
        code = (code[: len(b) - order + 1] << np.uint32(8)) | b[order - 1 :]
        found.append(((code + np.uint32(order << 26)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS))
    return np.bincount(np.concatenate(found), minlength=BUCKETS) if found else np.zeros(BUCKETS, np.int64)


@dataclass
class Model:
    """Languages with their codewords; weights, scale and offset of each bit's classifier, and the weight of its vote."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    offset: np.ndarray
    vote: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean evidence per n-gram for each row of counts and each bit."""
        return counts.astype(np.float32) @ self.weights / np.maximum(1, counts.sum(axis=1, dtype=np.float64))[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and ambiguity; UNDETERMINED with score 0 for texts without a letter (Unicode category L) or if nothing was learned."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        good = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(good), TOGETHER):
            some = good[at : at + TOGETHER]
            z = self.margins(np.stack([gram_counts(texts[i]) for i in some])) * self.scale + self.offset
            loss = (np.logaddexp(0, -z[:, None, :] * self.code[None, :, :]) * self.vote).sum(axis=2)
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p /= p.sum(axis=1, keepdims=True)
            for i, k, row in zip(some, p.argmax(axis=1).tolist(), p):
                out[i] = (self.languages[k], float(row[k]), bool(row[k] < AMBIGUOUS))
        return out


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang and text of rows that may be learned from, about ``rows`` at most."""
    known = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(~held_out())
    share = min(1.0, rows / max(1, known.select("doc_id").count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(share * (1 << 24))).select("lang", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Count n-grams by language on Spark; make each bit's classifier from the two sides' counts; scale it on the same rows."""
    sample = materialize(labelled_sample(docs, rows))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total[lang] = total.get(lang, 0) + gram_counts(text)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": some.astype(np.int32), "n": counts[some]})

    table = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    languages = sorted(table["lang"].unique())
    code = codewords(len(languages))
    bits = code.shape[1]
    counts = np.zeros((len(languages), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(bits)], axis=1) if bits else np.zeros((BUCKETS, 0))
    model = Model(languages, code, weights.astype(np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    if not bits:
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), TOGETHER):
                m = model.margins(np.stack([gram_counts(t) for t in texts[at : at + TOGETHER]]))
                yield pd.DataFrame(m, columns=[f"m{b}" for b in range(bits)]).assign(lang=batch["lang"].tolist()[at : at + TOGETHER])

    seen = sample.mapInPandas(measure, ", ".join(f"m{b} double" for b in range(bits)) + ", lang string").toPandas()  # bounded by ``rows``
    own = code[seen["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)]
    for b in range(bits):
        model.scale[b], model.offset[b], wrong = _calibrate(seen[f"m{b}"].to_numpy(), own[:, b])
        model.vote[b] = max(0.05, 1 - 2 * wrong)
    return model


def _calibrate(margin: np.ndarray, sign: np.ndarray) -> tuple[float, float, float]:
    """Scale and offset of a logistic fit with a ridge, and the share of rows it gets wrong."""
    x = np.stack([margin / (margin.std() + 1e-12), np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(2), x.T @ ((sign > 0) - p) - w)
    return w[0] / (margin.std() + 1e-12), w[1], float((((x @ w) > 0) != (sign > 0)).mean())


def identify(text: Column, model: Model) -> Column:
    """A struct lang, score, ambiguous for each whole text.

    Null and letterless texts are UNDETERMINED with score 0 and ambiguous;
    only the text is looked at, so repeated rows agree.  Of languages equally
    near the first by name is taken.
    """

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.predict(batch.tolist()), columns=["lang", "score", "ambiguous"])

    return run(text)
