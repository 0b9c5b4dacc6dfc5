"""The pipeline's stages: their schemas, their decisions, and odd tables."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from docketry.llm import queries, toxicity
from docketry.llm.common import materialize, table
from test_operators import brute_lines, groups, words


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        n = out.count()
        assert n == before if name == "line dedup" else 0.5 * before < n <= before


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 20
    assert set(table(spark, sf_dir, "documents").columns) <= set(out.columns)


@pytest.mark.parametrize("at", range(5))
def test_stages_on_empty_tables(spark, sf_dir, at):
    empty = table(spark, sf_dir, "documents").limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string, gone int, copy int"
MASK = (1 << 64) - 1


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def key(row):
    whole = signed(xxhash.xxh64_intdigest((row["text"] or "").encode(), 42))
    return (whole if row["doc_id"] is None else row["doc_id"], whole)


def plain_lines(rows):
    texts = brute_lines(list({key(r): r["text"] for r in rows}.items()))
    out = []
    for r in rows:
        text = texts[key(r)]
        out.append(r if text == r["text"] else r | {"text": text, "n_chars": len(text)})
    return out


def shingles_of(text):
    tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    return [" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))] if tokens else []


def plain_near(rows):
    first = {}
    for r in rows:
        shown = json.dumps(r, ensure_ascii=False, separators=(",", ":"))
        first[key(r)] = min(first.get(key(r), (shown, r)), (shown, r), key=lambda x: x[0])
    keys = sorted(first)
    sets, fps = [], []
    for k in keys:
        own = shingles_of(first[k][1]["text"])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
        sets.append(set(own))
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = groups(list(range(len(keys))), near)
    return [first[k][1] for k, g in zip(keys, group) if k == keys[group.index(g)]]


def plain_clean(rows, items):
    words_of = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = lambda w, n: {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    asked = [words_of(t) for t in items]

    def holds(text):
        w = words_of(text)
        return any(i and (len(runs(w, 5) & runs(i, 5)) >= 0.8 * len(runs(i, 5)) - 1e-9 or len(i) < 5 and " ".join(i) in runs(w, len(i))) for i in asked)

    return [r for r in rows if not holds(r["text"])]


def plain_mix(rows):
    size, out = Counter(r["source"] for r in rows), []
    for r in rows:
        rate = len(rows) / len(size) / size[r["source"]]
        digest = "\0" if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()
        u = (int(hashlib.md5(f"{corpus_pipeline.MIX_SEED}|{chr(0) if r['doc_id'] is None else r['doc_id']}|{digest}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total < u:
            k += 1
            p *= rate / k
            total += p
        out += [r | {"copy": i} for i in range(k)]
    return out


@pytest.fixture(scope="module")
def odd_corpus(spark, tmp_path_factory):
    """A corpus of nulls, repeated rows, ties, long texts and columns that the stages use inside, with something for every stage."""
    r = random.Random(12)
    text = lambda seed, n: words(seed, n, 3000)
    item, rows, labels = text(5000, 30), [], []
    footer, long_line = "please contact the help desk before noon", "this very long line of many words is copied to exactly two of the documents here"

    def add(i, t, source="a", **more):
        rows.append({"doc_id": i, "text": t, "lang": "en", "source": source, "n_chars": None if t is None else len(t), "row": "x", "k1": None, "gone": 1, "copy": 7} | more)

    for i in range(160):
        body = text(i, r.randrange(20, 60)) + "\n" + text(1000 + i, 30)
        toxic = i % 5 == 0
        if toxic:
            body += " you " + ["idiot", "moron", "scum"][i // 5 % 3] + " " + text(9000 + i, 4) + " moron idiot"
        if i % 7 == 1:
            body += "\n" + footer
        if i in (3, 4):
            body += "\n" + long_line
        if i % 40 == 2:
            body += "\n" + text(7000 + i, 8) + " " + item + " " + text(7500 + i, 8)
        if i == 9:
            body += " the Tiny, ITEM here"
        add(i, body, ["a", "b", None, "a"][i % 4])
        labels.append((i, int(toxic)))
    for i in range(10):  # near copies of clean documents: a word less, or one other word
        base = text(2000 + i, 120)
        add(300 + 2 * i, base, "b")
        add(301 + 2 * i, base.rsplit(" ", 1)[0] + (" other" if i % 2 else ""), "b")
    add(400, text(2100, 20_000), "a")
    add(401, text(2100, 20_000) + " end", "a")
    for i in (500, 501, None, None):
        add(i, None)
    add(502, "")
    add(503, " \n\t ")
    add(None, text(2200, 50))
    add(None, text(2200, 50))
    add(None, text(2201, 50), None)
    for gone in (3, 2):  # alike in id and text
        add(600, text(2300, 50), "a", gone=gone)
    add(600, text(2301, 50), "a")  # alike in id only
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([tuple(x.values()) for x in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [item, "tiny item", None, "", text(6000, 40)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage_and_the_whole_match_plain_python(spark, odd_corpus):
    folder, rows, items = odd_corpus
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    plain = [lambda x: [r for r in x if model.score(r["text"]) < toxicity.THRESHOLD], plain_lines, plain_near, lambda x: plain_clean(x, items), plain_mix]
    show = lambda found: Counter(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in found)
    docs, want = table(spark, folder, "documents"), rows
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, plain):
        given, before, want = want, len(want), by_hand(want)
        docs = materialize(stage(spark, docs, folder))
        assert show(r.asDict() for r in docs.collect()) == show(want), name
        assert name in ("line dedup", "mixing") or len(want) < before
        assert show(want) != show(given)
    assert show(r.asDict() for r in corpus_pipeline.run(spark, folder).collect()) == show(want)
