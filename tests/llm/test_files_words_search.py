"""Token files, spelling variants and ranked search against the library and plain loops, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketry.llm import queries, ranked_search, spelling, token_files
from docketry.llm.common import table

DDL = "doc_id long, text string, lang string, part int, start long, word string, n long, tie long"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "w", 3, 4) for i, t in rows], DDL)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 12))) for _ in range(8000))
    strange = ["It's <|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ς é ﬁ", "a b c\u0085d\u001ce", "́x . ́", "don't we'LL!? (so)...now 12,345.67", "日本語 text 한국어", "ÀÉÎÕÜß×÷ÿ", "_a_b__ a-b 😀 'sx", "İ ŉ ǅ ſt"]
    rows = [(7, None), (3, ""), (3, ""), (None, "two words"), (None, "two words"), (5, long), (1, "  \n\t "), (2, "...!?")]
    return rows + [(20 + i, t) for i, t in enumerate(strange)] + [(40 + i, "".join(r.choice("abc XYZ.,;:!?'éÖ0-_<|>́\n") for _ in range(200))) for i in range(20)]


def folder(tmp_path):
    return f"file://{tmp_path}/tokens"


@pytest.mark.parametrize(("name", "length", "batch"), [("word_bpe_49k.json", 1024, 64), ("word_bpe_49k.json", 5, 2), ("byte_bpe_50k.json", 7, 3)])
def test_token_files_give_back_every_id(spark, tmp_path, odd, name, length, batch):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    token_files.write(frame(spark, odd), folder(tmp_path), path, 2, length, batch)
    got = sorted(token_files.read_documents(spark, folder(tmp_path)).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in odd)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_sequences_are_views_of_equal_length(spark, tmp_path, odd):
    index = token_files.write(frame(spark, odd).repartition(3), folder(tmp_path), None, 2, 16, 4)
    for row in index.groupBy("path").agg({"n_tokens": "sum"}).collect():
        held = token_files.Sequences(row["path"])
        flat, masks = zip(*((ids, mask.to_numpy(zero_copy_only=False)) for ids, mask in (held[k] for k in range(len(held)))))
        assert {len(x) for x in (*flat, *masks)} == {16} and len(held) == -(-row[1] // 16)
        assert sum(int(m.sum()) for m in masks) == row[1] and all((np.diff(m.astype(int)) <= 0).all() for m in masks)
        assert np.array_equal(np.concatenate(flat)[: row[1]], held.ids(0, row[1])) and not flat[0].flags.owndata
        with pytest.raises(IndexError):
            held[len(held)]


def test_files_of_lost_tasks_are_deleted(spark, tmp_path, odd):
    (tmp_path / "tokens/data").mkdir(parents=True)
    (tmp_path / "tokens/data/part-000000-lost.arrow").write_bytes(b"half a file")
    token_files.write(frame(spark, odd), folder(tmp_path))
    assert not list((tmp_path / "tokens/data").glob("*lost*")) and list((tmp_path / "tokens/data").glob("*.arrow"))


def test_token_query(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op11_token_files(spark, sf_dir).collect())) == want


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


@pytest.mark.parametrize("block", [1, 3, spelling.BLOCK])
def test_near_pairs_match_all_pairs(spark, block):
    r = random.Random(block)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(150)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "x", ""]
    base += [f"common{a}{b}tail" for a in "abcd" for b in "abcdef"] + ["".join(r.choice("ab") for _ in range(40)) for _ in range(5)]
    base += [w[:i] + c + w[i + 1 :] for w in base[-5:] for i in (0, 19, 20, 39) for c in ("", "z")]
    words = sorted({w for w in base if w})
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), block).collect()
    assert sorted(tuple(sorted((p["word"], p["other"]))) for p in got) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in form.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_variants_match_brute_force(spark):
    r = random.Random(9)
    stems = ["variant", "Éléphants", "straßen×÷ÿ", "spelling", "grouping", "ordinary"]
    rows = [(i if i % 9 else None, " ".join(r.choice(stems) + r.choice(["", ".", "s", "7"]) for _ in range(r.randrange(0, 120)))) for i in range(150)]
    rows += [(900, "spellin spellin spellinx spellinx " + "spelling " * 300), (901, None), (902, ""), (900, "variant " * 200), (900, "variant " * 200), (903, "a" * 5000 + " " + "a" * 5000)]
    got = spelling.group_variants(frame(spark, rows))
    assert {tuple(x) for x in got.collect()} == brute_variants(rows) and got.count() > 10

    assert spelling.group_variants(frame(spark, [])).count() == 0
    assert spelling.group_variants(frame(spark, [(None, None), (1, "")])).count() == 0


def test_roots_follow_forms(spark):
    words = [("abcdefgh", 10_000_000), ("abcdefgi", 900_000), ("abcdefii", 80_000), ("abcdeiii", 7_000), ("abcdiiii", 600), ("abciiiii", 50), ("abiiiiii", 4), ("zzzzzzz", 3)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for w, r in got.items() if w != "zzzzzzz"} == {"abcdefgh"} and got["zzzzzzz"]["root"] == "zzzzzzz"
    assert got["abiiiiii"]["form"] == "abciiiii" and got["abcdefgh"]["form"] is None and got["abcdefgi"]["n_near"] == 2


def brute_search(docs, items, k=20):
    own = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for _, t in docs]
    sizes = [sum(c.values()) for c in own]
    n_docs, total = sum(1 for s in sizes if s), sum(sizes)
    df, out = Counter(t for c in own for t in c), []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        scores = []
        for (doc, _), c, size in zip(docs, own, sizes):
            m = 75 + 25 * size * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, at, None if null else doc, -s) for at, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("segment", "query_bytes"), [(ranked_search.SEGMENT_DOCS, ranked_search.QUERY_BYTES), (7, 200)])
def test_search_matches_brute_force(spark, segment, query_bytes):
    r = random.Random(segment)
    say = lambda n: " ".join(r.choice(["Alpha", "beta", "gamma,", "délta", "É", "x1", "common"] + [f"t{r.randrange(40)}"]) for _ in range(n))
    docs = [(r.randrange(10_000), say(r.randrange(1, 60))) for _ in range(300)] + [(5, None), (6, ""), (7, "...")]
    docs += [(20_000 + i, "tied words alpha t1") for i in range(90)] + [(None, "tied words alpha t1"), (3, "tied words alpha t1"), (3, "tied words alpha t1"), (4, "alpha " * 30_000)]
    items = [(1, "tied WORDS"), (2, "alpha alpha t1 t2 délta é"), (3, None), (4, ""), (5, "nothingofthis"), (None, "x1 t3"), (2, "beta"), (1, "tied WORDS"), (6, "common " * 50)] + [(10 + i, say(9)) for i in range(12)]
    r.shuffle(docs)
    got = ranked_search.search(frame(spark, docs).repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), segment=segment, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(frame(spark, []), items).count() == 0
    assert ranked_search.search(frame(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert [tuple(x) for x in ranked_search.search(frame(spark, [(1, "a"), (2, None)]), items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]


def test_impacts_beyond_64_bits():
    got = ranked_search.impacts(np.array([3]), np.array([10**8]), 10**12, 10**14)
    assert got.tolist() == [3 * 10**9 // (3000 + 12 * (75 + 25 * 10**20 // 10**14))]
