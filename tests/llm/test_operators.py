"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import binascii
import functools
import hashlib
import io
import math
import random
import re
import wave
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import bwt_dedup, decontamination, language_id, line_dedup, media, mixing, queries, repeats, simhash, suffix_tree_dedup, toxicity, url_filter
from docketry.llm.common import table

DDL = "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 int, copy int, line string, fp string, __k1 string, hash string"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None, "x", 1, 2, "l", "f", "k", "h") for i, t, lang, src in rows], DDL)


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(1, 20_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (None, words(2, 80), "fr", "b"), (None, words(2, 80), "fr", "b"), (5, long, "en", "a"), (6, words(3, 60), None, None), (7, "…!? 12", "de", "b"), (8, "É" * 300, "fr", "a")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def planted(spark):
    """Documents that share passages, lines and whole texts."""
    r = random.Random(5)
    passage, rows = words(77, 60), []
    for i in range(60):
        body = words(100 + i, r.randrange(5, 150)).split()
        if i % 4 == 0:
            at = r.randrange(len(body))
            body[at:at] = passage.split()[: r.choice([20, 34, 35, 36, 60])]
        rows.append((i, " ".join(body), "en", "a" if i % 3 else "b"))
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(5)] + [(200 + i, "ab" * 150 + words(i, 5), "en", "b") for i in range(3)] + [(300, "é" * 150 + "tail", "en", "b")]
    return rows


def brute_repeats(texts, window, as_words):
    parts = [((t or "").encode().split() if as_words else (t or "").encode()) for t in texts]
    key = (lambda s, i: tuple(s[i : i + window])) if as_words else (lambda s, i: s[i : i + window])
    n = Counter(key(s, i) for s in parts for i in range(len(s) - window + 1))
    out = []
    for s in parts:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if n[key(s, i)] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(s, gone) if not g] if as_words else bytes(x for x, g in zip(s, gone) if not g)
        out.append((len(s), b" ".join(kept) if as_words else kept, sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return out


@pytest.mark.parametrize(("module", "as_words", "window", "gram"), [(bwt_dedup, False, 200, 32), (suffix_tree_dedup, True, 35, 4), (bwt_dedup, False, 40, 8), (suffix_tree_dedup, True, 6, 2)])
@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeats_match_brute_force(spark, planted, module, as_words, window, gram, group):
    docs = frame(spark, [*planted, (None, planted[0][1], None, None), (1000, None, None, None), (1001, "", None, None), (1002, "short", None, None)])
    got = module.remove_repeats(docs, window, gram, group).collect()
    rows = docs.collect()
    want = Counter((r["doc_id"], n, kept, removed, spans) for r, (n, kept, removed, spans) in zip(rows, brute_repeats([r["text"] for r in rows], window, as_words)))
    assert Counter((r["doc_id"], r["n"], bytes(r["kept"]), sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"])) for r in got) == want


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl"])
@pytest.mark.parametrize("window", [14, 16, 24])
def test_finders_find_all_repeats(letters, window):
    r = random.Random(window)
    core, some = r.choices("ab", k=12), lambda: r.choices(letters, k=r.randrange(20))
    made = [(head := some()) and head + core + some() or core + some() for _ in range(300)]
    data = ["".join(x).encode() for x in made if len(x) >= window]
    anchors, weights = np.array([d.index("".join(core).encode()) for d in data]), np.array([r.choice([1, 1, 1, 2]) for _ in data])
    width = next(w for w in (8, 4, 2, 1) if window % w == 0)
    for find, parts, aligned in ((bwt_dedup.repeated, data, width), (suffix_tree_dedup.repeated, [[bytes([c]) for c in d] for d in data], 1)):
        owner, start, depth = find(parts, anchors, weights, window)
        n, far = Counter(), Counter()
        for d, a, w in zip(data, anchors, weights):
            for i in range(len(d) - window + 1):
                for j in range(i + window, len(d) + 1):
                    far[(i - a) % aligned, d[i:j]] += w
                n[(i - a) % aligned, d[i : i + window]] += w
        assert list(zip(owner, start)) == [(k, i) for k, (d, a) in enumerate(zip(data, anchors)) for i in range(len(d) - window + 1) if n[(i - a) % aligned, d[i : i + window]] > 1]
        for k, i, m in zip(owner.tolist(), start.tolist(), depth.tolist()):  # no longer string repeats from there
            key = lambda m: far[(i - anchors[k]) % aligned, data[k][i : i + m]]  # noqa: E731, B023
            assert key(m) > 1
            assert i + m + aligned > len(data[k]) or key(m + aligned) == 1


def test_transform_and_common_prefixes(tmp_path):
    r = random.Random(4)
    texts = [r.choices(range(3), k=r.randrange(9)) for _ in range(60)]
    counts = np.array([len(t) for t in texts])
    files = bwt_dedup.Columns(str(tmp_path), {"transform": np.int32, "common": np.uint8})
    text, length = bwt_dedup.build(np.array([x for t in texts for x in t], np.int32), np.cumsum(counts), counts, files)
    suffixes = [texts[t][len(texts[t]) - n :] for t, n in zip(text, length)]
    assert suffixes == sorted(t[i:] for t in texts for i in range(len(t)))
    assert files.read("transform").tolist() == [texts[t][-n - 1] if n < len(texts[t]) else -1 for t, n in zip(text, length)]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert files.read("common").tolist() == [0] + [shared(a, b) for a, b in zip(suffixes, suffixes[1:])]
    files.close()


def test_repeats_on_odd_and_empty_tables(odd, none):
    for module in (bwt_dedup, suffix_tree_dedup):
        assert module.remove_repeats(none).count() == 0
        got = module.remove_repeats(odd).collect()
        assert len(got) == 10
        assert {r["n"] for r in got if r["doc_id"] in (1, 2)} == {0}
        assert all(bytes(r["kept"]) == b"" for r in got if r["doc_id"] is None)  # repeated rows are repeats of each other


def test_mixing_matches_brute_force(spark):
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate(["a"] * 200 + ["b"] * 40 + [None] * 10)]
    docs = frame(spark, rows)
    weights, budget, seed = {"a": 1.0, "b": 3.0, None: 1.0, "gone": 5.0}, 2.0, 3
    got = Counter(r["doc_id"] for r in mixing.mix(docs, weights, budget, seed).collect())
    size = Counter(r[3] for r in rows)
    for i, _, _, s in rows:
        rate = weights[s] / 5 * budget * len(rows) / size[s]
        u = (int(hashlib.md5(f"{seed}|{i}|{hashlib.md5(f't{i}'.encode()).hexdigest()}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total < u:
            k += 1
            p *= rate / k
            total += p
        assert got.get(i, 0) == k
    copies = mixing.mix(docs, weights, budget, seed).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r["m"] == r["n"] - 1 for r in copies)


def test_mixing_large_rates_weights_and_odd_tables(spark, odd, none):
    one = frame(spark, [(1, "t", "en", "a")])
    assert abs(mixing.mix(one, None, 2000.0, 1).count() - 2000) < 300
    assert mixing.mix(one, {}, 1.0).count() == 0
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError, match="finite"):
        mixing.mix(one, {"a": float("nan")})
    mixed = mixing.mix(odd, None, 30.0)
    assert set(mixed.columns) == set(odd.columns)
    assert {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()} == {1, 2, 3, None, 5, 6, 7, 8}


@pytest.mark.parametrize("looked_for", [decontamination.LOOKED_FOR, 0])
def test_decontamination(spark, odd, none, monkeypatch, looked_for):
    monkeypatch.setattr(decontamination, "LOOKED_FOR", looked_for)
    item = words(900, 40)
    edited = item.split()
    edited[20] = "other"
    far = item.split()
    for i in range(3, 40, 6):
        far[i] = "other"
    docs = frame(spark, [(1, words(1, 9000) + " " + item.upper() + " " + words(2, 9000), "en", "a"), (2, words(3, 50) + " " + " ".join(edited), "en", "a"), (3, " ".join(far), "en", "a"), (4, words(4, 100), "en", "a"), (5, "tiny item", "en", "a"), (6, None, None, None), (7, "", "en", "a"), (1, words(9, 9), "en", "a")])
    items = spark.createDataFrame([(10, item, 1), (11, "Tiny, item!", 2), (12, None, 3), (13, "", 4), (14, "?!", 5), (10, item, 6)], "item_id long, text string, k1 int")
    got = {(r["item_id"], r["n_item"], r["n_shared"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(10, 36, 36), (10, 36, 31), (11, 1, 1)}
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 3, 4, 6, 7]
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).count() == odd.count()


def test_short_items_are_found_inside_documents(spark):
    texts = [words(1, 30) + " Tiny, ITEM! " + words(2, 30), words(3, 30) + " tiny other item", "item", words(4, 9) + " one two three four", None, "", "tiny items"]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    items = spark.createDataFrame([(1, "tiny item"), (2, "One two three: four"), (3, None), (4, words(900, 40))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == [1, 2, 4, 5, 6]


@pytest.mark.parametrize("looked_for", [decontamination.LOOKED_FOR, 0])
def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch, looked_for):
    monkeypatch.setattr(decontamination, "LOOKED_FOR", looked_for)
    monkeypatch.setattr(decontamination, "broadcast_if_small", lambda df, *a: df)
    item = words(900, 40)
    docs = frame(spark, [(i, words(i, 30) + " " + (item if i % 2 else words(50 + i, 20)), "en", "a") for i in range(10)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == [0, 2, 4, 6, 8]


def test_language_id_held_out(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right = got.filter("lang_pred = lang").count()
    assert right >= 0.95 * got.count() > 20


def test_language_id_odd_tables(odd, none):
    model = language_id.train(odd)
    got = odd.select("doc_id", language_id.identify(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    assert all(r["lang"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 7))
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = language_id.train(none)
    assert {r["p"]["lang"] for r in odd.select(language_id.identify(F.col("text"), empty).alias("p")).collect()} == {"und"}


def test_only_letters_have_a_language(spark):
    docs = frame(spark, [(i, words(i, 30).replace("w", "wa" if i % 2 else "ko"), "en" if i % 2 else "de", "a") for i in range(60)])
    model = language_id.train(docs)
    signs = ["²", "½ 12", "①₃", "Ⅷ", "\u0301\u0302", "_-_", "12", "٣", None, ""]
    assert {x[0] for x in model.predict(signs)} == {"und"}
    assert "und" not in {x[0] for x in model.predict(["a", "É", "ª", "中", "ʰ", "ǅ"])}


def test_language_query_matches_the_model(spark, sf_dir):
    """The query's rows against a decoder in plain Python."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    for r in queries.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        grams = Counter(b[i : i + n] for b in [r["text"].lower().encode()] for n in (1, 2, 3) for i in range(len(b) - n + 1))
        bucket = lambda g: ((int.from_bytes(g) + (len(g) << 26)) * 2654435761 & 0xFFFFFFFF) >> 18
        total = sum(grams.values())
        z = [sum(n * float(model.weights[bucket(g), b]) for g, n in grams.items()) / total * model.scale[b] + model.offset[b] for b in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-x * c)) * v if x * c > -30 else -x * c * v for x, c, v in zip(z, code, model.vote)) for code in model.code.tolist()]
        odds = [math.exp(min(loss) - x) for x in loss]
        assert r["lang_pred"] == model.languages[loss.index(min(loss))]
        assert abs(r["score"] - 1 / sum(odds)) < 1e-3


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 40])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 4 else 2)
    assert all(len(set(bit)) == 2 for bit in code.T)


def test_url_filter(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("", "", "block")][:-1], "host string, path string, action string")
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/71?x#y", "http://a.b.example.com/en/8", "http://example.com/EN/7", "http://notexample.net/de/8", "http://example.net/de/81", "x://com", "x://com/en/", "x://a.org/es/q?://b", "x://org?/es/", "http://u@host.com:80/en/", "http://ex\nample.com/en/1"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] * 2 + [(None, "x://com/en/", "", "")], "page_id long, url string, host string, rule string")
    for r in url_filter.judge(pages, rules).collect():
        if r["page_id"] is None:
            assert r["rule"] == "com/en/"
            continue
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, a) for h, p, a in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[1], want[2])
    assert url_filter.judge(pages, rules).count() == len(urls) * 2 + 1
    assert url_filter.judge(pages, rules.limit(0)).filter("verdict = 'allow' AND rule IS NULL").count() == len(urls) * 2 + 1
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    both = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/", "allow"), ("com", "", "block")], "host string, path string, action string")
    assert {r["verdict"] for r in url_filter.judge(pages.filter("page_id = 10"), both).collect()} == {"allow"}


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word is written out here, not taken from the query."""
    urls = {"http://com/en/": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/1": ("net/de/", "allow"), "http://example.net/de/81": ("example.net/de/8", "block"), "http://org/es/": ("org/es/", "block"), "http://net/": (None, "allow")}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op5_url_filter(spark, str(tmp_path)).collect()} == dict(enumerate(urls.values()))


def groups(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_links_connect_all_near_fingerprints(spark, block):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 7)))
            fps.add(f)
    fps = [f - (1 << 63) for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {row["node"]: row["root"] for row in simhash.components(simhash.links(df, block=block)).collect()}
    want = groups(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert len({(w, roots.get(f, f)) for w, f in zip(want, fps)}) == len(set(want)) == len({roots.get(f, f) for f in fps})
    assert all(roots.get(f, f) <= f for f in fps)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_near_fingerprints_share_a_cell(distance):
    r = random.Random(distance)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << i for i in r.sample(range(64), distance))
        fps = np.array([a, b], np.uint64).view(np.int64)
        cell, row = simhash.cells(fps, distance)
        assert set(cell[row == 0]) & set(cell[row == 1])
        counts = simhash.segment_counts(fps, 2).astype(int)
        u = simhash.unary(fps)
        assert np.bitwise_count(u[0] ^ u[1]) == abs(counts[0] - counts[1]).sum() <= distance


def test_component_ids_match_brute_force(spark):
    r, rows = random.Random(9), []
    for i in range(40):
        base = words(i, 12, 40).split()
        for j in range(5):
            edited = list(base)
            for _ in range(j // 2):
                edited[r.randrange(len(edited))] = f"e{r.randrange(5)}"
            rows.append((1000 - 10 * i - j, None if i == 3 else "" if i == 4 else " ".join(edited).upper(), "en", "a"))
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.component_ids(frame(spark, rows)).collect()}
    fps = []
    for _, t, *_ in rows:
        tokens = (t or "").lower().split()
        shingles = [" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    assert got == {i: (f"{f:016x}", least[g]) for (i, *_), f, g in zip(rows, fps, group)}
    assert 5 < len(set(least.values())) < 170


def test_fingerprint_matches_sql_hash(spark):
    text = "The quick  BROWN fox\tjumps över the lazy dog\x0bagain"
    tokens = [bytes(c + 32 if 65 <= c <= 90 else c for c in w).decode() for w in text.encode().split()]
    shingles = [" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)]
    hashes = [row[0] & (1 << 64) - 1 for row in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_odd_tables(spark, odd, none):
    assert simhash.component_ids(none).count() == 0
    assert simhash.deduplicate(none).count() == 0
    got = simhash.component_ids(odd).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == simhash.near_duplicates(odd).select("component").distinct().count()


@pytest.mark.parametrize("most", [simhash.TEXTS_AT_ONCE, 4])
def test_pipeline_drops_documents_that_share_most_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(simhash.jaccard_links, "__defaults__", (most,))
    shingles = lambda text: {tuple(text.split()[i : i + 5]) for i in range(max(1, len(text.split()) - 4))}
    rows = []
    for i in range(12):
        base = words(700 + i, 150)
        rows.append((100 * i, base, "en", "a"))
        for j in range(4):  # the last shares about 0.73 of the shingles
            edited = base.split()
            for k in range(j if j < 3 else 5):
                edited[10 + 25 * k] = f"other{i}x{j}"
            rows.append((100 * i + j + 1, " ".join(edited), "en", "a"))
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    texts = [t for _, t, *_ in rows]
    near = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) or (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).__and__((1 << 64) - 1).bit_count() <= 4
    want = groups(texts, near)
    assert len(set(want)) < len(set(groups([simhash.fingerprint(t) for t in texts], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)))
    assert kept.count() == len(set(want))


def test_media_round_trip(odd, none):
    assert media.media_column(none).count() == 0
    got = media.media_column(odd).collect()
    assert len(got) == 10
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        data = texts[r["doc_id"]]
        payload = data + bytes(-len(data) % 64 if data else 64)
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            assert w.readframes(w.getnframes()) == payload
        assert (r["n_bytes"], bytes(r["payload"])) == (len(data), payload)
        assert r["codes"] == sorted(r["codes"])
    assert len({tuple(r["codes"]) for r in got if r["doc_id"] == 3}) == 1


def test_media_query_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op7_media(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + bytes(-len(data) % 64 if data else 64)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        codes = media.fingerprint(payload).tolist()
        feature = f"{len(codes)}:{hashlib.sha256(','.join(f'{c:X}' for c in codes).encode()).hexdigest()}"
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest(), feature)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) == want


def test_media_peaks_match_a_plain_transform():
    """Every frame's strongest bins against a Fourier sum written out, and the pairs' codes against loops."""
    r = random.Random(6)
    samples = bytes(r.randrange(256) for _ in range(2600))
    frames = [(samples + bytes([128] * 4096))[i * media.HOP : i * media.HOP + media.FRAME] for i in range(5)]
    found = media.peaks(samples)
    assert len(found) == 5
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1)) for k in range(media.FRAME)]
    k = np.arange(media.FRAME)
    for f, frame_ in enumerate(frames):
        x = (np.frombuffer(frame_, np.uint8).astype(float) - 128) * window
        for b, (low, high) in enumerate(zip(media.BANDS, media.BANDS[1:])):
            power = {i: abs((x * np.exp(-2j * np.pi * i * k / media.FRAME)).sum()) for i in range(low, high)}
            assert power[int(found[f, b])] >= max(power.values()) - 0.01
    want = sorted((f << 32) | (int(found[f, b]) << 22) | (int(found[f + d, (b + 1) % 4]) << 12) | (b << 4) | d for d in range(1, media.AHEAD + 1) for f in range(5 - d) for b in range(4))
    assert media.fingerprint(samples).tolist() == want


def test_media_finds_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 100 * t / media.FRAME)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone)[:-1, 2].tolist()) == {100}


def test_line_dedup(spark, odd, none):
    letters = lambda text: text.translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, f"{letters(words(i, 6))}\n{words(i, 4)}\nOrder {i} shipped by unit {i * 7} today\nok\n{letters(words(50 + i, 8))}", "en", "a") for i in range(10)]
    rows += [(20, "Order 99 shipped by unit 3 today", "en", "a"), (21, None, None, None), (22, "", "en", "a"), (23, "ok", "en", "b")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    kept = [i for i, r in got.items() if "shipped" in (r["text"] or "")]
    assert kept == [0]
    for i in range(1, 10):
        assert got[i]["text"] == f"{letters(words(i, 6))}\n{words(i, 4)}\nok\n{letters(words(50 + i, 8))}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[20]["text"], got[20]["n_chars"], got[21]["text"], got[22]["text"], got[23]["text"]) == ("", 0, None, "", "ok")
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.drop_lines(none).count() == 0
    assert Counter(r["text"] for r in line_dedup.drop_lines(odd).collect()) == Counter(r["text"] for r in odd.collect())


def test_line_templates_generalise_positions(spark):
    names = ["anna", "bert", "carl", "dora", "emil"]
    docs = frame(spark, [(i, f"the night shift of {n} ended early without any notice", "en", "a") for i, n in enumerate(names)])
    assert [r["doc_id"] for r in line_dedup.drop_lines(docs).collect() if r["text"]] == [0]


@pytest.mark.parametrize("n", [4_999, 5_001])
def test_leaves_of_any_size_have_the_same_templates(spark, n):
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, f"the night shift of {name(i)} ended early without any notice", "en", "a") for i in range(n)]
    rows += [(n + i, f"the night shift {name(i)} x{name(i)} y{name(i)} z{name(i)} u{name(i)} v{name(i)} w{name(i)}", "en", "a") for i in range(40)]
    left = [r["doc_id"] for r in line_dedup.drop_lines(frame(spark, rows)).collect() if r["text"]]
    assert len([i for i in left if i < n]) == 1
    assert sorted(i for i in left if i >= n) == list(range(n, n + 40))


def brute_lines(rows, min_docs=3):
    """Texts by id, by the rules of line_dedup in plain Python; ids are unique."""
    judged, leaves = [], {}
    for i, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            own = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            masked = tuple("<*>" if re.search("[0-9]", w) else w for w in own)
            if len(own) >= 3 and masked.count("<*>") * 2 <= len(own):
                judged.append((i, at, tuple(own), masked))
                leaves.setdefault((len(own), masked[:3]), set()).add(masked)
    named = {}
    for leaf, lines in leaves.items():
        support = Counter((at, w) for line in lines for at, w in enumerate(line))
        for line in lines:
            gone = sorted(range(len(line)), key=lambda at: (support[at, line[at]], -at))[: 3 * len(line) // 10]  # noqa: B023
            named[line] = leaf, tuple("<*>" if at in gone else w for at, w in enumerate(line))
    by_template, by_line = {}, {}
    for i, _, own, masked in judged:
        by_template.setdefault(named[masked], set()).add(i)
        by_line.setdefault(own, set()).add(i)
    gone = {(i, at) for i, at, own, masked in judged if len(s := by_template[named[masked]]) >= min_docs and i != min(s) or len(own) >= 10 and i != min(by_line[own])}
    return {i: text if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (i, at) not in gone) for i, text in rows}


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(8)
    pick = lambda n: [r.choice(["aa", "bb", "cc", "dd", "7x", "ä9"]) for _ in range(n)]
    lines = [" ".join(["one", r.choice("xy"), "two", *pick(r.randrange(0, 12))]) for _ in range(150)] + ["", " ", "a b", "1 2 3 x", "\ttab\x0bsep one two three four five six seven eight"]
    rows = [(i, None if i % 30 == 7 else "\n".join(r.choices(lines, k=r.randrange(6)))) for i in range(120)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_lines(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == brute_lines(rows)
    assert sum(got[i] != t for i, t in rows) > 40


def test_long_lines_recur_from_two_documents_on(spark):
    long = "the committee will publish its full report on the matter before the end of spring"
    dated = "in 2019 the committee did publish its full report on the matter before page 40 was read"
    short = "see the notes below"
    other = dated.replace("2019", "2021")
    docs = frame(spark, [(1, f"{long}\n{short}\n{dated}", "en", "a"), (2, f"{short}\n{other}\n{long}\n{dated}", "en", "a"), (3, "nothing to see", "en", "a")])
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert got == {1: f"{long}\n{short}\n{dated}", 2: f"{short}\n{other}", 3: "nothing to see"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    stems = ["idiot" + toxicity.END, "scum", "trash" + toxicity.END, "loser"]
    lexicon, r = toxicity.Lexicon(stems), random.Random(2)
    for _ in range(3000):
        stem = r.choice(stems).rstrip(toxicity.END)
        w = list(stem)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(["", "x", "s"])
        word = "".join(w) + r.choice(["", "", "s", "ing"])
        want = []
        for i, s in enumerate(stems):
            own = s.rstrip(toxicity.END)
            ends = [len(word)] if s.endswith(toxicity.END) else range(len(word) + 1)
            least = min(edits(own, word[:n]) for n in ends)
            if least == 0 or least == 1 and len(own) >= toxicity.MIN_FUZZY:
                want.append((i, least))
        assert list(lexicon.match(word)) == want, word


def test_toxicity_query_matches_the_model(spark, sf_dir):
    """The query's rows against hits by edit distance and features in plain loops."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stems = [(i, s.rstrip(toxicity.END), s.endswith(toxicity.END)) for i, s in enumerate(model.stems)]

    @functools.cache
    def weight(word):
        best = (0.0, 0, 0)
        for i, s, whole in stems:
            least = min(edits(s, word[:n]) for n in ([len(word)] if whole else range(max(0, len(s) - 1), min(len(word), len(s) + 1) + 1)))  if len(word) >= len(s) - 1 else 9
            if least == 0 or least == 1 and len(s) >= toxicity.MIN_FUZZY:
                best = max(best, (model.evidence.get((i, least), 0.0), -least, -i))
        return best[0]

    some = sorted(texts)[::4]
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    assert sorted(got) == sorted(texts)
    for i in some:
        at, opened, hits = 0, False, []
        for token in toxicity.TOKEN.findall((texts[i] or "").lower()):
            if token in toxicity.QUOTES:
                opened = not opened
                continue
            at += 1
            if (w := weight(token)) > 0:
                hits.append((at, w, opened))
        free, quoted = [w for _, w, q in hits if not q], [w for _, w, q in hits if q]
        densest = max((sum(w for a, w, q in hits if not q and b - toxicity.WINDOW <= a <= b) for b, *_ in hits), default=0.0)
        features = [max(free, default=0), max(quoted, default=0), *map(math.log1p, (sum(free), sum(quoted), densest))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], features))
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    for i, r in got.items():
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (binascii.crc32(str(i).encode()) % 4 == 2)


def toxic_rows(n=400):
    rows, labels = [], []
    for i in range(n):
        text = words(i, 40)
        if i % 4 == 0:
            text += " you " + ["idiot", "moron", "idi0t", "moronic"][i // 4 % 4] + " " + words(9000 + i, 5) + " moron"
        rows.append((i, text, "en", "a"))
        labels.append((i, int(i % 4 == 0), "x"))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs, truth = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, "x"), (5, None, "x"), (999, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, truth)
    assert {s.rstrip(toxicity.END)[:4] for s in model.stems} == {"idio", "moro"} or "moron" in {s.rstrip(toxicity.END) for s in model.stems}
    held = [i for i, *_ in rows if binascii.crc32(str(i).encode()) % 4 == 2]
    for i in held:
        assert (model.score(rows[i][1]) >= toxicity.THRESHOLD) == (i % 4 == 0)
    assert model.score("what a mor0n you m0ron") > model.score("what a nice day")
    assert model.score('he said "moron" once') < model.score("he said moron once")
    kept = toxicity.rejected(docs, truth)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_copies_of_a_toxic_text_do_not_hide_other_stems(spark):
    rows, labels = toxic_rows()
    hot = words(77, 40) + " you filthy vermin"
    rows += [(1000 + i, hot, "en", "a") for i in range(16_000)]
    labels += [(1000 + i, 1, "x") for i in range(16_000)]
    docs, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    stems = toxicity.train(docs, truth).stems
    assert any(s.startswith("mor") for s in stems), stems


def test_toxicity_odd_tables(spark, odd, none):
    rows, labels = toxic_rows(100)
    docs, truth = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.train(docs, truth)
    scores = [r["s"] for r in odd.select(toxicity.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 10
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.rejected(none, truth).count() == 0
    assert toxicity.rejected(odd, truth.limit(0)).count() == 10


def test_stems_must_be_too_telling_for_chance():
    for bad, n, share in [(3, 3, 0.1), (4, 9, 0.3), (1, 50, 0.01), (7, 7, 0.5)]:
        assert toxicity.chance(bad, n, share) == pytest.approx(sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(bad, n + 1)))
