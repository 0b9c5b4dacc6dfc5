"""The queries of the training-data operators, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, decontamination, language_id, line_dedup, media, mixing, ranked_search, simhash, spelling, suffix_tree_dedup, token_files, toxicity, url_filter
from .common import doc_key, held_out, materialize, scratch_dir, table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
MIX_SEED = 7


def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes outside 200-byte strings that start anywhere else as well, as digests. Null text is empty."""
    cut = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n") - F.length("kept")
    return cut.select("doc_id", F.col("n").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words outside windows of 35 that start anywhere else as well, as digests. Null text has no words."""
    cut = suffix_tree_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return cut.select("doc_id", F.col("n").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source has the same expected number of rows."""
    return mixing.mix(table(spark, sf_dir, "documents"), None, 1.0, MIX_SEED)


OP2_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, count(*) OVER () AS sources, sum(count(*)) OVER () AS total FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / sources::DOUBLE) * total::DOUBLE / n::DOUBLE AS rate FROM s),
terms AS (SELECT source, rate, unnest(range(0, 1 + ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r),
p AS (SELECT source, k, exp(-rate) * coalesce(product(rate / nullif(k, 0)) OVER (PARTITION BY source ORDER BY k), 1.0) AS p FROM terms),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source),
d AS (SELECT d.*, cdf.cdf, (('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, chr(0)) || '|' || coalesce(md5(text), chr(0)) || '|1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, len(list_filter(cdf, lambda c: c < u))))::INTEGER AS copy FROM d
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item and the containment of its 5-word shingles."""
    docs = table(spark, sf_dir, "documents")
    pairs = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", *doc_key()).join(pairs, ["k1", "k2"]).select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(q)::INTEGER AS n_item, count(*)::INTEGER AS n_shared, count(*)::DOUBLE / any_value(q)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(q) * 0.8 - 1e-9)
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the longest rule that fits, and its verdict. Null urls have empty parts."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP5_SQL = f"""
WITH r(rhost, rpath, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM c LEFT JOIN (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM c) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
) m ON c.host = m.host AND c.path = m.path
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned from rows that are not held out. Texts without a letter are und."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), language_id.identify(F.col("text"), language_id.train(docs)).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a WAV: digests of what is read back and of the stored form, and of its peak pairs. Null text is empty."""
    made = media.media_column(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.BLOCK, media.BLOCK)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes"), F.sha2(F.array_join(F.transform("codes", lambda c: F.hex(c)), ",").cast("binary"), 256)).alias("feature"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of fingerprints at most four bits apart. Null text has fingerprint zero."""
    return simhash.component_ids(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of templates that recur across documents."""
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
parted AS (SELECT doc_id, pos, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS own FROM raw),
masked AS (SELECT *, list_transform(own, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM parted),
judged AS (SELECT * FROM masked WHERE len(w) >= 3 AND 2 * len(list_filter(w, lambda x: x = '<*>')) <= len(w)),
lines AS (SELECT DISTINCT w FROM judged),
each AS (SELECT w, len(w) AS n, w[1:3] AS head, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lines),
ranked AS (SELECT w, n, pos, word, row_number() OVER (PARTITION BY w ORDER BY support, pos DESC) AS r FROM (SELECT *, count(*) OVER (PARTITION BY n, head, pos, word) AS support FROM each)),
named AS (SELECT w, string_agg(CASE WHEN r <= (3 * n) // 10 THEN '<*>' ELSE word END, ' ' ORDER BY pos) AS template FROM ranked GROUP BY w),
often AS (SELECT template, min(doc_id) AS f FROM judged JOIN named USING (w) GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
copied AS (SELECT own, min(doc_id) AS f FROM judged WHERE len(own) >= 10 GROUP BY own HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT doc_id, pos FROM judged JOIN named USING (w) JOIN often USING (template) WHERE doc_id <> f UNION SELECT doc_id, pos FROM judged JOIN copied USING (own) WHERE doc_id <> f),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id FROM gone)
SELECT d.doc_id, CASE WHEN hit.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, d.lang, d.source,
  CASE WHEN hit.doc_id IS NULL THEN d.n_chars ELSE length(coalesce(kept.text, '')) END AS n_chars
FROM documents d LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from labelled rows that are not held out. Null and empty texts score like texts without hits."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and token ids as its Arrow files give them back. Null text is the end id alone."""
    folder = f"{scratch_dir(spark)}/docketry-tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder)
    read = materialize(token_files.read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    token_files.delete(folder)
    return read


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, the form that it varies and that form's root. Null text has no words."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
long AS (SELECT run, count(*) AS n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS codes FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(codes, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))),
  lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]))) AS h FROM long, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM near),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND b.r = 1),
way AS (SELECT word, word AS at FROM words UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON way.at = f.word WHERE f.form IS NOT NULL)
SELECT formed.word, formed.form, way.at AS root, formed.n, formed.n_near, formed.form_n FROM formed JOIN way ON formed.word = way.word JOIN formed last ON way.at = last.word WHERE last.form IS NULL
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's 20 best documents. Null texts have no terms; equal scores are in order of doc_id."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT count(*)::BIGINT AS N, sum(len(t))::BIGINT AS L FROM d WHERE len(t) > 0),
p AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
scored AS (SELECT q.item_id, p.k, any_value(p.doc_id) AS doc_id, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * p.n * s.N) // s.L)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY q.item_id, p.k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bwt_dedup": op1_bwt_dedup,
    "op2_mix": op2_mix,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_suffix_tree_dedup": op8_suffix_tree_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_spelling": op12_spelling,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op2_mix": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_url_filter": OP5_SQL, "op9_line_dedup": OP9_SQL, "op12_spelling": OP12_SQL, "op13_ranked_search": OP13_SQL}
