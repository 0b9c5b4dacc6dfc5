"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are cut into size classes by their number of shingles (powers of two).
An item's sketch holds its smallest shingle hashes: with q shingles and a
containment of t or more, a document lacks at most q - ceil(t q) of them, so
one of the q - ceil(t q) + 1 smallest is always among the document's
shingles.  The search hence loses nothing, however long the document is.
Each class has a search of its own: documents too small for it (fewer than t
times its least size) skip it.  Up to LOOKED_FOR sketch hashes are a set that
each of a document's hashes is looked up in, so only hits leave the array; of
more, the hashes up to the largest of the classes in question are joined with
them.  Documents that are hit are then verified by the containment of the
shingles' own texts.
Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, doc_key, materialize, whole_rows

WORDS = 5
THRESHOLD = 0.8
#: So many different sketch hashes at most are looked for inside the documents' arrays; more are joined.
LOOKED_FOR = 20_000
#: Anything but letters and digits parts words.
SEPARATOR = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _bound(value: Column, made) -> Column:
    """An array made of a value that is computed once, as a lambda's variable, and not again for every element."""
    return F.flatten(F.filter(F.transform(F.array(value), made), F.isnotnull))


def _starts(size: Column, n: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))


def shingles(words: Column, size: int = WORDS) -> Column:
    """Shingles joined by spaces; all words together if there are fewer; none without words."""
    return _bound(words, lambda w: F.when(F.size(w) > 0, F.transform(_starts(F.size(w), size), lambda i: F.array_join(F.slice(w, i, size), " "))))


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """A number for each of ``shingles``, made of its words' hashes (missing words hash as null), without building the texts."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    whole = lambda h: F.transform(_starts(F.size(h), size), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(size)]))
    return _bound(hashed, lambda h: F.when(F.size(h) > 0, whole(h)))


def sketches(items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """Columns item_id, key, shingles (distinct), q, least, size_class and sketch (the bottom hashes) of each different item that has words."""
    words = words_of(F.col("text"))
    return (
        items.select("item_id", F.xxhash64("text").alias("key"), "text").dropDuplicates(["item_id", "key"])
        .select("item_id", "key", F.array_distinct(shingles(words, size)).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(words, size))).alias("hashes"))
        .withColumn("q", F.size("shingles"))
        .filter("q > 0")
        .withColumn("size_class", F.floor(F.log2("q")).cast("int"))
        .withColumn("least", F.ceil(F.col("q") * threshold - 1e-9).cast("int"))
        .select("item_id", "key", "shingles", "q", "least", "size_class", F.slice("hashes", F.lit(1), F.col("q") - F.col("least") + 1).alias("sketch"))
    )


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """Pairs of documents and items of which they contain ``threshold`` or more of the distinct shingles.

    Returns k1, k2 (document key, see common.doc_key), item_id, n_item,
    n_shared and containment.  Words are runs of letters and digits,
    lower-cased; texts of fewer than ``size`` words form one shingle; null,
    empty and wordless texts match nothing.  Repeated documents share one key,
    items alike in id and text count once; extra columns are ignored.  Empty
    tables give an empty one.
    """
    known = materialize(sketches(items, threshold, size))
    probe = known.select("size_class", F.explode("sketch").alias("hash")).groupBy("hash").agg(F.min("size_class").alias("size_class"))
    probe = materialize(probe)
    hashes = shingle_hashes(words_of(F.col("text")), size)
    hashed = docs.select(*doc_key(), hashes.alias("hashes"))
    wanted_hashes = probe.select("hash").limit(LOOKED_FOR + 1).collect()  # bounded; beyond it they aren't used
    if 0 < len(wanted_hashes) <= LOOKED_FOR:
        own = F.expr(f"filter(hashes, h -> h IN ({', '.join(f'{r.hash}L' if r.hash > -(2**63) else '-9223372036854775807L - 1L' for r in wanted_hashes)}))")
    else:
        # What a document of some size looks for: the largest hash of the classes that it can hold an item of.
        largest = {r["size_class"]: r["top"] for r in known.groupBy("size_class").agg(F.max(F.array_max("sketch")).alias("top")).collect()}  # one row a class
        reach = F.greatest(*[F.when(F.size("hashes") >= threshold * 2**c - 1e-9, F.lit(top)) for c, top in largest.items()], F.lit(None).cast("long"), F.lit(None).cast("long"))
        own = F.filter("hashes", lambda h: h <= reach)
    flat = hashed.select("k1", "k2", F.size("hashes").alias("n"), F.explode(own).alias("hash"))
    hits = flat.join(broadcast_if_small(probe), "hash").filter(F.col("n") >= threshold * F.pow(F.lit(2.0), F.col("size_class")) - 1e-9)
    found = materialize(hits.select("k1", "k2").distinct())
    texts = docs.select(*doc_key(), "text").join(broadcast_if_small(found), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    own = texts.select("k1", "k2", F.explode(F.array_distinct(shingles(words_of(F.col("text")), size))).alias("shingle"))
    wanted = known.select("item_id", "key", "q", "least", F.explode("shingles").alias("shingle"))
    shared = own.join(broadcast_if_small(wanted), "shingle").groupBy("k1", "k2", "item_id", "key").agg(F.first("q").alias("q"), F.first("least").alias("least"), F.count("*").cast("int").alias("n_shared"))
    return shared.filter("n_shared >= least").select("k1", "k2", "item_id", F.col("q").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def holding_short_items(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame | None:
    """Columns k1, k2 of the documents in which all words of an item of fewer than ``size`` words follow each other; None without such items."""
    words = items.select(words_of(F.col("text")).alias("words")).filter((F.size("words") > 0) & (F.size("words") < size))
    short = words.select(F.size("words").alias("n"), F.array_join("words", " ").alias("run")).distinct()
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # fewer than ``size``
    if not lengths:
        return None
    runs = F.array_distinct(F.flatten(F.array(*[shingles(F.col("words"), n) for n in lengths])))
    own = docs.select(*doc_key(), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return own.select("k1", "k2", F.explode(runs).alias("run")).join(broadcast_if_small(short.select("run")), "run", "left_semi").select("k1", "k2").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """The documents that contain no item; all their rows and columns stay as they are.

    Items of fewer than ``size`` words are searched inside documents as well.
    Null, empty and wordless texts contain nothing and stay, as do repeated
    rows that contain nothing; without items all rows stay.
    """
    bad = contaminated(docs, items, threshold, size).select("k1", "k2").distinct()
    if (short := holding_short_items(docs, items, size)) is not None:
        bad = bad.union(short)
    return whole_rows(docs).join(broadcast_if_small(materialize(bad)), ["k1", "k2"], "left_anti").select("row.*")
