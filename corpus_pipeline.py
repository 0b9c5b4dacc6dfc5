"""Cleans and mixes the ``documents`` table, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import decontamination, line_dedup, mixing, simhash, toxicity
from docketry.llm.common import materialize, table

MIX_SEED = 11
#: Near duplicates: words of a shingle, bits between fingerprints, and the least share of common shingles.
NEAR_WORDS, NEAR_DISTANCE, NEAR_SIMILARITY = 5, 4, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity, learned from the labels table; rows stay as they are.

    Null and empty texts stay, equal texts fare alike, and a table without
    labels or rows loses none.
    """
    return toxicity.rejected(docs, table(spark, sf_dir, "labels"))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates and recurring long lines; n_chars follows the text.

    Null texts stay null, rows alike in id and text change alike, and no row goes.
    """
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, ties by text hash.

    Two texts are near duplicates if they share 0.8 of their five-word shingles
    or their fingerprints are at most four bits apart.  Null and wordless texts
    are one group; of rows alike in id and text the first as JSON stays.
    """
    return simhash.deduplicate(docs, NEAR_WORDS, NEAR_DISTANCE, NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: less than 0.8 of the shingles of each, and no short item as a whole.

    Null, empty and wordless texts and items hold nothing, and rows alike fare alike.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources have the same expected number of rows, numbered ``copy`` and shuffled.

    Rows alike in id and text get as many copies; the null source is one of its own.
    """
    return mixing.mix(docs, None, 1.0, MIX_SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_template_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the toxicity model and the order-dependent template tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each one's result is written to the shared scratch folder and read by the next.

    Every stage takes nulls in any column, empty and long texts, ties, repeated
    rows and columns whatever their names, and makes an empty table of an empty
    one; see the stages for what each does with them.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
