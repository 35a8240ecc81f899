"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All stages but the
last return the columns that they were given, whatever further columns there
are, and what they keep they keep whole.

Null or empty texts have no language, so the first stage drops them; a later
stage that is given some treats them as texts without words: equal to each
other for the exact and the near copies, never contaminated, one piece of one
token when packed. Texts may be of any length. Of equal texts the largest
doc_id stays, of similar ones the smallest; rows that repeat both id and text
leave one. Rows without an id are judged like others by the exact stage and
never count as near copies. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import decontaminate, exact_dedup, langid, packing, simhash
from sentrylake.llm.util import crc_mod, land, remove, scratch, table, work_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected."""
    return langid.keep_identified(docs, langid.fit(docs, training=crc_mod(F.col("doc_id"), 4) != 2))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, leaves the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its token ids and its place in a sequence."""
    return packing.pack(packing.pieces(docs, with_ids=True))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Fingerprints, the language model and token ids are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages before it wrote is removed once the next one is done."""
    docs, path, before = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = land(stage(spark, docs, sf_dir), f"{path}/{name}")
        if before:
            remove(spark, f"{path}/{before}")
        before = name
    return docs
