"""A training-data pipeline: language, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns the documents it keeps with their own
columns; the last one returns pieces of sequences. ``run`` writes what a stage returns to the shared folder and reads it again for the next one.

Defined cases, of every stage: an empty table gives no rows; repeated rows are documents of their own, but for near duplicates, where one row of them stays; texts of any length are
read whole; further columns, of whatever names, are kept until packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm import language, mixing, packing, pii, simhash
from spanveil.llm.common import settle, table
from spanveil.llm.queries import tokenizer_file

#: Five words a shingle, a similarity of 0.8 or more.
NEAR = simhash.SimHash.similar(0.8, shingle=5, prints=8)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, and so do texts that are null or have no letter; labels and ids may be null, but are not learnt from then."""
    return language.accepted(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; a null one only if there is no other. Texts without words are one group."""
    return simhash.keep_one(docs, NEAR)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become tags, of those that overlap the first one's; a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the null source is a source, a text without words has no weight; ties stand in order of the id."""
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null or empty text is its end sign alone."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the components and the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
