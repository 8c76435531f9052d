"""The corpus pipeline: stages over documents, each one written and read again as the next one's input.

Quality rules and language ID drop what they reject, near-dedup keeps one document (the one with the smallest doc_id) of
each group, decontamination drops documents with a benchmark passage, and packing lays the rest into sequences of tokens. Every stage takes
an empty table, very long texts and extra columns with any names; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolake.llm import decontam, langid, minhash, packing, quality
from geolake.llm.common import small_batches, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, with all their columns. A null or empty text fails the base rule and goes; null ids and repeated
    rows are judged like others; without labels the base rule alone rejects."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that their own labels teach. A text that is null or without a letter goes; repeated rows stay repeated."""
    small_batches(spark)
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (two-word shingles, similarity 0.8), the one with the smallest doc_id. Of rows with one
    id and one text one stays, texts without words and rows without an id all stay; rows of one id with different texts are told apart."""
    small_batches(spark)
    return minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. A null or empty text has none and stays; repeated rows stay or go together; an empty
    benchmark lets all stay."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences. A null or empty text is its end id alone; repeated rows are packed each for itself."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Learned cutoffs, trees and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
