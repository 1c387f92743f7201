"""Corpus preparation in five stages; each stage's result is written and read again.

The first four stages return the columns of ``documents``; the last one
returns what the encoder makes of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from corvane.sources.shared import discard, materialize, scratch
from corvane.sources.tables import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the boosted trees go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal to, or within an edit of, an earlier line go."""
    return line_dedup.remove_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return ngram_join.keep_first(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the rule of operator 7, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids and of the decoded text."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", keep_good), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("benchmark decontamination", decontaminate_documents), ("byte-level BPE", encode)]
#: The stages hold trained trees and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, held + made[:-1])  # a stage's result stands on its own once it is written
        held = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
