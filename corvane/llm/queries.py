"""The registered queries opN_<name> and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, conversation_repair, decontaminate, lexical_search, line_dedup, ngram_join, oracles, quality_classifier, quality_rules
from corvane.llm import repeats, sharding, simhash, suffixes, token_files
from corvane.sources.tables import table


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeated_words(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(table(spark, folder, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_files.digest(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.damage(table(spark, folder, "conversations")))


def op13_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_line_dedup,
        op4_ngram_jaccard_join,
        op5_suffix_array_dedup,
        op6_quality_classifier,
        op7_benchmark_decontamination,
        op8_sharding,
        op9_token_files,
        op10_byte_level_bpe,
        op11_lexical_search,
        op12_conversation_repair,
        op13_document_fingerprints,
    )
}

ORACLE = oracles.ORACLE
