"""The queries of this subpackage, by name, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_formatting, decontamination, hard_negatives, katz, language_id, lexical_search, quality_classifier, quality_rules, sampled_segmentation, simhash, substring_dedup, token_counts, toxicity
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op5(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentation.encode(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.op11(spark, sf_dir)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.op12(spark, sf_dir)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op13(spark, sf_dir)


_ALL = (
    op1_quality_classifier, op2_simhash, op3_token_counts, op4_language_id, op5_substring_dedup,
    op6_quality_rules, op7_toxicity, op8_sampled_segmentation, op9_katz, op10_decontamination,
    op11_lexical_search, op12_chat_formatting, op13_hard_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: Hash functions, classifiers, tokenizers, samplers and BM25 retrieval have no SQL; those queries are tested by brute force.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": substring_dedup.ORACLE, "op11_lexical_search": lexical_search.ORACLE, "op12_chat_formatting": chat_formatting.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE,
}
