"""The ten registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veracord.llm import bpe, decontaminate, language_id, pieces, pii, quality_rules, setjoin, substring_dedup, token_store, url_filter
from veracord.llm.common import load


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(load(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(load(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op5(load(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(load(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op7(spark, load(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op9(load(spark, sf_dir, "documents"), bpe.tokenizer_path("piece_bpe_32k.model"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the quality rules SQL can express: the statistics and the base rule."""
    stats = quality_rules.statistics(load(spark, sf_dir, "documents"))
    return stats.select("doc_id", *quality_rules.BASE, quality_rules.base_failed().alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_substring_dedup, op3_ngram_jaccard, op4_quality_rules, op5_language_id, op6_token_counts, op7_token_store, op8_pii, op9_sentencepiece, op10_decontaminate, op4_base_statistics)
}

#: Queries whose whole result SQL can express.
ORACLES: dict[str, str] = {"op1_url_filter": url_filter.oracle(), "op3_ngram_jaccard": setjoin.oracle(3, 90, 100), "op4_base_statistics": quality_rules.base_oracle()}
