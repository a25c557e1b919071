"""Queries of this subpackage over the given tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import (
    embeddings, filter_audit, html, importance, minhash, oracles, packing, pii, piecewise, quality_knn, quality_rules, substrings, unigram,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(_table(spark, folder, "pages"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_knn.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.substring_dedup(_table(spark, folder, "documents"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, folder, "embeddings"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(_table(spark, folder, "documents"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.round_trips(_table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_table(spark, folder, "documents"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resampled(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_piecewise_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return piecewise.fingerprints(_table(spark, folder, "documents"))


QUERIES = [
    op1_best_fit_packing, op2_html_extraction, op3_quality_classifier, op4_quality_rules, op5_substring_dedup, op6_embedding_dedup,
    op7_token_counts, op8_minhash, op9_sentencepiece, op10_pii, op11_importance_resampling, op12_filter_audit,
    op13_piecewise_fingerprints,
]
ORACLES: dict[str, str] = {
    "op5_substring_dedup": oracles.SUBSTRINGS,
    "op6_embedding_dedup": oracles.EMBEDDINGS,
    "op8_minhash": oracles.NEAR_DUPLICATES,
    "op11_importance_resampling": oracles.IMPORTANCE,
    "op12_filter_audit": oracles.FILTER_AUDIT,
}
