"""The subpackage's queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import chat, decontam, embed, license, minhash, mixing, quality, toxicity, urls, warc
from lettermill.llm.oracle import ORACLE_SQL
from lettermill.sources.tables import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_license_scan finds of the base phrases alone, which SQL can express."""
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    return op1_license_scan(spark, sf_dir).select(*columns)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        license_base_phrases,
        op2_quality_classifier,
        op3_benchmark_decontamination,
        op4_minhash_near_dedup,
        op5_url_filter,
        op6_chat_perspectives,
        op7_warc_revisits,
        op8_toxicity,
        op9_source_mixing,
        op10_embedding_near_dedup,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
