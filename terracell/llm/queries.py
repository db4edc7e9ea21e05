"""The registered queries of the ten operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, common, decontam, flac, html, lm, packing, pii, quality, simhash, suffix
from .sql import SQL

def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(common.table(spark, sf_dir, "documents"), packing.public_tokenizer(), packing.CAPACITY)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(common.table(spark, sf_dir, "conversations"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(common.table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(common.table(spark, sf_dir, "documents"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(common.table(spark, sf_dir, "documents"))


def op10_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good and not toxic; all other documents are the background."""
    good = common.table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return lm.cross_entropy_difference(common.table(spark, sf_dir, "documents"), good.select("doc_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(common.ship(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_flac_media": op9_flac_media,
    "op10_lm_cross_entropy": op10_lm_cross_entropy,
    "pipeline": pipeline,
}

__all__ = ["QUERIES", "SQL"]
