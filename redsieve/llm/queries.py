"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redsieve.llm.common import table
from redsieve.llm import mixing, topk, warc
from redsieve.llm.extraction import extract
from redsieve.llm.neardup import near_duplicates
from redsieve.llm.outliers import outlier_verdicts
from redsieve.llm.packing import pack
from redsieve.llm.qda import quality_scores
from redsieve.llm.tokenbin import token_shards
from redsieve.llm.urls import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_verdicts(table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op5_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))


def op6_tree_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_warc_segments": op2_warc_segments,
    "op3_quadratic_discriminant": op3_quadratic_discriminant,
    "op4_bottom_k_near_duplicates": op4_bottom_k_near_duplicates,
    "op5_repair_token_shards": op5_repair_token_shards,
    "op6_tree_marginals": op6_tree_marginals,
    "op7_vector_best_fit": op7_vector_best_fit,
    "op8_hash_threshold_mix": op8_hash_threshold_mix,
    "op9_host_words": op9_host_words,
    "op10_threshold_top_k": op10_threshold_top_k,
}

ORACLES: dict[str, str] = {
    "op2_warc_segments": warc.ORACLE,
    "op8_hash_threshold_mix": mixing.ORACLE,
    "op10_threshold_top_k": topk.ORACLE,
}
