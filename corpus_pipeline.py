"""The training-data pipeline: documents in, packed sequences out; each stage reads what the one before it kept.

Every stage judges rows one by one, by their own text: rows that repeat a doc_id or have none are rows like others. All but the last
return the columns of their input, whatever they are named; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redsieve.llm.common import saved, table
from redsieve.llm.mixing import mixed
from redsieve.llm.neardup import without_near_duplicates
from redsieve.llm.outliers import without_outliers
from redsieve.llm.packing import pack
from redsieve.llm.qda import without_low_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source. Null and empty texts fail the rules; null
    languages and sources are groups of their own; repeated rows all stay or all go."""
    return without_outliers(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be of quality 1. Null and empty texts are scored as texts of no words; without labels of both
    classes all documents have one score, and all stay or all go."""
    return without_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8. The least doc_id of a group stays, of rows
    that repeat it one; rows without a doc_id come last. Null and empty texts are like nothing, and all stay."""
    return without_near_duplicates(docs, shingle_words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document that is taken twice is there twice. Null and empty texts have no words and aren't taken; rows
    that share a doc_id, or have none, are taken together."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence. A null or empty text is the end id alone; repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Distances, learnt scores and tokenizers aren't SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
