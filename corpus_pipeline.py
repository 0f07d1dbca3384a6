"""A training corpus from raw documents: five stages, each written as Parquet and read again.

quality rules -> language identification -> SimHash near-duplicates -> suffix-array dedup -> packing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm.common import read_table, scratch
from tideframe.llm.copies import keep_one_of_near_copies
from tideframe.llm.langid import fit_langid, keep_known_language
from tideframe.llm.packing import Limits, pack_documents
from tideframe.llm.quality import keep_good
from tideframe.llm.suffix import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go; a short text is not rejected for its length."""
    return keep_good(docs, "v3")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go; it learns from this stage's input."""
    return keep_known_language(docs, fit_langid(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash neighbours whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return keep_one_of_near_copies(docs, width=5, least=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur again are cut out of all texts."""
    return without_repeats(docs, words=51)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return pack_documents(docs, limits=Limits(2048, 1024, 2048))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("repeats", repeats),
    ("packing", packing),
]

#: SQL cannot express these stages; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
