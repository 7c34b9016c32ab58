"""The training-data pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor kept. All but the last return the
columns of ``documents``; the last returns the packed pieces. Each stage's result is written as Parquet to the shared
folder and read again, so a lost executor repeats one stage at most. Nulls, empty texts, repeated rows, empty tables and
extra columns are treated as the operators' docstrings say; extra columns travel along until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from embertrace.llm.common import load
from embertrace.llm.jaccard import one_of_each
from embertrace.llm.mixing import mixed_documents
from embertrace.llm.packing import pack
from embertrace.llm.quality import quality_rules
from embertrace.llm.registry import llm_query
from embertrace.llm.repeats import without_repeats
from embertrace.staging import stage

#: End token and vocabulary of the packed sequences.
VOCABULARY, END_ID, CAPACITY = "byte_bpe_50k.json", 1, 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of near duplicates."""
    return one_of_each(docs, n=5, percent=75)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages of 50 words or more."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at weights 5, 2, 1; a document may come up to three times."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents of the mix with their token ids, sequence and offset."""
    return pack(docs, public_tokenizers.path(VOCABULARY), END_ID, CAPACITY)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: SQL cannot express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for number, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{number}")
    return docs


@llm_query()
def pipeline(spark, sf_dir):
    """All stages over all documents."""
    return run(spark, sf_dir)
