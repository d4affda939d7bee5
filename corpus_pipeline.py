"""Corpus pipeline: quality, exact copies, near copies, mixing, encoding.

Each stage gets what its predecessor kept and returns the columns of documents,
but the last, which returns the encoded texts as digests. The mix repeats rows
that it takes twice. Stages keep rows of null doc_id or text like any others:
a null text is an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formloom.llm.exact import drop_exact_duplicates
from formloom.llm.minhash import drop_near_duplicates
from formloom.llm.mixing import mix
from formloom.llm.pieces import encoded_digests
from formloom.llm.quality import accept_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled rows of these documents) doesn't reject."""
    return accept_quality(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one of the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest doc_id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the encoded and decoded text of each row."""
    return encoded_digests(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", encode)]

#: Trees, MinHash and the tokenizer can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Lineage is cut between stages, as the driver does by writing each one."""
    from formloom.llm.session import checkpointed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
