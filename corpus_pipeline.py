"""Corpus pipeline: documents through the stages in order, each stage's output written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but
the last keep the columns of documents. SQL cannot express the similarity, retrieval and tokenizer
stages, so the result is tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenlake.llm import decontaminate, importance, mixing, probminhash, token_ids
from tokenlake.llm.common import read_table, written
from tokenlake.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return importance.keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest doc_id."""
    return probminhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.read_token_files(*token_ids.write_token_files(docs, tokenizer_path()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
