"""A training-corpus pipeline over the table documents: filter, drop near copies, cut repeats, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_copies, quality, sentencepieces, suffix_dedup
from tessera.llm.common import materialise

#: Near copies: five-word shingles with a Jaccard similarity of 80 % or more. Candidates are SimHashes that differ in at most 6 of
#: 64 bits, and MinHash bands for the pairs whose SimHashes lie further apart.
WIDTH, RADIUS, PERCENT = 5, 6, 80
REPEAT_BYTES = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the tokeniser-fertility bands reject."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return near_copies.one_of_each_group(docs, WIDTH, RADIUS, PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes and more that an earlier document holds out of the texts; every document stays."""
    return suffix_dedup.documents_without_repeats(docs, REPEAT_BYTES)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Has each document as often as the mixture of the target weights does, some not at all."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the SentencePiece ids of each text, with merge-dropout that differs between copies."""
    return sentencepieces.encoded(docs, by_copy=True)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_array_dedup), ("mixing", source_mixing), ("encoding", encoding)]

#: SQL has neither the vocabularies nor XXH64; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
