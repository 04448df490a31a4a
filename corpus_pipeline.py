"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark
decontamination and SentencePiece encoding, each over all that its predecessor kept.

A stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulae.llm.common import cut
from tabulae.llm.decontaminate import decontaminate
from tabulae.llm.line_templates import drop_template_lines
from tabulae.llm.quality_rules import clean_documents
from tabulae.llm.sentencepiece_codec import encode_documents
from tabulae.llm.simhash_groups import keep_one_of_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too many of their words."""
    return clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines of a recurring template the first stays."""
    return drop_template_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return keep_one_of_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of what is left."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("SentencePiece", encode)]
#: SQL can express neither the template tree nor the encoder; each stage has tests of its own, the joint result none by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
