"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulae.llm.decontaminate import contaminated
from tabulae.llm.fingerprint_index import remove_earlier_windows
from tabulae.llm.license_scan import scan_licenses
from tabulae.llm.line_templates import line_dedup
from tabulae.llm.quality_rules import quality_rules
from tabulae.llm.separator_scan import token_counts
from tabulae.llm.sentencepiece_codec import encode_documents
from tabulae.llm.simhash_groups import simhash_components
from tabulae.llm.sql import quality_sql, url_sql, windows_sql
from tabulae.llm.suffix_repeats import remove_repeats
from tabulae.llm.url_trust import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_repeats": _documents(lambda d: remove_repeats(d).drop("spans")),
        "op2_sentencepiece": _documents(lambda d: encode_documents(d, public_tokenizers.path("piece_bpe_32k.model"))),
        "op3_quality_rules": _documents(quality_rules),
        "op4_url_trust": lambda spark, sf_dir: judge_urls(_table(spark, sf_dir, "pages")),
        "op5_simhash": _documents(simhash_components),
        "op6_decontamination": lambda spark, sf_dir: contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
        "op7_fingerprint_index": _documents(remove_earlier_windows),
        "op8_separator_scan": _documents(lambda d: token_counts(d, public_tokenizers.path("byte_bpe_50k.tiktoken"))),
        "op9_license_scan": _documents(scan_licenses),
        "op10_line_templates": _documents(line_dedup),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_sql(), "op4_url_trust": url_sql(), "op7_fingerprint_index": windows_sql()}
