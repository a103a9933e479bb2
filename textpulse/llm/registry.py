"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textpulse.llm import (alignment, decontaminate, embedding, language, line_dedup, packing, pii, quality,
                           simhash, spelling, substring, suffixes, url_filter)
from textpulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _on_documents(name: str, run, sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(table(spark, sf_dir, "documents"))
    query.__doc__ = run.__doc__
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_links(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


_on_documents("op1_simhash_dedup", simhash.simhash_groups)
QUERIES["op2_embedding_dedup"] = op2_embedding_dedup
_on_documents("op3_pii", pii.digest)
_on_documents("op4_line_dedup", line_dedup.digest, line_dedup.SQL)
QUERIES["op5_decontamination"] = op5_decontamination
ORACLES["op5_decontamination"] = decontaminate.SQL
QUERIES["op6_quality_classifier"] = op6_quality_classifier
_on_documents("op7_language_id", language.language_id)
_on_documents("op8_packing", packing.pack)
_on_documents("op9_substring_dedup", substring.digest, substring.SQL)
_on_documents("op10_suffix_array_dedup", suffixes.digest, suffixes.SQL)
_on_documents("op11_tokenizer_alignment", alignment.alignment)
QUERIES["op12_url_filter"] = op12_url_filter
_on_documents("op13_spelling_variants", spelling.variants)
