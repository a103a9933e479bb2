"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's docs.
All but the last return the columns of documents.

Defined results: texts that the quality classifier scores below its threshold
go; line dedup keeps every row (``n_chars``, where there is one, follows the
text); of each SimHash group the row with the smallest doc_id stays (of rows
that repeat it, the one whose text hashes lowest), rows without a doc_id stay;
documents with a benchmark passage go; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm import decontaminate, line_dedup, packing, quality, simhash
from textpulse.llm.common import save, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    changed = F.col("n_dropped") > 0
    columns = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        new = {"text": F.col("kept"), "n_chars": F.length("kept")}.get(name)
        columns.append(old.alias(name) if new is None else
                       F.when(changed, new.cast(docs.schema[name].dataType)).otherwise(old).alias(name))
    return out.select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(docs)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    kept = (rows.join(first, F.col("row.doc_id") == F.col("first_id"), "left_semi")
            .groupBy("row.doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")))
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("NOT contaminated").select("row.*")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("benchmark_decontamination", remove_benchmark),
    ("packing", pack_documents),
]

# The classifier and the tokenizer can't be expressed in SQL; tests compare the
# pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
