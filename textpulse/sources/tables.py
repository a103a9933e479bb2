"""Driver tables and the views derived from them.

Every view is a lazy DataFrame over the parquet scan, so Catalyst prunes
columns and pushes filters down to the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# tables whose rows carry long text: CPU-heavy regex work follows their scan
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
# off unless set: deal text tables round-robin to so many partitions, for inputs
# that are one small file on many cores (the bench and test sessions set it)
TEXT_PARTITIONS = "spark.textpulse.text.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts and name in TEXT_TABLES else df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews ``(doc_id, text, lang, sentiment)``: documents joined
    with labels; ``sentiment`` is the 0/1 quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("sentiment"))
    return docs.join(labels, "doc_id", "inner")


def reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline side of the drift checks: English documents."""
    return table(spark, sf_dir, "documents").where(F.col("lang") == "en")


def production_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production side of the drift checks: all other documents."""
    return table(spark, sf_dir, "documents").where(F.col("lang") != "en")


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log ``(id, ts, key, event_type, prediction, true_label,
    confidence, latency_ms)`` derived row by row from ``events``."""
    return prediction_columns(table(spark, sf_dir, "events"))


def prediction_columns(ev: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The prediction-log projection of an events frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("key"),
        "event_type",
        F.when(F.col("value") >= 20, F.lit("positive"))
         .otherwise(F.lit("negative")).alias("prediction"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .when(k % 2 == 0, F.lit("positive"))
         .otherwise(F.lit("negative")).alias("true_label"),
        F.round(F.lit(0.5) + (k % 50) / F.lit(100.0), 2).alias("confidence"),
        F.col("value").alias("latency_ms"), *extra,
    )


# The same views in DuckDB SQL, used by the oracle strings.
SQL_VIEWS = {
    "reviews": """(SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS INTEGER) AS sentiment
                  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "ref_text": "(SELECT * FROM documents WHERE lang = 'en')",
    "prod_text": "(SELECT * FROM documents WHERE lang <> 'en')",
    "pred_log": """(SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, user_id AS key, event_type,
                   CASE WHEN value >= 20 THEN 'positive' ELSE 'negative' END AS prediction,
                   CASE WHEN event_type = 'error' THEN NULL
                        WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'positive'
                        ELSE 'negative' END AS true_label,
                   round(0.5 + (CAST(json_extract_string(props, '$.k') AS INTEGER) % 50) / 100.0, 2)
                     AS confidence,
                   value AS latency_ms
                   FROM events)""",
}
