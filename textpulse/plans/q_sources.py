"""Readers and logs over the tables (A1, A2, A6, A8): each query writes rows of
the tables in the source's format and returns what its reader makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions.labels import stars_to_sentiment
from textpulse.functions.text import WS_SET
from textpulse.functions.validation import sql_validate_request
from textpulse.plans.catalog import register
from textpulse.plans.sqltext import view
from textpulse.session import scratch_path
from textpulse.sources import datasource as DS
from textpulse.sources import sinks as K
from textpulse.sources.tables import prediction_log, reviews, table
from textpulse.streaming.runner import run_available_now, table_stream

LOG = view("pred_log")


@register("review_csv", f"""
SELECT CAST(sentiment AS VARCHAR) AS sentiment, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM {view('reviews')} WHERE length(text) > 0 GROUP BY sentiment""")
def review_csv(spark, sf):
    """A1, B1: reviews as CSV with quoted line breaks and other column names."""
    path = scratch_path(spark, "review_csv")
    rows = reviews(spark, sf).select(F.col("text").alias("review"), F.col("sentiment").alias("label"))
    K.write_review_csv(rows, path)
    back = K.read_review_csv(spark, path, multi_line=True)
    return back.groupBy("sentiment").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                         F.sum(F.length("text")).cast("bigint").alias("chars"))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


_STAR_SQL = f"""
WITH l AS (SELECT event_id, CASE WHEN {_K} % 10 = 0 THEN 'broken' WHEN {_K} % 10 = 1 THEN 'no stars' ELSE 'good' END AS kind,
                  1 + {_K} % 5 AS stars FROM events),
s AS (SELECT CASE WHEN stars <= 2 THEN 'negative' WHEN stars = 3 THEN 'neutral' ELSE 'positive' END AS sentiment
      FROM l WHERE kind = 'good')
SELECT sentiment, CAST(least(count(*), 50) AS BIGINT) AS n,
       (SELECT CAST(count(*) AS BIGINT) FROM l WHERE kind = 'broken') AS bad_lines,
       (SELECT CAST(count(*) AS BIGINT) FROM l WHERE kind <> 'broken') AS text_lines
FROM s GROUP BY sentiment"""


def star_lines(spark, sf) -> str:
    """A folder of JSON lines with stars, some broken, some without."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    line = (F.when(k % 10 == 0, F.lit('{"text": "broken'))
            .when(k % 10 == 1, F.to_json(F.struct(name.alias("text"))))
            .otherwise(F.to_json(F.struct(name.alias("text"), (1 + k % 5).cast("double").alias("stars")))))
    path = scratch_path(spark, "star_json")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return path


@register("star_json", _STAR_SQL)
def star_json(spark, sf):
    """At most 50 rows a class, and the line counts."""
    path = star_lines(spark, sf)
    rows, lines = K.read_star_reviews(spark, path, max_per_class=50)
    counts = lines.first()  # two numbers
    return rows.groupBy("sentiment").agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        "sentiment", "n", F.lit(counts["bad_lines"]).cast("bigint").alias("bad_lines"),
        F.lit(counts["text_lines"]).cast("bigint").alias("text_lines"))


_SOURCE_SQL = f"""
SELECT sentiment, n, bad_lines, text_lines FROM (
WITH l AS (SELECT CASE WHEN {_K} % 10 = 0 THEN 'broken' WHEN {_K} % 10 = 1 THEN 'no stars' ELSE 'good' END AS kind,
                  1 + {_K} % 5 AS stars FROM events)
SELECT CASE WHEN kind <> 'good' THEN kind WHEN stars <= 2 THEN 'negative' WHEN stars = 3 THEN 'neutral' ELSE 'positive' END
         AS sentiment, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE kind = 'broken') AS BIGINT) AS bad_lines,
       CAST(count(*) FILTER (WHERE kind <> 'broken') AS BIGINT) AS text_lines
FROM l GROUP BY 1)"""


def _star_classes(rows):
    kind = (F.when(F.col("broken"), "broken").when(F.col("stars").isNull(), "no stars")
            .otherwise(stars_to_sentiment(F.col("stars"))))
    return rows.groupBy(kind.alias("sentiment")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.count(F.when(F.col("broken"), 1)).cast("bigint").alias("bad_lines"),
        F.count(F.when(~F.col("broken"), 1)).cast("bigint").alias("text_lines"))


@register("source_star_reviews", _SOURCE_SQL)
def source_star_reviews(spark, sf):
    """The same lines by ``spark.read.format``, cut into small splits."""
    DS.register(spark)
    return _star_classes(spark.read.format("star_reviews").option("splitBytes", 1 << 20).load(star_lines(spark, sf)))


@register("source_star_stream", _SOURCE_SQL)
def source_star_stream(spark, sf):
    """The same lines by ``readStream``."""
    DS.register(spark)
    stream = spark.readStream.format("star_reviews").load(star_lines(spark, sf))
    return _star_classes(spark.read.parquet(run_available_now(stream)))


@register("source_feedback_log", f"""
SELECT prediction, true_label, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS confidence
FROM {LOG} GROUP BY ALL""")
def source_feedback_log(spark, sf):
    """The feedback log by ``spark.read.format``."""
    DS.register(spark)
    path = scratch_path(spark, "feedback")
    log = prediction_log(spark, sf).withColumn("text", F.col("event_type"))
    K.write_feedback(log.select("text", "prediction", "true_label", "confidence"), path)
    rows = spark.read.format("feedback_log").load(path).where("NOT broken")
    return rows.groupBy("prediction", "true_label").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@register("feedback_logs", f"""
SELECT 'json' AS log, prediction, true_label, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS confidence
FROM {LOG} GROUP BY ALL
UNION ALL SELECT 'csv', prediction, true_label, CAST(count(*) AS BIGINT), NULL FROM {LOG} GROUP BY prediction, true_label""")
def feedback_logs(spark, sf):
    """The log as feedback records, as JSON lines and as CSV."""
    log = prediction_log(spark, sf).withColumn("text", F.col("event_type"))
    a, b = scratch_path(spark, "feedback"), scratch_path(spark, "feedback_csv")
    K.write_feedback(log.select("text", "prediction", "true_label", "confidence"), a)
    K.write_feedback_csv(log.select(
        F.col("ts").cast("string").alias("timestamp"), "text", F.col("prediction").alias("predicted_label"),
        F.col("true_label").alias("correct_label"), (F.col("prediction") == F.col("true_label")).alias("is_accurate"),
        F.lit(None).cast("string").alias("notes")), b)
    n = F.count(F.lit(1)).cast("bigint").alias("n")
    js = K.read_json_log(spark, a, K.FEEDBACK_SCHEMA).groupBy("prediction", "true_label").agg(
        n, F.round(F.avg("confidence"), 6).alias("confidence"))
    cs = K.read_feedback_csv(spark, b).groupBy(F.col("predicted_label").alias("prediction"),
                                               F.col("correct_label").alias("true_label")).agg(n)
    return js.select(F.lit("json").alias("log"), "*").unionByName(
        cs.select(F.lit("csv").alias("log"), "*", F.lit(None).cast("double").alias("confidence")))


_CHECKED_SQL = f"""(SELECT *, {sql_validate_request('text')} AS reject_reason,
  regexp_replace(coalesce(text, ''), '^[{WS_SET}]+|[{WS_SET}]+$', '', 'g') AS stripped FROM documents)"""


def _validated(spark, sf):
    """Documents as scoring requests, validated and written in one pass."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "validated")
    K.write_validated(docs, "text", path)
    return path, docs.schema


@register("accepted_requests", f"""
SELECT doc_id, lang, CAST(length(stripped) AS BIGINT) AS chars, md5(stripped) AS digest FROM {_CHECKED_SQL}
WHERE reject_reason IS NULL""")
def accepted_requests(spark, sf):
    """The table of accepted requests, texts stripped."""
    return K.read_accepted(spark, *_validated(spark, sf)).select(
        "doc_id", "lang", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@register("quarantined_requests", f"""
SELECT doc_id, lang, reject_reason, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM {_CHECKED_SQL}
WHERE reject_reason IS NOT NULL""")
def quarantined_requests(spark, sf):
    """The quarantine table of the same pass, texts as sent."""
    return K.read_quarantine(spark, *_validated(spark, sf)).select(
        "doc_id", "lang", "reject_reason", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@register("stream_quarantine", f"""
SELECT coalesce(reject_reason, 'accepted') AS outcome, CAST(count(*) AS BIGINT) AS n FROM {_CHECKED_SQL} GROUP BY 1""")
def stream_quarantine(spark, sf):
    """B17 on a stream: rows of both tables by reason."""
    stream = table_stream(spark, sf, "documents", max_files_per_trigger=1).select("doc_id", "lang", "text")
    path = scratch_path(spark, "validated")
    run_available_now(stream, foreach_batch=K.validated_sink("text", path))
    good = K.read_accepted(spark, path, stream.schema).select(F.lit("accepted").alias("outcome"))
    bad = K.read_quarantine(spark, path, stream.schema).select(F.col("reject_reason").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
