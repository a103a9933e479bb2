"""Streaming queries (I1-I7, A7, A10): each runs a Structured Streaming query
over the driver tables with an ``availableNow`` trigger into a sink under the
shared checkpoint folder and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.operators import drift as D
from textpulse.operators import model as MD
from textpulse.plans.catalog import register
from textpulse.plans.q_drift import _LAT_PROD, _LAT_REF, LATENCY_BORDER
from textpulse.plans.q_sampling import split_reviews
from textpulse.plans.sqltext import cleaned_docs, psi_sql, view
from textpulse.session import materialize, scratch_path
from textpulse.sources.sinks import ALERT_SCHEMA, INFERENCE_LOG_SCHEMA, read_json_log, stamped_alerts
from textpulse.sources.tables import prediction_columns, prediction_log, table
from textpulse.streaming import operators as SO
from textpulse.streaming import state as ST
from textpulse.streaming.runner import latest, run_available_now, run_updates, stream_dir, table_stream, update_stream

LOG = view("pred_log")
IDLE = "400 days"  # event time after which keys without new rows lose their state
CLOSED = f"(SELECT max(ts) - INTERVAL 1 HOUR FROM {LOG})"


@register("stream_clean_documents", f"SELECT doc_id, cleaned_text FROM {cleaned_docs()}")
def stream_clean_documents(spark, sf):
    """The cleaner on a document stream, exactly-once parquet sink."""
    s = SO.cleaned_document_stream(table_stream(spark, sf, "documents", max_files_per_trigger=1))
    return spark.read.parquet(run_available_now(s))


@register("stream_scored_documents", f"SELECT doc_id, TRUE AS same_as_batch FROM {cleaned_docs()}")
def stream_scored_documents(spark, sf):
    """Documents scored on a stream by a saved and reloaded model; whether
    each record equals the batch score."""
    path = scratch_path(spark, "model")
    MD.save(MD.RETRAIN_MODEL.fit(split_reviews(spark, sf).where("split = 'train'"), "text", "sentiment"), path)
    model = MD.load(path)
    # the retrain variant reads raw text: cleaned text stands in its column
    docs = lambda d: d.withColumnRenamed("cleaned_text", "text")
    stream = SO.cleaned_document_stream(table_stream(spark, sf, "documents", max_files_per_trigger=1))
    out = spark.read.parquet(run_available_now(MD.predict(model, docs(stream), ["doc_id"])))
    batch = MD.predict(model, docs(SO.cleaned_document_stream(table(spark, sf, "documents"))), ["doc_id"])
    return out.join(batch.select("doc_id", F.col("prediction").alias("_p"), F.col("confidence").alias("_c")), "doc_id") \
        .select("doc_id", ((F.col("prediction") == F.col("_p")) & (F.abs(F.col("confidence") - F.col("_c")) < 1e-9))
                .alias("same_as_batch"))


@register("stream_prediction_log", f"""
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text, props AS text, prediction, latency_ms FROM (
  SELECT l.*, e.props FROM {LOG} l JOIN events e ON l.id = e.event_id)""")
def stream_prediction_log(spark, sf):
    """I2 + A7: the prediction log stream, with the scored payload as its text,
    appended to a JSON inference log."""
    events = table_stream(spark, sf, "events")
    s = prediction_columns(events.withColumn("text", F.col("props")), extra=["text"]).withWatermark("ts", SO.WATERMARK)
    s = s.select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "text", "prediction",
                 "latency_ms")
    out = run_available_now(s, fmt="json")
    log = spark.read.schema("id bigint, " + INFERENCE_LOG_SCHEMA).json(out)
    return log.withColumnRenamed("timestamp", "ts_text")


_METRICS_SQL = f"""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, requests, mean_latency_ms, labelled
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS ws, event_type, CAST(count(*) AS BIGINT) AS requests,
             round(avg(latency_ms), 3) AS mean_latency_ms, CAST(count(true_label) AS BIGINT) AS labelled
      FROM {LOG} GROUP BY time_bucket(INTERVAL 1 DAY, ts), event_type)"""


@register("stream_service_metrics", _METRICS_SQL)
def stream_service_metrics(spark, sf):
    """Per day and event type, open days included (update mode)."""
    s = SO.windowed_metrics(SO.prediction_stream(table_stream(spark, sf, "events")))
    return latest(spark.read.parquet(run_updates(s)), ["window_start", "event_type"])


@register("stream_closed_metrics", f"{_METRICS_SQL} WHERE ws + INTERVAL 1 DAY <= {CLOSED}")
def stream_closed_metrics(spark, sf):
    """I3 in append mode: a day is written once, when the watermark closes it."""
    s = SO.windowed_metrics(SO.prediction_stream(table_stream(spark, sf, "events")))
    return spark.read.parquet(run_available_now(s))


@register("stream_service_metrics_sliding", f"""
WITH s AS (SELECT TIMESTAMP '2023-12-31 00:00:00' + INTERVAL (h) HOUR AS ws FROM range(0, 24 * 40, 12) t(h))
SELECT strftime(s.ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS requests,
       round(avg(latency_ms), 3) AS mean_latency_ms, CAST(count(true_label) AS BIGINT) AS labelled
FROM {LOG} l JOIN s ON l.ts >= s.ws AND l.ts < s.ws + INTERVAL 1 DAY GROUP BY s.ws""")
def stream_service_metrics_sliding(spark, sf):
    """I3 sliding: 1-day windows every 12 hours, open ones included."""
    s = SO.windowed_metrics(SO.prediction_stream(table_stream(spark, sf, "events")), "1 day", "12 hours",
                            by_type=False)
    return latest(spark.read.parquet(run_updates(s)), ["window_start"])


@register("stream_window_accuracy", f"""
SELECT key, CAST(count(*) AS BIGINT) AS total_samples,
       CAST(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 3) AS accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS rn
      FROM {LOG} WHERE true_label IS NOT NULL)
WHERE rn <= 50 GROUP BY key""")
def stream_window_accuracy(spark, sf):
    """I4: rolling last-50 labelled accuracy per key with bounded state."""
    s = ST.rolling_last_n(prediction_columns(table_stream(spark, sf, "events")), 50, idle=IDLE)
    return latest(spark.read.parquet(run_updates(s, conf=ST.ROCKSDB)), ["key"])


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


@register("stream_delayed_labels", f"""
SELECT event_id AS id, CASE WHEN value >= 20 THEN 'positive' ELSE 'negative' END AS prediction,
       CASE WHEN event_type <> 'error' AND {_K} <= 60 THEN CASE WHEN {_K} % 2 = 0 THEN 'positive' ELSE 'negative' END END
         AS true_label,
       CASE WHEN event_type <> 'error' AND {_K} <= 60 THEN CAST({_K} AS BIGINT) END AS label_delay_min
FROM events""")
def stream_delayed_labels(spark, sf):
    """Every prediction, with its label if one arrives within an hour
    (watermarks on both sides); later labels are ignored."""
    j = SO.delayed_labels(table_stream(spark, sf, "events"), table_stream(spark, sf, "events"))
    base = stream_dir(spark)
    return SO.with_pending(spark.read.parquet(run_available_now(j, base=base)), f"{base}/chk")


_DAILY = psi_sql(_LAT_REF, _LAT_PROD, prod_keys=("day",))


def latency_baseline(spark, sf):
    """Interior edges of the reference latencies and their bucket shares
    (at most buckets + 1 rows)."""
    log = prediction_log(spark, sf).where(F.col("ts") < F.lit(LATENCY_BORDER).cast("timestamp"))
    ref_vc = materialize(log.groupBy(F.lit("latency_ms").alias("feature"), F.col("latency_ms").alias("value"))
                         .agg(F.count(F.lit(1)).alias("cnt")))
    edges = D.reference_edges(ref_vc, 10).first()  # one row: <= 9 interior edges
    inner = [float(x) for x in edges["inner"]]
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in inner]).cast("array<double>"), lambda x: F.col("value") >= x))
    shares = ref_vc.groupBy(bucket.alias("bucket")).agg((F.sum("cnt") / F.lit(edges["n"])).alias("e"))
    grid = spark.range(edges["bins"]).select(F.col("id").cast("int").alias("bucket"))
    return inner, materialize(grid.join(shares, "bucket", "left").select("bucket", F.coalesce("e", F.lit(0.0)).alias("e")))


def daily_psi_updates(spark, sf) -> str:
    """Each day's bucket counts as keyed state; the folder of the PSI of the
    days of each batch."""
    inner, baseline = latency_baseline(spark, sf)
    shares = [r["e"] for r in baseline.orderBy("bucket").collect()]  # one a bucket
    pred = prediction_columns(table_stream(spark, sf, "events")).where(
        F.col("ts") >= F.lit(LATENCY_BORDER).cast("timestamp"))
    s = ST.daily_psi(pred, "latency_ms", inner, shares, idle=IDLE)
    return run_updates(s.select("day", F.round("psi_raw", 6).alias("psi"), D.classify_psi(F.col("psi_raw")).alias("status"),
                                "production_rows"), conf=ST.ROCKSDB)


@register("stream_daily_drift", f"SELECT day, feature, psi, status, production_rows FROM ({_DAILY})")
def stream_daily_drift(spark, sf):
    """Latency PSI of each day against the reference days."""
    days = latest(spark.read.parquet(daily_psi_updates(spark, sf)), ["day"])
    return days.withColumn("feature", F.lit("latency_ms"))


@register("stream_alerts", f"""
WITH p AS ({_DAILY}),
a AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
             round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 3) AS accuracy
      FROM {LOG} WHERE true_label IS NOT NULL GROUP BY 1)
SELECT 'DRIFT' AS type, CASE WHEN status = 'Significant shift' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       'Latency drift on ' || day AS message,
       '{{"day":"' || day || '","psi":' || printf('%.6f', psi) || '}}' AS meta FROM p WHERE status <> 'No change'
UNION ALL
SELECT 'METRICS', CASE WHEN accuracy < 0.6 THEN 'CRITICAL' ELSE 'WARNING' END,
       CASE WHEN accuracy < 0.6 THEN 'Severe accuracy drop detected' ELSE 'Moderate accuracy drop detected' END,
       '{{"day":"' || day || '","accuracy":' || printf('%.6f', accuracy) || '}}' FROM a WHERE accuracy < 0.75""")
def stream_alerts(spark, sf):
    """Drift and accuracy (H2) alerts per day from the streams of daily
    updates, each written once to the JSON alert log and read back from it."""
    daily = SO.daily_accuracy(SO.prediction_stream(table_stream(spark, sf, "events"))).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), F.round(F.col("correct") / F.col("labelled"), 3).alias("accuracy"))
    streams = []
    for path in (daily_psi_updates(spark, sf), run_updates(daily)):
        streams.append(update_stream(spark, path, spark.read.option("recursiveFileLookup", True).parquet(path).schema))
    alerts = SO.daily_alert_stream(*streams)
    log = run_available_now(stamped_alerts(alerts), fmt="json")
    return read_json_log(spark, log, ALERT_SCHEMA).select("type", "severity", "message", "meta")
