"""Streaming operators.

* I1/I2 stateless cleaning, scoring and log streams: the batch column
  expressions (and the saved model) on a stream, file sink with checkpoint
  (exactly-once).
* I3 service metrics over event time: watermark + tumbling/sliding windows, in
  append mode (a window is written once, when the watermark passes its end) or in
  update mode (every window, also the open ones).
* I4 rolling last-N labelled accuracy per key and I6 drift per day keep keyed state
  in the state store (``state.py``).
* I5 delayed labels: stream-stream left outer join with watermarks on both sides
  and an event-time interval, so join state is dropped once a label cannot arrive.
* I7 alerts carry an id made of what they say; a stream keeps the ids of the
  watermark's span, so that an alert raised again is written once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.text import clean_text, compute_once
from textpulse.operators.drift import STATUS_NO_CHANGE, STATUS_SIGNIFICANT
from textpulse.operators.model import predict
from textpulse.operators.monitoring import accuracy_alerts
from textpulse.sources.tables import prediction_columns

WATERMARK = "1 hour"


def prediction_stream(events: DataFrame) -> DataFrame:
    return prediction_columns(events).withWatermark("ts", WATERMARK)


def cleaned_document_stream(docs: DataFrame) -> DataFrame:
    """Cleaning (and any per-row scoring) on a document stream."""
    c = docs.select("doc_id", compute_once(clean_text("text")).alias("cleaned_text"))
    return c.where(F.length("cleaned_text") > 0)


def windowed_metrics(pred: DataFrame, duration: str = "1 day", slide: str | None = None,
                     by_type: bool = True) -> DataFrame:
    """Requests, mean latency, labelled count per event-time window."""
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    keys = [w.alias("w")] + ([F.col("event_type")] if by_type else [])
    g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("_mean"),
                                F.count("true_label").alias("labelled"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    *(["event_type"] if by_type else []),
                    F.col("requests").cast("bigint").alias("requests"),
                    F.round("_mean", 3).alias("mean_latency_ms"),
                    F.col("labelled").cast("bigint").alias("labelled"))


def scored_document_stream(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """Cleaned and scored documents: the model's record for each text."""
    return predict(model, cleaned_document_stream(docs), ["doc_id"])


MAX_LABEL_DELAY = "1 hour"


def label_stream(events: DataFrame) -> DataFrame:
    """Labels that arrive k minutes after their event (k from the log, up to 99:
    some come too late); error events get none."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("lid"), (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=k)).alias("label_ts"),
        F.when(k % 2 == 0, "positive").otherwise("negative").alias("true_label"))


def delayed_labels(pred_events: DataFrame, label_events: DataFrame, max_delay: str = MAX_LABEL_DELAY) -> DataFrame:
    """Predictions, left outer joined with labels that arrive within
    ``max_delay`` after them; a prediction without one keeps null labels. A
    streaming join gives such a row once the watermark has passed its interval;
    ``with_pending`` adds those that still wait."""
    p = prediction_columns(pred_events).select("id", "ts", "prediction")
    lab = label_stream(label_events)
    if pred_events.isStreaming:
        p, lab = p.withWatermark("ts", "2 hours"), lab.withWatermark("label_ts", "2 hours")
    cond = (F.col("id") == F.col("lid")) & (F.col("label_ts") >= F.col("ts")) & \
           (F.col("label_ts") <= F.col("ts") + F.expr(f"INTERVAL {max_delay}"))
    j = p.join(lab, cond, "left_outer")
    return j.select("id", "prediction", "true_label",
                    ((F.unix_micros("label_ts") - F.unix_micros("ts")) / 60_000_000).cast("bigint")
                    .alias("label_delay_min"))


def with_pending(joined: DataFrame, checkpoint: str) -> DataFrame:
    """``joined`` (what the query wrote so far) and, without a label, the
    predictions whose wait isn't over: those that the join still holds in its state
    (the watermark's span, not the whole log) and hasn't given yet."""
    state = joined.sparkSession.read.format("statestore").option("joinSide", "left").load(checkpoint)
    waiting = state.select("value.id", "value.prediction").join(joined.select("id"), "id", "left_anti")
    return joined.unionByName(waiting.select("id", "prediction", F.lit(None).cast("string").alias("true_label"),
                                             F.lit(None).cast("bigint").alias("label_delay_min")))


def daily_accuracy(pred: DataFrame) -> DataFrame:
    """I7 state: labelled and correct predictions per day."""
    ok = F.when(F.col("prediction") == F.col("true_label"), 1).otherwise(0)
    return pred.where(F.col("true_label").isNotNull()).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("labelled"), F.sum(ok).alias("correct"))


ALERT_SPAN = "400 days"


def alert_id(*identity: str) -> Column:
    """A stable id of what an alert is about: equal for the same alert raised
    again by a later or a replayed batch."""
    return F.sha2(F.to_json(F.struct(*identity)), 256)


def daily_alert_stream(drift: DataFrame, accuracy: DataFrame, span: str = ALERT_SPAN) -> DataFrame:
    """Alerts from the streams of per-day updates ``drift`` (day, psi, status)
    and ``accuracy`` (day, accuracy), each raised once: an alert's identity is
    its type, severity and day, and ids within the watermark's span are kept in
    the state store. So neither a replayed batch nor a later update of a day
    raises it again; one that gets worse is a new alert."""
    drifted = drift.where(F.col("status") != STATUS_NO_CHANGE).select(
        "day", F.lit("DRIFT").alias("type"),
        F.when(F.col("status") == STATUS_SIGNIFICANT, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.concat(F.lit("Latency drift on "), "day").alias("message"),
        F.format_string('{"day":"%s","psi":%.6f}', "day", "psi").alias("meta"))
    dropped = accuracy_alerts(accuracy, meta=F.format_string('{"day":"%s","accuracy":%.6f}', "day", "accuracy"), keep=("day",))
    alerts = drifted.unionByName(dropped).select(
        alert_id("type", "severity", "day").alias("alert_id"), F.to_timestamp("day").alias("day_start"),
        "type", "severity", "message", "meta")
    return alerts.withWatermark("day_start", span).dropDuplicatesWithinWatermark(["alert_id"])
