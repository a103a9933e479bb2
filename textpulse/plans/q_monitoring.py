"""Monitoring queries (H1-H9, I3 batch twin) over drift flags and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.operators import drift as D
from textpulse.operators import monitoring as M
from textpulse.operators.scalars import attach
from textpulse.plans.catalog import register
from textpulse.plans.q_drift import (DETAIL_SQL, FLAGS_OF_DETAIL, SHIFTED_DETAIL_SQL, drift_flags, full_drift,
                                     shifted_drift, shifted_flags)
from textpulse.plans.q_evaluation import (_HEALTH_SQL, _LAST50, OFFLINE_SQL, ONLINE_SQL, health_frame, health_of,
                                          offline_evaluation, online_accuracy)
from textpulse.plans.q_model import _RETRAIN_SQL, retrain_row
from textpulse.plans.sqltext import view
from textpulse.session import materialize, scratch_path
from textpulse.sources.sinks import (ALERT_SCHEMA, HEALTH_SCHEMA, read_json_log, write_alerts, write_health,
                                     write_report)
from textpulse.sources.tables import prediction_log

LOG = view("pred_log")

def alerts_sql(detail: str) -> str:
    """CTEs ending in ``al``: the alerts of a drift detail."""
    m = lambda x: f"printf('%.6f', {x})"
    return f"""{detail},
fl AS ({FLAGS_OF_DETAIL}),
acc AS (SELECT round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 3) AS a FROM {_LAST50}),
al AS (
  SELECT 'DRIFT' AS type, 'WARNING' AS severity, 'Covariate drift detected' AS message,
         '{{"method":"covariate_text_length_ks","ks_statistic":' || {m('d')} || ',"p_value":' || {m('p')}
         || ',"drift_detected":true}}' AS meta FROM dd WHERE covariate_drift
  UNION ALL SELECT 'DRIFT', 'WARNING', 'Label drift detected', '{{"method":"label_distribution_shift","distribution_shift":'
         || {m('shift')} || ',"drift_detected":true}}' FROM dd WHERE label_drift
  UNION ALL SELECT 'DRIFT', 'CRITICAL', 'Concept drift detected', '{{"method":"concept_confidence_mismatch","avg_conf_correct":'
         || {m('right_conf')} || ',"avg_conf_wrong":' || {m('wrong_conf')} || ',"confidence_gap":' || {m('gap')}
         || ',"drift_detected":true}}' FROM dd WHERE concept_drift
  UNION ALL SELECT 'DRIFT', 'CRITICAL', 'Domain shift detected', '{{"method":"domain_shift_detection","drift_detected":true}}'
         FROM dd WHERE covariate_drift AND concept_drift
  UNION ALL SELECT 'RETRAIN', 'INFO', CASE WHEN status = 'retrained' THEN 'Model retrained successfully'
         ELSE 'Retraining skipped' END, '{{"status":"' || status || '","samples":' || samples || '}}'
         FROM ({_RETRAIN_SQL} FROM fl f)
  UNION ALL SELECT 'METRICS', CASE WHEN a < 0.6 THEN 'CRITICAL' ELSE 'WARNING' END,
         CASE WHEN a < 0.6 THEN 'Severe accuracy drop detected' ELSE 'Moderate accuracy drop detected' END,
         '{{"accuracy":' || {m('a')} || '}}' FROM acc WHERE a < 0.75)"""


_ALERTS_SQL = alerts_sql(DETAIL_SQL)


def alerts_frame(spark, sf, full, retrained, online):
    """H1-H3 of one drift result, the retrain step's result and the online accuracy."""
    acc = online.select(F.col("window_accuracy").alias("accuracy"))
    return (M.drift_alerts(full).unionByName(M.retrain_alert(retrained))
            .unionByName(M.accuracy_alerts(acc)))


def current_alerts(spark, sf, full):
    retrained = retrain_row(spark, sf, D.drift_flags(full))
    return alerts_frame(spark, sf, full, retrained, online_accuracy(spark, sf))


@register("alerts", f"WITH {_ALERTS_SQL} SELECT type, severity, message, meta FROM al")
def alerts(spark, sf):
    """H1-H3: drift, retrain and accuracy alerts of the current state, with the
    results behind them."""
    return current_alerts(spark, sf, full_drift(spark, sf))


@register("alerts_shifted", f"WITH {alerts_sql(SHIFTED_DETAIL_SQL)} SELECT type, severity, message, meta FROM al")
def alerts_shifted(spark, sf):
    """H1-H3 where everything drifts and a retrain really runs."""
    return current_alerts(spark, sf, shifted_drift(spark, sf))


@register("alert_log", f"WITH {_ALERTS_SQL} SELECT type, severity, message, meta FROM al")
def alert_log(spark, sf):
    """A10: the alerts appended to a JSON-lines log and read back."""
    path = scratch_path(spark, "alert_log")
    write_alerts(current_alerts(spark, sf, full_drift(spark, sf)), path)
    return read_json_log(spark, path, ALERT_SCHEMA).select("type", "severity", "message", "meta")


@register("alert_rollup", f"""WITH {_ALERTS_SQL}
SELECT coalesce(type, 'ALL') AS type, coalesce(severity, 'ALL') AS severity, CAST(count(*) AS BIGINT) AS alerts
FROM al GROUP BY ROLLUP (type, severity)""")
def alert_rollup(spark, sf):
    """H9: alert counts by type and severity with roll-up totals."""
    return M.alert_rollup(current_alerts(spark, sf, full_drift(spark, sf)))


def health_sql(detail: str) -> str:
    return f"""{_HEALTH_SQL}, {detail},
fl AS ({FLAGS_OF_DETAIL}),
pen AS (SELECT CAST((CASE WHEN covariate_drift THEN 0.2 ELSE 0.0 END) + (CASE WHEN label_drift THEN 0.2 ELSE 0.0 END)
             + (CASE WHEN concept_drift THEN 0.3 ELSE 0.0 END) + (CASE WHEN domain_shift THEN 0.3 ELSE 0.0 END)
             AS DOUBLE) AS p FROM fl),
fin AS (SELECT round(score, 3) AS base, p, CAST(greatest(round(round(score, 3) - p, 3), 0.0) AS DOUBLE) AS final FROM h, pen),
hl AS (SELECT base AS evaluation_health_score, round(p, 3) AS drift_penalty, final AS system_health_score,
       CASE WHEN final < 0.4 THEN 'CRITICAL' WHEN final < 0.7 THEN 'WARNING' ELSE 'HEALTHY' END AS system_status,
       CASE WHEN final >= 0.7 THEN 'System stable' ELSE 'Retrain model executed or required' END AS recommendation
       FROM fin)"""


def adjusted_health(health, flags):
    """H5: one row from the evaluation health and the drift flags."""
    j = attach(health.select("system_health_score"), flags)
    penalty, score, status, advice = M.drift_adjusted_health(F.col("system_health_score"))
    return j.select(F.col("system_health_score").alias("evaluation_health_score"),
                    F.round(penalty, 3).alias("drift_penalty"), score.alias("system_health_score"),
                    status.alias("system_status"), advice.alias("recommendation"))


@register("monitoring_health", f"WITH {health_sql(DETAIL_SQL)} SELECT * FROM hl")
def monitoring_health(spark, sf):
    """H5: evaluation health minus drift penalties, status and recommendation."""
    return adjusted_health(health_frame(spark, sf), drift_flags(spark, sf))


@register("monitoring_health_shifted", f"WITH {health_sql(SHIFTED_DETAIL_SQL)} SELECT * FROM hl")
def monitoring_health_shifted(spark, sf):
    """H5 with every penalty."""
    return adjusted_health(health_frame(spark, sf), shifted_flags(spark, sf))


@register("service_snapshot", f"""
SELECT CAST(count(*) AS BIGINT) AS request_count, CAST(count(prediction) AS BIGINT) AS prediction_count,
       CAST(count(*) AS BIGINT) AS feedback_count, CAST(count(true_label) AS BIGINT) AS labelled_count,
       round(avg(latency_ms), 3) AS average_latency_ms, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_request_at
FROM {LOG}""")
def service_snapshot(spark, sf):
    """H7, H8: counts, mean latency and last request time of the log."""
    return M.service_snapshot(prediction_log(spark, sf))


@register("service_metrics_windows", f"""
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS requests, round(avg(latency_ms), 3) AS mean_latency_ms,
       CAST(count(true_label) AS BIGINT) AS labelled
FROM {LOG} GROUP BY ALL""")
def service_metrics_windows(spark, sf):
    """I3 batch twin: requests, mean latency and labelled count per day and type."""
    log = prediction_log(spark, sf)
    g = log.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
        F.count("true_label").cast("bigint").alias("labelled"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "requests", "mean_latency_ms", "labelled")


@register("service_metrics_sliding", f"""
WITH s AS (SELECT TIMESTAMP '2023-12-31 00:00:00' + INTERVAL (h) HOUR AS ws FROM range(0, 24 * 40, 12) t(h))
SELECT strftime(s.ws, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS requests,
       round(avg(latency_ms), 3) AS mean_latency_ms
FROM {LOG} l JOIN s ON l.ts >= s.ws AND l.ts < s.ws + INTERVAL 1 DAY GROUP BY s.ws""")
def service_metrics_sliding(spark, sf):
    """I3 batch twin, sliding form: 1-day windows every 12 hours."""
    log = prediction_log(spark, sf)
    g = log.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "requests",
                    "mean_latency_ms")


_REPORT_SQL = f"""WITH {health_sql(DETAIL_SQL)},
rt AS ({_RETRAIN_SQL} FROM fl f), off AS ({OFFLINE_SQL}), onl AS ({ONLINE_SQL})
SELECT round(d, 6) AS ks_statistic, round(p, 6) AS p_value, round(shift, 6) AS distribution_shift,
       round(gap, 6) AS confidence_gap, covariate_drift, label_drift, concept_drift,
       (covariate_drift AND concept_drift) AS domain_shift, rt.status AS retraining_status, rt.samples AS retraining_samples,
       onl.window_accuracy AS window_accuracy, onl.correct AS window_correct, onl.total_samples AS window_samples,
       off.accuracy AS offline_accuracy, off.total_samples AS offline_samples, onl.accuracy AS online_accuracy,
       (SELECT CAST(count(*) AS BIGINT) FROM {LOG}) AS feedback_samples, hl.system_health_score, hl.system_status,
       hl.recommendation FROM dd, rt, off, onl, hl"""


def report_frame(spark, sf):
    """H6: one row of nested structs; drift, evaluation and retrain are each
    computed once and passed on."""
    full = full_drift(spark, sf)
    flags = D.drift_flags(full)
    online = materialize(online_accuracy(spark, sf))
    offline = materialize(offline_evaluation(spark, sf))
    health = adjusted_health(health_of(offline, online), flags)
    row = full.select(F.struct(*full.columns).alias("drift"))
    row = attach(row, retrain_row(spark, sf, flags).select(F.struct("status", "samples").alias("retraining")))
    row = attach(row, online.select(F.struct(F.col("window_accuracy").alias("accuracy"), "total_samples", "correct",
                                             "window_size").alias("metrics")))
    row = attach(row, offline.select(F.struct(*offline.columns).alias("offline_metrics")))
    row = attach(row, online.select(F.struct("accuracy", "total_samples", "window_size").alias("online_metrics")))
    row = attach(row, prediction_log(spark, sf).agg(F.count(F.lit(1)).cast("bigint").alias("feedback_samples")))
    return attach(row, health.select("system_health_score", "system_status", "recommendation"))


@register("monitoring_report", _REPORT_SQL)
def monitoring_report(spark, sf):
    """H6 + A11: the report written as one JSON document and read back flat."""
    path = scratch_path(spark, "report")
    report = report_frame(spark, sf)
    write_report(report, path)
    r = spark.read.schema(report.schema).json(path)
    return r.select(
        F.round("drift.covariate_drift.ks_statistic", 6).alias("ks_statistic"),
        F.round("drift.covariate_drift.p_value", 6).alias("p_value"),
        F.round("drift.label_drift.distribution_shift", 6).alias("distribution_shift"),
        F.round("drift.concept_drift.confidence_gap", 6).alias("confidence_gap"),
        *[F.col(f"drift.{c}.drift_detected").alias(c) for c in
          ("covariate_drift", "label_drift", "concept_drift", "domain_shift")],
        F.col("retraining.status").alias("retraining_status"), F.col("retraining.samples").alias("retraining_samples"),
        F.col("metrics.accuracy").alias("window_accuracy"), F.col("metrics.correct").alias("window_correct"),
        F.col("metrics.total_samples").alias("window_samples"),
        F.col("offline_metrics.accuracy").alias("offline_accuracy"),
        F.col("offline_metrics.total_samples").alias("offline_samples"),
        F.col("online_metrics.accuracy").alias("online_accuracy"), "feedback_samples", "system_health_score",
        "system_status", "recommendation")


@register("health_log", f"""
SELECT CAST(count(*) AS BIGINT) AS request_count, CAST(count(prediction) AS BIGINT) AS prediction_count,
       CAST(count(*) AS BIGINT) AS feedback_count, round(avg(latency_ms), 3) AS average_latency_ms,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_request_at FROM {LOG}""")
def health_log(spark, sf):
    """The service snapshot appended to the health log and read back."""
    path = scratch_path(spark, "health")
    write_health(M.service_snapshot(prediction_log(spark, sf)), path)
    return read_json_log(spark, path, HEALTH_SCHEMA).drop("timestamp")
