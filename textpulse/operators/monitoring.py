"""Monitoring: alerts (H1-H3, H9), drift-adjusted
health (H5), report assembly (H6), service metrics (H7, H8).

All inputs are one-row aggregate frames; the rules are column expressions,
so the same functions run on a batch result or inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators.evaluation import health_status

# ---- fixed values ---------------------------------------------------------
DRIFT_RULES = (  # (flag column, severity, message)
    ("covariate_drift", "WARNING", "Covariate drift detected"),
    ("label_drift", "WARNING", "Label drift detected"),
    ("concept_drift", "CRITICAL", "Concept drift detected"),
    ("domain_shift", "CRITICAL", "Domain shift detected"),
)
DRIFT_PENALTY = {"covariate_drift": 0.2, "label_drift": 0.2, "concept_drift": 0.3, "domain_shift": 0.3}
ACCURACY_CRITICAL_BELOW = 0.6
ACCURACY_WARNING_BELOW = 0.75
MSG_ACCURACY_CRITICAL = "Severe accuracy drop detected"
MSG_ACCURACY_WARNING = "Moderate accuracy drop detected"
MSG_RETRAINED = "Model retrained successfully"
MSG_RETRAIN_SKIPPED = "Retraining skipped"
RECOMMEND_RETRAIN = "Retrain model executed or required"
RECOMMEND_STABLE = "System stable"
# ---------------------------------------------------------------------------


def _number(x) -> F.Column:
    return F.format_string("%.6f", x.cast("double"))


def drift_meta(name: str) -> F.Column:
    """The result of one drift check as JSON text, numbers to 6 places."""
    fields = {"covariate_drift": ("ks_statistic", "p_value"), "label_drift": ("distribution_shift",),
              "concept_drift": ("avg_conf_correct", "avg_conf_wrong", "confidence_gap"), "domain_shift": ()}[name]
    parts = [F.concat(F.lit('{"method":"'), F.col(f"{name}.method"), F.lit('"'))]
    parts += [F.concat(F.lit(f',"{f}":'), F.coalesce(_number(F.col(f"{name}.{f}")), F.lit("null"))) for f in fields]
    return F.concat(*parts, F.lit(',"drift_detected":'), F.col(f"{name}.drift_detected").cast("string"), F.lit("}"))


def drift_alerts(full: DataFrame) -> DataFrame:
    """H1: one alert row per raised flag of the full drift result
    ``(type, severity, message, meta)``."""
    rules = F.array(*[F.struct(F.col(f"{c}.drift_detected").alias("raised"), F.lit(s).alias("severity"),
                               F.lit(m).alias("message"), drift_meta(c).alias("meta")) for c, s, m in DRIFT_RULES])
    return full.select(F.explode(rules).alias("r")).where("r.raised").select(
        F.lit("DRIFT").alias("type"), "r.severity", "r.message", "r.meta")


def accuracy_alerts(metrics: DataFrame, acc_col: str = "accuracy", meta: F.Column | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """H2: CRITICAL below 0.6, WARNING below 0.75, nothing when unknown; after
    the columns ``keep``."""
    a = F.col(acc_col)
    sev = F.when(a < ACCURACY_CRITICAL_BELOW, "CRITICAL").when(a < ACCURACY_WARNING_BELOW, "WARNING")
    msg = F.when(a < ACCURACY_CRITICAL_BELOW, MSG_ACCURACY_CRITICAL).when(a < ACCURACY_WARNING_BELOW,
                                                                           MSG_ACCURACY_WARNING)
    if meta is None:
        meta = F.concat(F.lit('{"accuracy":'), _number(a), F.lit("}"))
    return metrics.select(*keep, F.lit("METRICS").alias("type"), sev.alias("severity"), msg.alias("message"),
                          meta.alias("meta")).where(F.col("severity").isNotNull())


def retrain_alert(result: DataFrame) -> DataFrame:
    """H3: always one INFO row, from what the retrain step says it did
    (``status``, ``samples``)."""
    done = F.col("status") == "retrained"
    meta = F.concat(F.lit('{"status":"'), F.col("status"), F.lit('","samples":'), F.col("samples").cast("string"), F.lit("}"))
    return result.select(F.lit("RETRAIN").alias("type"), F.lit("INFO").alias("severity"),
                         F.when(done, MSG_RETRAINED).otherwise(MSG_RETRAIN_SKIPPED).alias("message"), meta.alias("meta"))


def drift_adjusted_health(base_health_col, flags_prefix: str = "") -> tuple:
    """H5: base health minus drift penalties, floor 0, 3 digits, status, advice."""
    penalty = sum(F.when(F.col(flags_prefix + c), p).otherwise(0.0) for c, p in DRIFT_PENALTY.items())
    score = F.greatest(F.round(base_health_col - penalty, 3), F.lit(0.0))
    status = health_status(score)
    advice = F.when(status != "HEALTHY", RECOMMEND_RETRAIN).otherwise(RECOMMEND_STABLE)
    return penalty, score, status, advice


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """H9: counts by (type, severity) with sub-totals per type and a grand total."""
    r = alerts.rollup("type", "severity").agg(F.count(F.lit(1)).cast("bigint").alias("alerts"))
    return r.select(F.coalesce("type", F.lit("ALL")).alias("type"),
                    F.coalesce("severity", F.lit("ALL")).alias("severity"), "alerts")


def service_snapshot(log: DataFrame) -> DataFrame:
    """H7, H8: requests, predictions made, feedback records (labelled or not),
    labelled ones, mean latency, last request."""
    return log.agg(
        F.count(F.lit(1)).cast("bigint").alias("request_count"),
        F.count("prediction").cast("bigint").alias("prediction_count"),
        F.count(F.lit(1)).cast("bigint").alias("feedback_count"),
        F.count("true_label").cast("bigint").alias("labelled_count"),
        F.round(F.avg("latency_ms"), 3).alias("average_latency_ms"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_request_at"))
