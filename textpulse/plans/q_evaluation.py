"""Evaluation queries on the prediction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.operators import evaluation as EV
from textpulse.operators.scalars import attach
from textpulse.plans.catalog import register
from textpulse.plans.sqltext import view
from textpulse.sources.tables import prediction_log, table

LOG = view("pred_log")
LABELLED = f"(SELECT * FROM {LOG} WHERE true_label IS NOT NULL)"

_CONF_SQL = f"""
p AS (SELECT true_label AS y_true, prediction AS y_pred, count(*) AS n FROM {LABELLED} WHERE prediction IS NOT NULL
      GROUP BY ALL),
lb AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p),
conf AS (SELECT a.label AS y_true, b.label AS y_pred, CAST(coalesce(p.n, 0) AS BIGINT) AS n
         FROM lb a CROSS JOIN lb b LEFT JOIN p ON p.y_true = a.label AND p.y_pred = b.label),
pc0 AS (SELECT l.label, (SELECT n FROM conf WHERE y_true = l.label AND y_pred = l.label) AS tp,
               (SELECT sum(n) FROM conf WHERE y_true = l.label) AS support,
               (SELECT sum(n) FROM conf WHERE y_pred = l.label) AS predicted FROM lb l),
pc1 AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM pc0),
pc AS (SELECT label, precision, recall,
              CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END
                AS f1_score, CAST(support AS BIGINT) AS support FROM pc1)"""


def labelled_pairs(spark, sf):
    return prediction_log(spark, sf).where(F.col("true_label").isNotNull())


@register("confusion_matrix", f"WITH {_CONF_SQL} SELECT y_true, y_pred, n FROM conf")
def confusion_matrix(spark, sf):
    """confusion counts over the label cross product."""
    return EV.confusion_counts(labelled_pairs(spark, sf), "true_label", "prediction")


@register("classification_report", f"""WITH {_CONF_SQL}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc""")
def classification_report(spark, sf):
    """per-class precision/recall/F1/support plus macro and weighted rows."""
    r = EV.report(EV.confusion_counts(labelled_pairs(spark, sf), "true_label", "prediction"))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@register("classification_summary", f"""WITH {_CONF_SQL}
SELECT round((SELECT sum(n) FROM conf WHERE y_true = y_pred) / (SELECT sum(n) FROM conf), 6) AS accuracy,
       CAST((SELECT sum(n) FROM conf) AS BIGINT) AS samples,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1_score * support) / sum(support), 6) AS f1_score FROM pc""")
def classification_summary(spark, sf):
    """F1, F2: accuracy and weighted precision / recall / F1."""
    s = EV.summary(EV.confusion_counts(labelled_pairs(spark, sf), "true_label", "prediction"))
    return s.select(F.round("accuracy", 6).alias("accuracy"), "samples",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")])


OFFLINE_SQL = f"""
SELECT round(avg(CASE WHEN prediction = true_label THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
       CAST(count(*) AS BIGINT) AS total_samples, 'offline' AS type,
       CASE WHEN count(*) = 0 THEN 'no labelled data' END AS message FROM {LABELLED}"""


@register("offline_evaluation", OFFLINE_SQL)
def offline_evaluation(spark, sf):
    """accuracy (4 digits) and sample count over every labelled record; null
    with a message where there is none."""
    return EV.offline(prediction_log(spark, sf))


@register("offline_evaluation_none", f"""
SELECT CAST(NULL AS DOUBLE) AS accuracy, CAST(0 AS BIGINT) AS total_samples, 'offline' AS type,
       CASE WHEN count(*) >= 0 THEN 'no labelled data' END AS message FROM {LABELLED}""")
def offline_evaluation_none(spark, sf):
    """F5 on the unlabelled records of the log."""
    return EV.offline(prediction_log(spark, sf).where("true_label IS NULL"))


_LAST50 = f"(SELECT * FROM {LABELLED} ORDER BY ts DESC, id DESC LIMIT 50)"
ONLINE_SQL = f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples,
       CAST(coalesce(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct,
       round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 4) AS accuracy,
       round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 3) AS window_accuracy,
       50 AS window_size, CASE WHEN count(*) = 0 THEN 'no labelled data' END AS message FROM {_LAST50}"""


@register("online_accuracy", ONLINE_SQL)
def online_accuracy(spark, sf):
    """accuracy of the last 50 labelled records (by ts, then id); null
    with a message where there is none."""
    return EV.online(prediction_log(spark, sf), 50)


@register("window_accuracy_by_key", f"""
SELECT key, CAST(count(*) AS BIGINT) AS total_samples,
       CAST(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 3) AS accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS rn FROM {LABELLED})
WHERE rn <= 50 GROUP BY key""")
def window_accuracy_by_key(spark, sf):
    """F7 grouped: last-50 accuracy per key (user)."""
    w = EV.window_accuracy(EV.last_n_labelled(prediction_log(spark, sf), 50, "key"), ["key"])
    return w.select("key", "total_samples", "correct",
                    F.round(F.col("correct") / F.col("total_samples"), 3).alias("accuracy"))


_HEALTH_SQL = f"""
o AS (SELECT round(avg(CASE WHEN prediction = true_label THEN 1.0 ELSE 0.0 END), 4) AS offline_accuracy
      FROM {LABELLED}),
n AS (SELECT round(sum(CASE WHEN prediction = true_label THEN 1 ELSE 0 END) / count(*), 4) AS online_accuracy
      FROM {_LAST50}),
h AS (SELECT offline_accuracy, online_accuracy,
             CAST(greatest(1.0 - CASE WHEN offline_accuracy < 0.7 THEN 0.4 ELSE 0.0 END
                          - CASE WHEN online_accuracy IS NOT NULL AND online_accuracy < 0.7 THEN 0.3 ELSE 0.0 END,
                      0.0) AS DOUBLE) AS score FROM o, n)"""


@register("system_health", f"""WITH {_HEALTH_SQL}
SELECT offline_accuracy, online_accuracy, round(score, 3) AS system_health_score,
       CASE WHEN score < 0.4 THEN 'CRITICAL' WHEN score < 0.7 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM h""")
def system_health(spark, sf):
    """F8: combined offline/online evaluation health score and status."""
    return health_frame(spark, sf)


def health_of(offline, online):
    """F8 from the two evaluations."""
    j = attach(offline.select(F.col("accuracy").alias("offline_accuracy")),
               online.select(F.col("accuracy").alias("online_accuracy")))
    score = EV.health(F.col("offline_accuracy"), F.col("online_accuracy"))
    return j.select("offline_accuracy", "online_accuracy", F.round(score, 3).alias("system_health_score"),
                    EV.health_status(score).alias("status"))


def health_frame(spark, sf):
    return health_of(offline_evaluation(spark, sf), online_accuracy(spark, sf))


_LAT_SQL = f"""
g AS (SELECT event_type, count(*) AS n, avg(latency_ms) AS mean, sum(latency_ms) AS total FROM {LOG} GROUP BY 1),
r AS (SELECT event_type, latency_ms, row_number() OVER (PARTITION BY event_type ORDER BY latency_ms) - 1 AS rk
      FROM {LOG}),
st AS (SELECT g.event_type, CAST(g.n AS BIGINT) AS samples, round(g.mean, 3) AS mean_latency_ms,
              round((SELECT latency_ms FROM r WHERE r.event_type = g.event_type
                     AND r.rk = CAST(round_even(0.5 * (g.n - 1), 0) AS BIGINT)), 3) AS p50_latency_ms,
              round((SELECT latency_ms FROM r WHERE r.event_type = g.event_type
                     AND r.rk = CAST(round_even(0.95 * (g.n - 1), 0) AS BIGINT)), 3) AS p95_latency_ms,
              round(CASE WHEN g.total > 0 THEN g.n / (g.total / 1000.0) ELSE 0.0 END, 2) AS throughput_rps
       FROM g)"""


def latency_frame(spark, sf):
    return EV.latency_stats(prediction_log(spark, sf), "event_type", "latency_ms")


@register("latency_stats", f"WITH {_LAT_SQL} SELECT * FROM st")
def latency_stats(spark, sf):
    """per event type mean / nearest-rank p50, p95 / throughput."""
    return latency_frame(spark, sf)


def benchmark_sql() -> str:
    """CTEs ending in ``tb``: the comparison table."""
    def gain(x, base):
        return f"CASE WHEN {base} = 0 THEN 0.0 ELSE round(100.0 * (1 - {x} / {base}), 2) END"
    return f"""{_LAT_SQL},
mem AS (SELECT event_type, round(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) + avg(value), 3) AS peak_memory_mb,
               round(count(DISTINCT user_id) / 1000.0, 3) AS model_size_mb FROM events GROUP BY 1),
vs AS (SELECT st.*, mem.peak_memory_mb, mem.model_size_mb FROM st JOIN mem ON st.event_type = mem.event_type),
b AS (SELECT mean_latency_ms AS bm, p95_latency_ms AS bp, peak_memory_mb AS bk, model_size_mb AS bs FROM vs
      ORDER BY CASE WHEN event_type = 'baseline' THEN 0 ELSE 1 END, event_type LIMIT 1),
tb AS (SELECT vs.*, {gain('mean_latency_ms', 'bm')} AS latency_improvement_pct,
       {gain('p95_latency_ms', 'bp')} AS p95_improvement_pct, {gain('peak_memory_mb', 'bk')} AS memory_improvement_pct,
       {gain('model_size_mb', 'bs')} AS size_reduction_pct FROM vs, b)"""


def benchmark_frame(spark, sf):
    """Variants are event types. The log holds no memory or model sizes; stand-ins
    are derived from its columns so that the arithmetic runs on real rows."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    mem = ev.groupBy("event_type").agg(F.round(F.max(k) + F.avg("value"), 3).alias("peak_memory_mb"),
                                       F.round(F.countDistinct("user_id") / 1000.0, 3).alias("model_size_mb"))
    return EV.compare_variants(latency_frame(spark, sf).join(mem, "event_type"), "event_type")


@register("variant_comparison", f"WITH {benchmark_sql()} SELECT * FROM tb")
def variant_comparison(spark, sf):
    """latency, memory and size gains of each variant (event type) against
    the baseline row."""
    return benchmark_frame(spark, sf)


@register("latency_markdown", f"""WITH {benchmark_sql()},
body AS (SELECT string_agg(printf('{EV.MARKDOWN_ROW}', event_type, mean_latency_ms, p50_latency_ms, p95_latency_ms,
           throughput_rps, peak_memory_mb, model_size_mb, latency_improvement_pct, memory_improvement_pct), chr(10)
           ORDER BY event_type) AS b FROM tb)
SELECT concat_ws(chr(10), '{EV.MARKDOWN_HEADER.splitlines()[0]}', '{EV.MARKDOWN_HEADER.splitlines()[1]}', b)
       AS markdown FROM body""")
def latency_markdown(spark, sf):
    """the comparison rendered as markdown (one row)."""
    return EV.markdown_table(benchmark_frame(spark, sf), "event_type")
