"""Drift queries (G1-G13, A4, I6 batch twin) over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions.stats import sql_ks_pvalue
from textpulse.functions.text import clean_text, compute_once
from textpulse.operators import drift as D
from textpulse.plans.catalog import register
from textpulse.session import materialize
from textpulse.plans.sqltext import cleaned_docs, feature_rows, psi_sql, view
from textpulse.sources.tables import prediction_log, reviews, table


def _en():
    return F.col("lang") == "en"


def _not_en():
    return F.col("lang") != "en"


def side_of_lang():
    """0 for English (reference), 1 for other languages (production); none
    without a language."""
    return F.when(_en(), 0).when(_not_en(), 1).alias("_side")


def psi_counts(spark, sf):
    """Value counts of both sides: documents are read and cleaned once."""
    d = table(spark, sf, "documents").where(F.col("lang").isNotNull()).select(
        side_of_lang(), compute_once(clean_text("text")).alias("cleaned_text"))
    return D.value_counts(D.feature_values(d.where(F.length("cleaned_text") > 0), "cleaned_text", keep=["_side"]))


def psi_clean(spark, sf):
    return D.psi_from_counts(psi_counts(spark, sf))


@register("psi_report", psi_sql(feature_rows(cleaned_docs("lang = 'en'"), "cleaned_text"),
                                 feature_rows(cleaned_docs("lang <> 'en'"), "cleaned_text")))
def psi_report(spark, sf):
    """G1-G6 flagship: PSI of three text features, English (reference) vs
    other-language (production) documents, both cleaned."""
    return psi_clean(spark, sf)


@register("psi_report_raw", psi_sql(feature_rows(view("ref_text"), "text"),
                                     feature_rows(view("prod_text"), "text")))
def psi_report_raw(spark, sf):
    """G6 on raw text of both sides."""
    d = table(spark, sf, "documents").where(F.col("lang").isNotNull()).select(side_of_lang(), "text")
    return D.psi_from_counts(D.value_counts(D.feature_values(d, "text", keep=["_side"])))


_PSI_CLEAN_SQL = psi_sql(feature_rows(cleaned_docs("lang = 'en'"), "cleaned_text"),
                         feature_rows(cleaned_docs("lang <> 'en'"), "cleaned_text"))


@register("psi_status", f"""
WITH p AS ({_PSI_CLEAN_SQL}),
cnt AS (SELECT (SELECT count(*) FROM {cleaned_docs("lang = 'en'")}) AS reference_rows,
               (SELECT count(*) FROM {cleaned_docs("lang <> 'en'")}) AS production_rows)
SELECT CASE WHEN cnt.production_rows = 0 THEN 'insufficient_data'
            WHEN max(CASE status WHEN 'Significant shift' THEN 2 WHEN 'Moderate shift' THEN 1 ELSE 0 END) = 2
              THEN 'Significant shift'
            WHEN max(CASE status WHEN 'Significant shift' THEN 2 WHEN 'Moderate shift' THEN 1 ELSE 0 END) = 1
              THEN 'Moderate shift' ELSE 'No change' END AS status,
       CAST(cnt.reference_rows AS BIGINT) AS reference_rows, CAST(cnt.production_rows AS BIGINT) AS production_rows
FROM cnt LEFT JOIN p ON TRUE GROUP BY cnt.reference_rows, cnt.production_rows""")
def psi_status(spark, sf):
    """G7 + A4: worst feature status; 'insufficient_data' when production is empty."""
    vc = psi_counts(spark, sf)
    return D.psi_report_status(D.psi_from_counts(vc), vc)


def documents_by_side(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang").isNotNull()).select(side_of_lang(), "text")


@register("ks_length_drift", f"""
WITH a AS (SELECT length(coalesce(text, '')) AS v FROM {view('ref_text')}),
b AS (SELECT length(coalesce(text, '')) AS v FROM {view('prod_text')}),
na AS (SELECT count(*) AS n1 FROM a), nb AS (SELECT count(*) AS n2 FROM b),
vals AS (SELECT DISTINCT v FROM (SELECT v FROM a UNION ALL SELECT v FROM b)),
cdf AS (SELECT vals.v, (SELECT count(*) FROM a WHERE a.v <= vals.v) AS ca,
               (SELECT count(*) FROM b WHERE b.v <= vals.v) AS cb FROM vals),
ks AS (SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, max(abs(ca / n1 - cb / n2)) AS d
       FROM cdf, na, nb GROUP BY n1, n2)
SELECT n1, n2, round(d, 6) AS ks_statistic, round({sql_ks_pvalue('d', 'n1', 'n2')}, 6) AS p_value,
       {sql_ks_pvalue('d', 'n1', 'n2')} < 0.05 AS drift_detected FROM ks""")
def ks_length_drift(spark, sf):
    """Two-sample KS on raw text length, English vs other documents."""
    r = D.text_length_drift(documents_by_side(spark, sf))
    return r.select("n1", "n2", F.round("ks_statistic", 6).alias("ks_statistic"),
                    F.round("p_value", 6).alias("p_value"), "drift_detected")


@register("label_drift", f"""
WITH r AS (SELECT CAST(sentiment AS VARCHAR) AS lbl FROM {view('reviews')} WHERE lang = 'en' AND sentiment IS NOT NULL),
p AS (SELECT CAST(sentiment AS VARCHAR) AS lbl FROM {view('reviews')} WHERE lang <> 'en' AND sentiment IS NOT NULL),
ra AS (SELECT lbl, count(*) / (SELECT count(*) FROM r) AS pa FROM r GROUP BY lbl),
pb AS (SELECT lbl, count(*) / (SELECT count(*) FROM p) AS pb FROM p GROUP BY lbl),
s AS (SELECT coalesce(sum(abs(coalesce(pa, 0) - coalesce(pb, 0))), 0.0) AS d FROM ra FULL OUTER JOIN pb USING (lbl))
SELECT round(d, 6) AS distribution_shift, d > 0.2 AS drift_detected FROM s""")
def label_drift(spark, sf):
    """Label share shift between English and other-language reviews."""
    rv = reviews(spark, sf)
    r = D.label_drift(rv.where(_en()), rv.where(_not_en()), "sentiment")
    return r.select(F.round("distribution_shift", 6).alias("distribution_shift"), "drift_detected")


@register("concept_drift", f"""
WITH l AS (SELECT * FROM {view('pred_log')} WHERE true_label IS NOT NULL),
s AS (SELECT coalesce(avg(confidence) FILTER (WHERE prediction = true_label), 0.0) AS c,
             coalesce(avg(confidence) FILTER (WHERE prediction <> true_label), 0.0) AS w FROM l)
SELECT round(c, 6) AS avg_conf_correct, round(w, 6) AS avg_conf_wrong, round(w - c, 6) AS confidence_gap,
       (w - c) > 0.15 AS drift_detected FROM s""")
def concept_drift(spark, sf):
    """G11 on the prediction log."""
    r = D.concept_drift(prediction_log(spark, sf))
    return r.select(*[F.round(c, 6).alias(c) for c in ("avg_conf_correct", "avg_conf_wrong", "confidence_gap")],
                    "drift_detected")


def drift_detail_sql(a: str, b: str, r: str, p: str, scored: str) -> str:
    """CTEs ending in ``dd``: one row of all drift numbers. ``a``, ``b``: text
    lengths ``v``; ``r``, ``p``: labels ``lbl``; ``scored``: a labelled log."""
    return f"""
a AS ({a}), b AS ({b}),
na AS (SELECT count(*) AS n1 FROM a), nb AS (SELECT count(*) AS n2 FROM b),
ca AS (SELECT v, count(*) AS c FROM a GROUP BY v), cb AS (SELECT v, count(*) AS c FROM b GROUP BY v),
cdf AS (SELECT sum(coalesce(ca.c, 0)) OVER (ORDER BY v) AS ca, sum(coalesce(cb.c, 0)) OVER (ORDER BY v) AS cb
        FROM ca FULL OUTER JOIN cb USING (v)),
ks AS (SELECT n1, n2, max(abs(ca / n1 - cb / n2)) AS d FROM cdf, na, nb GROUP BY n1, n2),
cov AS (SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, d, {sql_ks_pvalue('d', 'n1', 'n2')} AS p FROM ks),
r AS ({r}), p AS ({p}),
ra AS (SELECT lbl, count(*) / (SELECT count(*) FROM r) AS pa FROM r GROUP BY lbl),
pb AS (SELECT lbl, count(*) / (SELECT count(*) FROM p) AS pb FROM p GROUP BY lbl),
lab AS (SELECT coalesce(sum(abs(coalesce(pa, 0) - coalesce(pb, 0))), 0.0) AS shift FROM ra FULL OUTER JOIN pb USING (lbl)),
l AS (SELECT * FROM {scored} WHERE true_label IS NOT NULL),
con AS (SELECT coalesce(avg(confidence) FILTER (WHERE prediction = true_label), 0.0) AS right_conf,
               coalesce(avg(confidence) FILTER (WHERE prediction <> true_label), 0.0) AS wrong_conf FROM l),
dd AS (SELECT n1, n2, d, p, shift, right_conf, wrong_conf, wrong_conf - right_conf AS gap, p < 0.05 AS covariate_drift,
              shift > 0.2 AS label_drift, (wrong_conf - right_conf) > 0.15 AS concept_drift FROM cov, lab, con)"""


FLAGS_OF_DETAIL = """SELECT covariate_drift, label_drift, concept_drift, (covariate_drift AND concept_drift) AS domain_shift,
       (covariate_drift OR label_drift) AS retrain_required FROM dd"""
_REVIEW_LABELS = f"SELECT CAST(sentiment AS VARCHAR) AS lbl FROM {view('reviews')} WHERE sentiment IS NOT NULL AND lang "
DETAIL_SQL = drift_detail_sql(f"SELECT length(coalesce(text, '')) AS v FROM {view('ref_text')}",
                              f"SELECT length(coalesce(text, '')) AS v FROM {view('prod_text')}",
                              _REVIEW_LABELS + "= 'en'", _REVIEW_LABELS + "<> 'en'", view("pred_log"))
DRIFT_FLAGS_SQL = f"WITH {DETAIL_SQL} {FLAGS_OF_DETAIL}"

# A cut of the tables that does drift: turns of conversations against documents,
# toxicity labels against quality labels, and a log whose confident predictions
# are the wrong ones.
OVERCONFIDENT_FROM = 0.75
_OVERCONFIDENT_SQL = f"""(SELECT * REPLACE (CASE WHEN confidence < {OVERCONFIDENT_FROM} THEN true_label
  WHEN true_label = 'positive' THEN 'negative' WHEN true_label IS NOT NULL THEN 'positive' END AS prediction)
  FROM {view('pred_log')})"""
SHIFTED_DETAIL_SQL = drift_detail_sql("SELECT length(coalesce(text, '')) AS v FROM documents",
                                      "SELECT length(coalesce(text, '')) AS v FROM conversations",
                                      "SELECT CAST(quality AS VARCHAR) AS lbl FROM labels WHERE quality IS NOT NULL",
                                      "SELECT CAST(toxic AS VARCHAR) AS lbl FROM labels WHERE toxic IS NOT NULL",
                                      _OVERCONFIDENT_SQL)
SHIFTED_FLAGS_SQL = f"WITH {SHIFTED_DETAIL_SQL} {FLAGS_OF_DETAIL}"


def full_drift(spark, sf):
    """G13 of the tables as they are; saved, since alerts, health and report read it."""
    rv = reviews(spark, sf).select("lang", "sentiment")
    return materialize(D.full_drift(documents_by_side(spark, sf), rv.where(_en()), rv.where(_not_en()),
                                    prediction_log(spark, sf), label_col="sentiment"))


def shifted_drift(spark, sf):
    """G13 of a cut that drifts in every respect."""
    texts = D.sides(table(spark, sf, "documents").select("text"), table(spark, sf, "conversations").select("text"))
    lb = table(spark, sf, "labels")
    wrong = F.when(F.col("true_label") == "positive", "negative").when(F.col("true_label").isNotNull(), "positive")
    log = prediction_log(spark, sf).withColumn(
        "prediction", F.when(F.col("confidence") < OVERCONFIDENT_FROM, F.col("true_label")).otherwise(wrong))
    return materialize(D.full_drift(texts, lb.select(F.col("quality").alias("label")),
                                    lb.select(F.col("toxic").alias("label")), log))


def drift_flags(spark, sf):
    return D.drift_flags(full_drift(spark, sf))


def shifted_flags(spark, sf):
    return D.drift_flags(shifted_drift(spark, sf))


@register("drift_summary", DRIFT_FLAGS_SQL)
def drift_summary(spark, sf):
    """The four drift flags and the retrain trigger in one row."""
    return drift_flags(spark, sf)


@register("drift_summary_shifted", SHIFTED_FLAGS_SQL)
def drift_summary_shifted(spark, sf):
    """G12, G13, H4 where every flag is up."""
    return shifted_flags(spark, sf)


def _detail_columns(full):
    return full.select(
        F.col("covariate_drift.n1").alias("n1"), F.col("covariate_drift.n2").alias("n2"),
        F.round("covariate_drift.ks_statistic", 6).alias("ks_statistic"), F.round("covariate_drift.p_value", 6).alias("p_value"),
        F.round("label_drift.distribution_shift", 6).alias("distribution_shift"),
        *[F.round(f"concept_drift.{c}", 6).alias(c) for c in ("avg_conf_correct", "avg_conf_wrong", "confidence_gap")],
        F.col("domain_shift.drift_detected").alias("domain_shift"))


_DETAIL_OUT = """SELECT n1, n2, round(d, 6) AS ks_statistic, round(p, 6) AS p_value, round(shift, 6) AS distribution_shift,
 round(right_conf, 6) AS avg_conf_correct, round(wrong_conf, 6) AS avg_conf_wrong, round(gap, 6) AS confidence_gap,
 (covariate_drift AND concept_drift) AS domain_shift FROM dd"""


@register("drift_detail", f"WITH {DETAIL_SQL} {_DETAIL_OUT}")
def drift_detail(spark, sf):
    """The numbers of the nested drift result."""
    return _detail_columns(full_drift(spark, sf))


@register("drift_detail_shifted", f"WITH {SHIFTED_DETAIL_SQL} {_DETAIL_OUT}")
def drift_detail_shifted(spark, sf):
    """G13 on the cut that drifts."""
    return _detail_columns(shifted_drift(spark, sf))


LATENCY_BORDER = "2024-01-08 00:00:00"  # reference: before it; production: from it on
_LAT_REF = "(SELECT 'latency_ms' AS feature, latency_ms AS value FROM " + view("pred_log") + \
    f" WHERE ts < TIMESTAMP '{LATENCY_BORDER}')"
_LAT_PROD = "(SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'latency_ms' AS feature, " \
    "latency_ms AS value FROM " + view("pred_log") + f" WHERE ts >= TIMESTAMP '{LATENCY_BORDER}')"


@register("psi_daily_latency", psi_sql(_LAT_REF, _LAT_PROD, prod_keys=("day",)))
def psi_daily_latency(spark, sf):
    """I6 batch twin: PSI of each day's latency against the first week."""
    log = prediction_log(spark, sf)
    cut = F.lit(LATENCY_BORDER).cast("timestamp")
    ref = log.where(F.col("ts") < cut).select(F.lit("latency_ms").alias("feature"),
                                              F.col("latency_ms").alias("value"))
    prod = log.where(F.col("ts") >= cut).select(
        F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"),
        F.lit("latency_ms").alias("feature"), F.col("latency_ms").alias("value"))
    return D.psi_by_feature(ref, prod, extra_keys=["day"])


_K7 = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_EDGE_ROWS = f"""(SELECT feature, side, CASE feature
    WHEN 'gaps' THEN CASE WHEN k % 7 = 0 THEN 'NaN'::DOUBLE WHEN k % 11 = 0 THEN 'Infinity'::DOUBLE
                          WHEN k % 13 = 0 THEN '-Infinity'::DOUBLE WHEN k % 5 = 0 THEN NULL ELSE value END
    WHEN 'constant' THEN CASE WHEN side = 0 THEN 3.0 ELSE 3.0 + k % 2 END
    WHEN 'two_values' THEN CAST(k % 2 AS DOUBLE)
    WHEN 'no_reference' THEN CASE WHEN side = 0 THEN 'NaN'::DOUBLE ELSE value END
    WHEN 'no_production' THEN CASE WHEN side = 0 THEN value END END AS value
  FROM (SELECT event_id % 2 AS side, {_K7} AS k, value FROM events),
       (VALUES ('gaps'), ('constant'), ('two_values'), ('no_reference'), ('no_production')) t(feature))"""


@register("psi_edge_features", psi_sql(f"(SELECT * FROM {_EDGE_ROWS} WHERE side = 0)", f"(SELECT * FROM {_EDGE_ROWS} WHERE side = 1)"))
def psi_edge_features(spark, sf):
    """Features with null, NaN and infinite values, with one value or
    two (equal-width buckets), and without a finite value on one side (no row)."""
    k, v, side = F.get_json_object("props", "$.k").cast("int"), F.col("value"), F.col("event_id") % 2
    inf = float("inf")
    features = {
        "gaps": F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, inf).when(k % 13 == 0, -inf).when(k % 5 != 0, v),
        "constant": F.when(side == 0, 3.0).otherwise(3.0 + k % 2), "two_values": (k % 2).cast("double"),
        "no_reference": F.when(side == 0, float("nan")).otherwise(v), "no_production": F.when(side == 0, v)}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value"))
                                for n, c in features.items()])).alias("f")
    rows = table(spark, sf, "events").select(side.cast("int").alias("_side"), pairs).select("_side", "f.*")
    return D.psi_from_counts(D.value_counts(rows))
