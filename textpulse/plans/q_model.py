"""Label mapping (B13-B16) and model queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from textpulse.functions import labels as L
from textpulse.functions.text import clean_text, compute_once, sql_clean
from textpulse.operators import jobs as JB
from textpulse.operators import model as MD
from textpulse.operators import predictor
from textpulse.operators import runs as RN
from textpulse.operators import tfidf as TF
from textpulse.operators.estimator import TextClassifier, TextClassifierModel
from textpulse.operators.evaluation import confusion_counts, summary
from textpulse.operators.scalars import attach
from textpulse.plans.catalog import register
from textpulse.plans.q_drift import DRIFT_FLAGS_SQL, SHIFTED_FLAGS_SQL, drift_flags, shifted_flags
from textpulse.plans.q_features import CLEAN_REVIEWS_SQL, split_frames, tf_sql, vocab_sql
from textpulse.plans.q_sampling import RAW_SPLIT_SQL, split_reviews, split_sql
from textpulse.plans.sqltext import cleaned_docs, view
from textpulse.session import ensure_checkpoint_dir, materialize, scratch_path
from textpulse.sources.fingerprint import fingerprint
from textpulse.sources.tables import prediction_log, table

LOG = view("pred_log")
_STARS_SQL = f"(1 + (CAST(json_extract_string(props, '$.k') AS INTEGER) % 9) * 0.5)"


@register("star_sentiment", f"""
SELECT event_id, CAST({_STARS_SQL} AS DOUBLE) AS stars, {L.sql_stars_to_sentiment(_STARS_SQL)} AS sentiment
FROM events""")
def star_sentiment(spark, sf):
    """Star ratings 1.0-5.0 in half steps (derived from events.props.k)
    mapped to negative / neutral / positive."""
    ev = table(spark, sf, "events")
    stars = (F.lit(1) + (F.get_json_object("props", "$.k").cast("int") % 9) * F.lit(0.5)).cast("double")
    return ev.select("event_id", stars.alias("stars"), L.stars_to_sentiment(stars).alias("sentiment"))


@register("label_normalization", f"""
SELECT doc_id, {L.sql_normalize_label('quality')} AS quality_label, {L.sql_normalize_label('toxic')} AS toxic_label
FROM labels""")
def label_normalization(spark, sf):
    """Numeric 0/1 labels to negative/positive."""
    lb = table(spark, sf, "labels")
    return lb.select("doc_id", L.normalize_label(F.col("quality")).alias("quality_label"),
                     L.normalize_label(F.col("toxic")).alias("toxic_label"))


@register("event_type_labels", f"""
SELECT event_id, {L.sql_normalize_label('upper(event_type)')} AS label FROM events""")
def event_type_labels(spark, sf):
    """B14 on text labels: unknown labels are lower-cased."""
    ev = table(spark, sf, "events")
    return ev.select("event_id", L.normalize_label(F.upper("event_type")).alias("label"))


@register("prediction_records", f"""
SELECT id, CASE WHEN confidence >= 1 - confidence THEN prediction
                ELSE CASE WHEN prediction = 'positive' THEN 'negative' ELSE 'positive' END END AS prediction,
       round(greatest(confidence, 1 - confidence), 6) AS confidence,
       round(CASE WHEN prediction = 'negative' THEN confidence ELSE 1 - confidence END, 6) AS p_negative,
       CAST(0.0 AS DOUBLE) AS p_neutral,
       round(CASE WHEN prediction = 'positive' THEN confidence ELSE 1 - confidence END, 6) AS p_positive
FROM {LOG}""")
def prediction_records(spark, sf):
    """Two-class probabilities (logged class = confidence) expanded
    to the fixed class set, argmax and confidence."""
    log = prediction_log(spark, sf)
    other = F.when(F.col("prediction") == "positive", "negative").otherwise("positive")
    names = F.array(F.col("prediction"), other)
    probs = F.array(F.col("confidence"), F.lit(1.0) - F.col("confidence"))
    cols = L.expand_probabilities(names, probs)
    out = log.select("id", *cols)
    return out.select("id", "prediction", *[F.round(c, 6).alias(c) for c in
                                            ("confidence", "p_negative", "p_neutral", "p_positive")])


def fitted(spark, sf):
    train, test = split_frames(spark, sf)
    return MD.TextModel().fit(train, "cleaned_text", "sentiment"), train, test


@register("lr_test_predictions")
def lr_test_predictions(spark, sf):
    """Class-weighted TF-IDF logistic regression fitted on the
    train split, scored on the test split."""
    m, _, test = fitted(spark, sf)
    return MD.predict(m, test, ["doc_id", "sentiment"])


@register("lr_test_metrics")
def lr_test_metrics(spark, sf):
    """E11 + F1-F2: the composed job (clean, split, TF-IDF, fit, evaluate)."""
    m, _, test = fitted(spark, sf)
    pred = MD.predict(m, test, ["sentiment"])
    pairs = pred.select(L.normalize_label(F.col("sentiment")).alias("t"), F.col("prediction").alias("p"))
    return summary(confusion_counts(pairs, "t", "p"))


_SPLIT = split_sql(CLEAN_REVIEWS_SQL)


@register("lr_model_facts", f"""WITH {_SPLIT},
te AS (SELECT * FROM sp WHERE split = 'test'), tr AS (SELECT * FROM sp WHERE split = 'train')
SELECT (SELECT CAST(count(*) AS BIGINT) FROM tr) AS train_rows, (SELECT CAST(count(*) AS BIGINT) FROM te) AS test_rows,
       'negative,positive' AS classes,
       (SELECT round(max(c) / sum(c), 6) FROM (SELECT count(*) AS c FROM te GROUP BY sentiment)) AS majority_share,
       TRUE AS probabilities_sum_to_one, TRUE AS beats_majority, TRUE AS converged""")
def lr_model_facts(spark, sf):
    """Exact facts of the fit, and whether its invariants hold: class
    probabilities sum to 1, the balanced accuracy on all reviews beats the
    majority class's 0.5, L-BFGS stopped before its iteration limit. (What the fit
    computes is checked by ``lr_small_coefficients`` and ``lr_small_predictions``.)"""
    m, train, test = fitted(spark, sf)
    rows = train.unionByName(test)
    pred = materialize(MD.predict(m, rows, ["sentiment", "split"])
                       .withColumn("truth", L.normalize_label(F.col("sentiment"))))
    ok = F.when(F.col("truth") == F.col("prediction"), 1.0).otherwise(0.0)
    total = F.col("p_negative") + F.col("p_neutral") + F.col("p_positive")
    share = pred.groupBy("truth").agg(F.count(F.when(F.col("split") == "test", 1)).alias("c"), F.avg(ok).alias("recall"))
    share = share.agg(F.round(F.max("c") / F.sum("c"), 6).alias("majority_share"), F.avg("recall").alias("_balanced"))
    facts = attach(pred.agg(F.count(F.when(F.col("split") == "test", 1)).alias("test_rows"), F.max(F.abs(total - 1.0)).alias("_gap")), share)
    return attach(facts, train.agg(F.count(F.lit(1)).alias("train_rows"))).select(
        F.col("train_rows").cast("bigint").alias("train_rows"), F.col("test_rows").cast("bigint").alias("test_rows"),
        F.lit(",".join(L.NUMERIC_LABELS.get(c, c) for c in MD.classes(m))).alias("classes"), "majority_share",
        (F.col("_gap") < 1e-9).alias("probabilities_sum_to_one"), (F.col("_balanced") > 0.5).alias("beats_majority"),
        F.lit(m.iterations < MD.DEFAULT_MAX_ITER).alias("converged"))


# The fit on two terms, solved a second way: Newton's steps over the sums of
# gradient and Hessian, from the same objective sum(w loss) + |b|^2 / 2.
_NEWTON_SQL = f"""WITH RECURSIVE {_SPLIT},
tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'),
{tf_sql('tr')}, {vocab_sql('tr', 2)},
ta AS (SELECT doc_id, {TF.sql_terms('cleaned_text', ngram_max=1)} AS tk FROM sp),
tb AS (SELECT doc_id, unnest(list_concat(tk, [tk[i] || ' ' || tk[i + 1] FOR i IN range(1, len(tk))])) AS term FROM ta),
cell AS (SELECT doc_id, idx, count(*) * any_value(idf) AS w FROM tb JOIN voc ON tb.term = voc.term GROUP BY doc_id, idx),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM cell GROUP BY doc_id),
x AS (SELECT sp.doc_id, sp.split, CAST(sp.sentiment AS DOUBLE) AS y,
             coalesce(sum(w / s) FILTER (WHERE idx = 0), 0.0) AS x1, coalesce(sum(w / s) FILTER (WHERE idx = 1), 0.0) AS x2
      FROM sp LEFT JOIN cell ON sp.doc_id = cell.doc_id LEFT JOIN norm ON sp.doc_id = norm.doc_id
      GROUP BY sp.doc_id, sp.split, sp.sentiment),
xw AS (SELECT x.*, (SELECT count(*) FROM tr) / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM x WHERE split = 'train'),
step AS (
  SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT k + 1, b0 - (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det,
         b1 - (g0 * (h12 * h02 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det,
         b2 - (g0 * (h01 * h12 - h11 * h02) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
        FROM (SELECT k, b0, b1, b2, sum(w * (p - y)) AS g0, sum(w * (p - y) * x1) + b1 AS g1, sum(w * (p - y) * x2) + b2 AS g2,
                     sum(w * q) AS h00, sum(w * q * x1) AS h01, sum(w * q * x2) AS h02, sum(w * q * x1 * x1) + 1 AS h11,
                     sum(w * q * x1 * x2) AS h12, sum(w * q * x2 * x2) + 1 AS h22
              FROM (SELECT k, b0, b1, b2, w, y, x1, x2, p, p * (1 - p) AS q
                    FROM (SELECT step.*, xw.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM step, xw WHERE k < 12))
              GROUP BY k, b0, b1, b2))),
fit AS (SELECT * FROM step WHERE k = 12)"""


def small_fit(spark, sf):
    train, test = split_frames(spark, sf)
    settings = MD.TextModel(max_features=2, tol=1e-12)
    return settings.fit(train, "cleaned_text", "sentiment"), test


@register("lr_small_coefficients", _NEWTON_SQL + """
SELECT '(intercept)' AS term, round(b0, 4) AS coefficient FROM fit
UNION ALL SELECT term, round(CASE WHEN idx = 0 THEN b1 ELSE b2 END, 4) FROM voc, fit""")
def lr_small_coefficients(spark, sf):
    """The weighted, penalised fit on two terms: its coefficients."""
    m, _ = small_fit(spark, sf)
    lr, terms = m.stages[-1], m.stages[1].vocabulary
    rows = [("(intercept)", float(lr.intercept)), *zip(terms, map(float, lr.coefficients))]
    return spark.createDataFrame(rows, "term string, coefficient double").select(
        "term", F.round("coefficient", 4).alias("coefficient"))


@register("lr_small_predictions", _NEWTON_SQL + """
SELECT doc_id, CASE WHEN p > 0.5 THEN 'positive' ELSE 'negative' END AS prediction, round(1 - p, 4) AS p_negative,
       round(p, 4) AS p_positive
FROM (SELECT doc_id, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM x, fit WHERE split = 'test')""")
def lr_small_predictions(spark, sf):
    """Classes and probabilities of the held-out rows by that fit."""
    m, test = small_fit(spark, sf)
    return MD.predict(m, test, ["doc_id"]).select("doc_id", "prediction", F.round("p_negative", 4).alias("p_negative"),
                                                  F.round("p_positive", 4).alias("p_positive"))


_BY_CLASS_SQL = f"""WITH {_SPLIT}
SELECT {L.sql_normalize_label('sentiment')} AS truth, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_same
FROM sp WHERE split = 'test' GROUP BY 1"""


def _same_by_class(mine, base):
    """Rows of each class, and how many have one record in both frames."""
    joined = mine.join(base.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("prediction", "p_negative", "p_positive")]),
                       "doc_id")
    same = (F.col("prediction") == F.col("_prediction")) & (F.abs(F.col("p_positive") - F.col("_p_positive")) < 1e-9) \
        & (F.abs(F.col("p_negative") - F.col("_p_negative")) < 1e-9)
    return joined.groupBy(L.normalize_label(F.col("sentiment")).alias("truth")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.count(F.when(same, 1)).cast("bigint").alias("n_same"))


@register("estimator_records", _BY_CLASS_SQL)
def estimator_records(spark, sf):
    """The Estimator's model, saved and loaded, against the plain fit with
    the same settings: held-out rows with the same record."""
    train, test = split_frames(spark, sf)
    path = scratch_path(spark, "estimator")
    TextClassifier(textCol="cleaned_text", labelCol="sentiment", maxFeatures=1000).fit(train).write().save(path)
    model = TextClassifierModel.load(path)
    base = MD.TextModel(max_features=1000).fit(train, "cleaned_text", "sentiment")
    return _same_by_class(model.records(test, ["doc_id", "sentiment"]), MD.predict(base, test, ["doc_id"]))


@register("sql_predictor_records", _BY_CLASS_SQL)
def sql_predictor_records(spark, sf):
    """The Arrow function in SQL against the model's own transform: held-out
    rows with the same record."""
    m, _, test = fitted(spark, sf)
    name = f"score_text_{uuid.uuid4().hex[:8]}"
    predictor.register(spark, name, m)
    mine = test.selectExpr("doc_id", "sentiment", f"{name}(cleaned_text) AS r").select("doc_id", "sentiment", "r.*")
    return _same_by_class(mine, MD.predict(m, test, ["doc_id"]))


def star_reviews(spark, sf):
    """Documents with a three-class label, their text-length class by star
    rules: short texts 1 star, middle 3, long 5."""
    d = table(spark, sf, "documents").select("doc_id", compute_once(clean_text("text")).alias("cleaned_text"))
    stars = F.when(F.length("cleaned_text") < 800, 1.0).when(F.length("cleaned_text") < 2000, 3.0).otherwise(5.0)
    return d.where(F.length("cleaned_text") > 0).select("doc_id", "cleaned_text", L.stars_to_sentiment(stars).alias("sentiment"))


_STARS3 = f"""(SELECT doc_id, CASE WHEN length(cleaned_text) < 800 THEN 'negative' WHEN length(cleaned_text) < 2000
 THEN 'neutral' ELSE 'positive' END AS sentiment FROM {cleaned_docs()})"""


@register("three_class_facts", f"""
SELECT sentiment, CAST(count(*) AS BIGINT) AS n, TRUE AS probabilities_sum_to_one, TRUE AS beats_majority FROM {_STARS3}
WHERE doc_id % 5 = 0 GROUP BY sentiment""")
def three_class_facts(spark, sf):
    """String labels and three classes: per class its held-out rows (every
    fifth document); their probabilities sum to 1 and the fit's mean recall over
    the classes beats the third that one class for all would have."""
    docs = materialize(star_reviews(spark, sf))
    m = MD.TextModel(max_features=2000, max_iter=50).fit(docs.where("doc_id % 5 <> 0"), "cleaned_text", "sentiment")
    pred = materialize(MD.predict(m, docs.where("doc_id % 5 = 0"), ["sentiment"]))
    total = F.col("p_negative") + F.col("p_neutral") + F.col("p_positive")
    by_class = pred.groupBy("sentiment").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.max(F.abs(total - 1.0)).alias("_gap"),
        F.avg(F.when(F.col("sentiment") == F.col("prediction"), 1.0).otherwise(0.0)).alias("_recall"))
    return attach(by_class, by_class.agg(F.avg("_recall").alias("_mean"))).select(
        "sentiment", "n", (F.col("_gap") < 1e-9).alias("probabilities_sum_to_one"),
        (F.col("_mean") > 1 / 3).alias("beats_majority"))


def run_log_path(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/run_log"


def run_data(spark, sf) -> str:
    """The digest of the reviews' tables."""
    prints = [fingerprint(table(spark, sf, name), name, cols, None) for name, cols in (
        ("documents", ["doc_id", "text"]), ("labels", ["doc_id", "quality"]))]
    return RN.data_id(prints[0].unionByName(prints[1]))


def write_runs(spark, sf, sizes=(100, 200, 400)):
    """One line a run, appended to the run log unless it is there."""
    train, test = split_frames(spark, sf)
    runs = MD.learning_curve(train, test, "doc_id", "cleaned_text", "sentiment", list(sizes))
    names = ("requested", "sample_size", "status", "accuracy", "f1_score", "error")
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in runs], "requested bigint, sample_size bigint, "
                               "status string, accuracy double, f1_score double, error string")
    RN.append_runs(RN.keyed(df, run_data(spark, sf), ["requested"]).coalesce(1), run_log_path(spark))
    return df


@register("learning_curve")
def learning_curve(spark, sf):
    """E10 + A12: nested hash-rank samples of 100, 200, 400 training rows, one
    fit each, appended to the run log."""
    return write_runs(spark, sf)


@register("best_run")
def best_run(spark, sf):
    """Best run of these tables in the log by accuracy (ties: larger sample);
    they are written first if there are none yet."""
    data = run_data(spark, sf)
    if RN.read_runs(spark, run_log_path(spark), data).isEmpty():
        write_runs(spark, sf)
    return RN.best(RN.read_runs(spark, run_log_path(spark), data)).drop("run_id", "data")


_RUNS_SQL = f"""(SELECT event_type AS requested, CAST(count(*) AS BIGINT) AS sample_size,
  round(avg(CASE WHEN prediction = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM {LOG} WHERE true_label IS NOT NULL GROUP BY event_type)"""


def logged_runs(spark, sf):
    """The log's accuracy on each event type as a run each, logged twice, beside
    those of another data set; the runs of this one."""
    log = prediction_log(spark, sf).where(F.col("true_label").isNotNull())
    ok = F.when(F.col("prediction") == F.col("true_label"), 1.0).otherwise(0.0)
    runs = log.groupBy(F.col("event_type").alias("requested")).agg(
        F.count(F.lit(1)).cast("bigint").alias("sample_size"), F.round(F.avg(ok), 6).alias("accuracy")) \
        .withColumn("status", F.lit("ok"))
    schema = "run_id string, data string, requested string, sample_size bigint, accuracy double, status string"
    path = scratch_path(spark, "runs")
    data = RN.data_id(fingerprint(table(spark, sf, "events"), "events", ["event_id", "value"], None))
    for of in (data, "another", data):
        RN.append_runs(RN.keyed(runs, of, ["requested"]), path, schema)
    return RN.read_runs(spark, path, data, schema)


@register("run_log", f"SELECT requested, sample_size, accuracy FROM {_RUNS_SQL}")
def run_log(spark, sf):
    """Each run is in the log once."""
    return logged_runs(spark, sf).select("requested", "sample_size", "accuracy")


@register("best_logged_run", f"SELECT requested, sample_size, accuracy FROM {_RUNS_SQL} "
                             "ORDER BY accuracy DESC, sample_size DESC, requested LIMIT 1")
def best_logged_run(spark, sf):
    """The best of them."""
    return RN.best(logged_runs(spark, sf)).select("requested", "sample_size", "accuracy")


_CURVE_SQL = f"""WITH {_SPLIT},
n AS (SELECT count(*) AS c FROM sp WHERE split = 'train')
SELECT CAST(t.requested AS BIGINT) AS requested, CAST(least(t.requested, n.c) AS BIGINT) AS sample_size
FROM n, (VALUES (100), (200), (400)) t(requested)"""


@register("learning_curve_samples", _CURVE_SQL)
def learning_curve_samples(spark, sf):
    """Rows of each nested sample, as the fits get them."""
    train, _ = split_frames(spark, sf)
    sizes = [100, 200, 400]
    ranks = materialize(train.select("doc_id").join(MD.nested_samples(train, "doc_id", sizes), "doc_id"))
    counts = [F.count(F.when(F.col("rank") <= s, 1)).alias(f"_{s}") for s in sizes]
    wide = ranks.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("requested"),
                                                    F.col(f"_{s}").alias("sample_size")) for s in sizes])).alias("r")).select("r.*")


def retrain_result(spark, sf, flags) -> dict:
    """E12 on the training split's raw texts; the model goes to the shared folder."""
    required = flags.first()["retrain_required"]
    docs = None
    if required:
        docs = split_reviews(spark, sf).where("split = 'train'")
    return MD.retrain(docs, "text", "sentiment", scratch_path(spark, "retrained"), required)


def retrain_row(spark, sf, flags):
    r = retrain_result(spark, sf, flags)
    return spark.createDataFrame([(r["status"], r["samples"])], "status string, samples bigint")


_RETRAIN_SQL = f"""
SELECT CASE WHEN f.retrain_required THEN 'retrained' ELSE 'skipped' END AS status,
       CASE WHEN f.retrain_required THEN (SELECT CAST(count(*) AS BIGINT) FROM (WITH {RAW_SPLIT_SQL} SELECT * FROM sp)
                                          WHERE split = 'train') ELSE CAST(0 AS BIGINT) END AS samples"""


@register("drift_retrain", f"{_RETRAIN_SQL} FROM ({DRIFT_FLAGS_SQL}) f")
def drift_retrain(spark, sf):
    """Refit with the retrain settings only when covariate or label drift
    is flagged."""
    return retrain_row(spark, sf, drift_flags(spark, sf))


@register("drift_retrain_shifted", f"{_RETRAIN_SQL} FROM ({SHIFTED_FLAGS_SQL}) f")
def drift_retrain_shifted(spark, sf):
    """E12 where there is drift: the retrain runs and its model is saved."""
    return retrain_row(spark, sf, shifted_flags(spark, sf))


_JOB_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS cleaner, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(t)) AS BIGINT) AS chars
FROM (SELECT {expr} AS t FROM {view('reviews')}) WHERE length(t) > 0""" for name, expr in (
        ("full", sql_clean("text")), ("keep_case", sql_clean("text", lowercase=False, remove_special=False)),
        ("none", "coalesce(text, '')")))


@register("job_cleaners", _JOB_SQL)
def job_cleaners(spark, sf):
    """The same job with each registered cleaner: rows and characters left."""
    def one(name):
        rows = JB.TextJob(cleaner=name).rows(spark, sf)
        return rows.agg(F.lit(name).alias("cleaner"), F.count(F.lit(1)).cast("bigint").alias("n"),
                        F.sum(F.length("text")).cast("bigint").alias("chars"))
    return reduce(lambda a, b: a.unionByName(b), map(one, ("full", "keep_case", "none")))


@register("pruned_comparison")
def pruned_comparison(spark, sf):
    """Baseline and pruned model refitted on the same training rows:
    terms, size against the baseline, accuracy on the test rows."""
    train, test = split_frames(spark, sf)
    named = lambda d: d.select(F.col("doc_id").alias("id"), F.col("cleaned_text").alias("text"),
                               F.col("sentiment").alias("label"))
    rows = []
    for name in ("baseline", "pruned"):
        job = JB.TextJob(model=name)
        m = job.fit(named(train))
        scored = job.predict(m, named(test)).join(named(test).select("id", "label"), "id")
        ok = F.when(F.col("prediction") == L.normalize_label(F.col("label")), 1.0).otherwise(0.0)
        rows.append((name, len(m.stages[1].vocabulary), scored.agg(F.avg(ok)).first()[0]))
    base = rows[0]
    rows = [(n, t, round(100.0 * (1 - t / base[1]), 2), a, a - base[2]) for n, t, a in rows]
    return spark.createDataFrame(rows, "variant string, terms bigint, size_reduction_pct double, accuracy double, "
                                       "accuracy_change double")
