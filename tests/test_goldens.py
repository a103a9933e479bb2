"""Golden values of the reference reports (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from textpulse.functions import labels as L
from textpulse.functions.stats import ks_pvalue
from textpulse.operators import drift as D
from textpulse.operators import evaluation as EV
from textpulse.operators import monitoring as M


def _pairs(spark, cells):
    parts = [spark.range(n).select(F.lit(t).alias("t"), F.lit(p).alias("p")) for (t, p), n in cells.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def test_classification_golden(spark):
    pairs = _pairs(spark, {("0", "0"): 6025, ("0", "1"): 887, ("1", "0"): 812, ("1", "1"): 6158})
    s = EV.summary(EV.confusion_counts(pairs, "t", "p")).first()
    assert math.isclose(s["accuracy"], 0.8776112952024204, rel_tol=1e-12)
    assert math.isclose(s["precision"], 0.877649866859864, rel_tol=1e-12)
    assert math.isclose(s["recall"], 0.8776112952024204, rel_tol=1e-12)
    assert math.isclose(s["f1_score"], 0.8776049595691742, rel_tol=1e-12)
    sup = {r["label"]: r["support"] for r in EV.per_class(EV.confusion_counts(pairs, "t", "p")).collect()}
    assert sup == {"0": 6912, "1": 6970}


def test_zero_division(spark):
    pairs = _pairs(spark, {("a", "a"): 3, ("a", "b"): 1})
    pc = {r["label"]: r for r in EV.per_class(EV.confusion_counts(pairs, "t", "p")).collect()}
    assert pc["b"]["precision"] == 0.0 and pc["b"]["recall"] == 0.0 and pc["b"]["f1_score"] == 0.0


def _p(spark, d, n1, n2):
    return spark.range(1).select(ks_pvalue(F.lit(d), F.lit(n1), F.lit(n2)).alias("p")).first()["p"]


def test_ks_pvalue_golden(spark):
    p = _p(spark, 0.01736, 25000, 25000)
    assert math.isclose(p, 0.0010562421, rel_tol=1e-8) and p < 0.05


def exact_ks_pvalue(d, n):
    """Exact one-sample p-value by powers of Durbin's matrix (Marsaglia, Tsang and
    Wang), in fractions' stead with floats and a running exponent."""
    import numpy as np
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    mat = np.array([[0.0 if i - j + 1 < 0 else 1.0 for j in range(m)] for i in range(m)])
    for i in range(m):
        mat[i, 0] -= h ** (i + 1)
        mat[m - 1, i] -= h ** (m - i)
    mat[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    for i in range(m):
        for j in range(m):
            mat[i, j] /= math.factorial(max(0, i - j + 1))
    power, log, base, base_log, left = np.eye(m), 0.0, mat, 0.0, n
    while left:
        if left & 1:
            power, log = power @ base, log + base_log
            log, power = log + math.log(power.max()), power / power.max()
        base, base_log = base @ base, 2 * base_log
        base_log, base = base_log + math.log(base.max()), base / base.max()
        left >>= 1
    return 1 - math.exp(math.log(power[k - 1, k - 1]) + log + math.lgamma(n + 1) - n * math.log(n))


def test_ks_pvalue_against_the_exact_distribution(spark):
    for n, d in ((48, 0.1), (50, 0.2), (188, 0.1), (237, 0.0457), (500, 0.05)):
        assert math.isclose(_p(spark, d, 2 * n, 2 * n), exact_ks_pvalue(d, n), abs_tol=1e-5)


def test_ks_pvalue_of_close_and_far_samples(spark):
    assert _p(spark, 1e-6, 10**6, 10**6 + 1) > 0.99
    assert _p(spark, 1e-4, 10_000, 10_000) > 0.99 and _p(spark, 0.0, 5, 5) == 1.0
    assert _p(spark, 1.0, 100, 100) == 0.0 and _p(spark, 0.5, 10_000, 10_000) == 0.0
    assert _p(spark, 0.1, 0, 10) is None


def test_one_more_row_is_no_drift(spark):
    a = spark.range(10**6).select(F.lit(0).alias("_side"), F.repeat(F.lit("x"), (F.col("id") % 500).cast("int")).alias("text"))
    b = a.unionByName(spark.range(1).select(F.lit(0).alias("_side"), F.lit("xx").alias("text")))
    r = D.text_length_drift(a.unionByName(b.withColumn("_side", F.lit(1)))).first()
    assert r["p_value"] > 0.99 and not r["drift_detected"]


def test_empty_sides(spark):
    some = spark.createDataFrame([("abc",), ("de",)], "text string")
    none = some.limit(0)
    for ref, prod in ((some, none), (none, some), (none, none)):
        r = D.text_length_drift(D.sides(ref, prod)).first()
        assert r["p_value"] is None and r["drift_detected"] is False
        vc = D.value_counts(D.feature_values(D.sides(ref, prod), "text", keep=["_side"]))
        status = D.psi_report_status(D.psi_from_counts(vc), vc).first()
        assert status["status"] == "insufficient_data"
    full = D.full_drift(D.sides(some, none), some.withColumn("label", F.lit("a")), none.withColumn("label", F.lit("a")), None)
    row = full.first()
    assert row["concept_drift"]["note"] == "model_not_loaded" and row["label_drift"]["distribution_shift"] == 1.0
    assert row["covariate_drift"]["drift_detected"] is False and row["domain_shift"]["drift_detected"] is False


def test_constant_and_non_finite_features(spark):
    nan, inf = float("nan"), float("inf")
    ref = spark.createDataFrame([("c", 3.0)] * 20 + [("c", nan), ("c", inf), ("c", None)], "feature string, value double")
    prod = spark.createDataFrame([("c", 3.0)] * 5 + [("c", 9.0)] * 5 + [("c", -inf)], "feature string, value double")
    r = D.psi_by_feature(ref, prod).first()
    assert (r["reference_rows"], r["production_rows"]) == (20, 10)
    # 10 equal bins over [3, 4]: all of the reference in the first, half of production in the last
    want = (0.5 - 1) * math.log(0.5 / 1) + (0.5 - 1e-6) * math.log(0.5 / 1e-6)
    assert math.isclose(r["psi"], want, abs_tol=1e-6)


def test_comparison_golden(spark):
    df = spark.createDataFrame([("baseline", 5.878, 1.0, 0.125, 2.0), ("batched", 6.057, 1.0, 0.0, 1.0)],
                               "v string, mean_latency_ms double, p95_latency_ms double, peak_memory_mb double, "
                               "model_size_mb double")
    r = EV.compare_variants(df, "v").where("v = 'batched'").first()
    assert (r["latency_improvement_pct"], r["memory_improvement_pct"], r["size_reduction_pct"]) == (-3.05, 100.0, 50.0)


def test_window_accuracy_golden(spark):
    log = spark.range(60).select("id", F.col("id").cast("timestamp").alias("ts"), F.lit("p").alias("prediction"),
                                 F.when(F.col("id") % 10 == 9, None).when(F.col("id") < 13, "n").otherwise("p").alias("true_label"))
    r = EV.online(log, 50).first()
    assert (r["total_samples"], r["correct"], r["window_accuracy"], r["message"]) == (50, 42, 0.84, None)
    ties = log.withColumn("ts", F.lit(0).cast("timestamp"))
    assert EV.online(ties, 50).first()["correct"] == 42
    golden = spark.range(50).select("id", F.lit(0).cast("timestamp").alias("ts"), F.lit("p").alias("prediction"),
                                    F.when(F.col("id") < 6, "n").otherwise("p").alias("true_label"))
    assert EV.online(golden, 50).first()["window_accuracy"] == 0.88
    r = EV.online(log.withColumn("true_label", F.lit(None).cast("string"))).first()
    assert r["accuracy"] is None and r["message"] == "no labelled data" and r["correct"] == 0


def test_labels_must_be_classes(spark):
    import pytest
    df = spark.range(1200).select(F.col("id").cast("string").alias("t"), F.lit("a").alias("p"))
    with pytest.raises(Exception, match="classes"):
        EV.confusion_counts(df, "t", "p")


def test_psi_classes(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.25,), (0.2501,)], "v double")
    got = [r[0] for r in df.select(D.classify_psi(F.col("v"))).collect()]
    assert got == ["No change", "Moderate shift", "Moderate shift", "Significant shift"]


def test_accuracy_alert_rules(spark):
    df = spark.createDataFrame([(0.59,), (0.6,), (0.75,), (None,)], "accuracy double")
    rows = [tuple(r) for r in M.accuracy_alerts(df).collect()]
    assert rows == [("METRICS", "CRITICAL", M.MSG_ACCURACY_CRITICAL, '{"accuracy":0.590000}'),
                    ("METRICS", "WARNING", M.MSG_ACCURACY_WARNING, '{"accuracy":0.600000}')]


def test_star_rule(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (3.0,), (3.5,)], "s double")
    assert [r[0] for r in df.select(L.stars_to_sentiment(F.col("s"))).collect()] == [
        "negative", "positive", "neutral", "positive"]


def test_health_golden(spark):
    df = spark.createDataFrame([(1.0, 0.88, True, False, False, False)],
                               "off double, on double, covariate_drift boolean, label_drift boolean, "
                               "concept_drift boolean, domain_shift boolean")
    base = EV.health(F.col("off"), F.col("on"))
    _, score, status, advice = M.drift_adjusted_health(base)
    r = df.select(score.alias("s"), status.alias("st"), advice.alias("a")).first()
    assert (r["s"], r["st"], r["a"]) == (0.8, "HEALTHY", "System stable")


def test_drift_alerts_golden(spark):
    texts = D.sides(spark.createDataFrame([("x" * k,) for k in range(60)], "text string"),
                    spark.createDataFrame([("x" * (k + 40),) for k in range(60)], "text string"))
    lab = spark.createDataFrame([("a",), ("b",)], "label string")
    full = D.full_drift(texts, lab, lab, None)
    done = spark.createDataFrame([("retrained", 7)], "status string, samples long")
    rows = M.drift_alerts(full).unionByName(M.retrain_alert(done)).collect()
    assert [(r.type, r.severity, r.message) for r in rows] == [
        ("DRIFT", "WARNING", "Covariate drift detected"), ("RETRAIN", "INFO", "Model retrained successfully")]
    import json
    assert json.loads(rows[0].meta)["drift_detected"] is True and json.loads(rows[1].meta)["samples"] == 7
    assert D.drift_flags(full).first()["retrain_required"]


def test_raw_length_psi_and_ks(spark):
    from textpulse.sources.tables import production_text, reference_text
    sf = "/root/testdata/sf0.01"
    ref = reference_text(spark, sf).select(F.lit("char_length").alias("feature"),
                                           F.length("text").cast("double").alias("value"))
    prod = production_text(spark, sf).select(F.lit("char_length").alias("feature"),
                                             F.length("text").cast("double").alias("value"))
    psi = D.psi_by_feature(ref, prod).first()
    assert math.isclose(psi["psi"], 0.095923, abs_tol=1e-6)
    ks = D.text_length_drift(D.sides(reference_text(spark, sf).select("text"),
                                     production_text(spark, sf).select("text"))).first()
    assert math.isclose(ks["ks_statistic"], 0.0589134126, rel_tol=1e-8)
