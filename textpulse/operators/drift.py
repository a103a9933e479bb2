"""Drift detection: PSI per feature (G1-G7), two-sample KS (G8, G9), label
drift (G10), concept drift (G11), domain shift (G12) and the combined result
(G13).

Everything is aggregated before anything is ordered: the rows become value
counts with map-side partial aggregation, so the ordered work (quantiles,
cumulative distributions) runs on distinct values, range-partitioned by
``ordered.running_total``. Joins against edges (one row a feature) are left to
Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach

from textpulse.functions import stats
from textpulse.functions.text import with_text_features
from textpulse.operators.ordered import order_statistics, running_total
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
NO_CHANGE_THRESHOLD = 0.1
MODERATE_SHIFT_THRESHOLD = 0.25
PSI_EPSILON = 1e-6
KS_ALPHA = 0.05
LABEL_SHIFT_THRESHOLD = 0.2
CONFIDENCE_GAP_THRESHOLD = 0.15
STATUS_NO_CHANGE = "No change"
STATUS_MODERATE = "Moderate shift"
STATUS_SIGNIFICANT = "Significant shift"
# ---------------------------------------------------------------------------

FEATURES = ("char_length", "word_count", "avg_word_length")


def classify_psi(psi: Column) -> Column:
    """Class of an (unrounded) PSI value."""
    return (F.when(psi < NO_CHANGE_THRESHOLD, F.lit(STATUS_NO_CHANGE))
             .when(psi <= MODERATE_SHIFT_THRESHOLD, F.lit(STATUS_MODERATE))
             .otherwise(F.lit(STATUS_SIGNIFICANT)))


def finite(value: Column) -> Column:
    """Not null, not NaN, not +-inf."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def feature_values(df: DataFrame, text_col: str, features: Sequence[str] = FEATURES,
                   keep: Sequence[str] = ()) -> DataFrame:
    """B21 + unpivot: ``(keep, feature, value)`` rows for the selected features."""
    wide = with_text_features(df.select(*keep, text_col), text_col)
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    return wide.selectExpr(*keep, f"stack({len(features)}, {pairs}) AS (feature, value)")


def value_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each finite value occurs, by side (``_side``: 0 reference, 1
    production), keys and feature: one aggregation over one scan of both sides,
    combined before its shuffle, saved because quantiles, buckets and totals all
    read it."""
    value = F.col("value").cast("double")
    return materialize(rows.where(finite(value)).groupBy("_side", *keys, "feature", value.alias("value"))
                       .agg(F.count(F.lit(1)).alias("cnt")))


def psi_by_feature(reference: DataFrame, production: DataFrame, buckets: int = 10,
                   epsilon: float = PSI_EPSILON, extra_keys: Sequence[str] = ()) -> DataFrame:
    """PSI of ``production`` against ``reference``, two frames of
    ``(feature, value)`` rows; ``production`` may carry extra key columns (e.g. a
    time window) and then gets one PSI per key and feature, each against the same
    reference breakpoints."""
    types = dict(production.dtypes)
    ref = reference.select(F.lit(0).alias("_side"), *[F.lit(None).cast(types[k]).alias(k) for k in extra_keys],
                           "feature", "value")
    prod = production.select(F.lit(1).alias("_side"), *extra_keys, "feature", "value")
    return psi_from_counts(value_counts(ref.unionByName(prod), extra_keys), buckets, epsilon, extra_keys)


def psi_from_counts(vc: DataFrame, buckets: int = 10, epsilon: float = PSI_EPSILON,
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    """G1-G6 on ``value_counts``:
    ``(*extra_keys, feature, psi, status, reference_rows, production_rows)``. A
    feature without a finite value on either side has no row (G5; see
    ``psi_report_status``)."""
    keys = list(extra_keys)
    ref_vc = vc.where(F.col("_side") == 0).select("feature", "value", "cnt")
    prod_vc = vc.where(F.col("_side") == 1).select(*keys, "feature", "value", "cnt")
    edges = materialize(reference_edges(ref_vc, buckets))  # one row a feature

    def bucketize(counts: DataFrame, k: Sequence[str]) -> DataFrame:
        j = counts.join(edges.select("feature", "inner"), "feature")
        b = F.size(F.filter("inner", lambda e: F.col("value") >= e))
        return j.groupBy(*k, "feature", b.alias("bucket")).agg(F.sum("cnt").alias("cnt"))

    ref_b = bucketize(ref_vc, [])
    prod_b = bucketize(prod_vc, keys)
    prod_n = prod_vc.groupBy(*keys, "feature").agg(F.sum("cnt").alias("m"))

    grid = (prod_n.join(edges.select("feature", "n", "bins"), "feature")
            .select(*keys, "feature", "n", "m",
                    F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bucket")))
    shares = (grid.join(ref_b.withColumnRenamed("cnt", "e_cnt"), ["feature", "bucket"], "left")
                  .join(prod_b.withColumnRenamed("cnt", "a_cnt"), [*keys, "feature", "bucket"], "left"))
    e = F.coalesce(F.col("e_cnt"), F.lit(0)) / F.col("n")
    a = F.coalesce(F.col("a_cnt"), F.lit(0)) / F.col("m")
    e = F.when(e == 0, F.lit(epsilon)).otherwise(e)
    a = F.when(a == 0, F.lit(epsilon)).otherwise(a)
    shares = shares.select(*keys, "feature", "n", "m", ((a - e) * F.log(a / e)).alias("term"))
    psi = shares.groupBy(*keys, "feature").agg(
        F.sum("term").alias("psi_raw"), F.first("n").alias("reference_rows"),
        F.first("m").alias("production_rows"))
    return psi.select(*keys, "feature", F.round("psi_raw", 6).alias("psi"),
                      classify_psi(F.col("psi_raw")).alias("status"),
                      F.col("reference_rows").cast("bigint").alias("reference_rows"),
                      F.col("production_rows").cast("bigint").alias("production_rows"))


def reference_edges(ref_vc: DataFrame, buckets: int = 10) -> DataFrame:
    """G1-G3 on reference value counts ``(feature, value, cnt)``: per feature
    ``(feature, n, bins, inner)`` with the interior bin edges (outer edges are
    -inf/+inf)."""
    ref_stats = ref_vc.groupBy("feature").agg(
        F.sum("cnt").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))

    # G1: linear-interpolated quantiles at i/buckets, i = 0..buckets
    pos = (F.col("n") - 1) * F.col("i") / F.lit(buckets)
    targets = (ref_stats
               .select("feature", "n", F.explode(F.sequence(F.lit(0), F.lit(buckets))).alias("i"))
               .select("feature", "i", pos.alias("pos"))
               .select("feature", "i", "pos",
                       F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
               .dropDuplicates(["feature", "i", "rank"]))
    stats_at = order_statistics(ref_vc, ["feature"], "value", "cnt", targets)
    q = (stats_at.groupBy("feature", "i", "pos")
         .agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    q = q.select("feature", F.round(
        F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos")), 9).alias("edge"))
    edges = q.groupBy("feature").agg(F.array_sort(F.collect_set("edge")).alias("qedges"))

    # Equal-width fallback when <= 2 distinct breakpoints
    edges = edges.join(ref_stats, "feature")
    vmax = F.when(F.col("vmax") == F.col("vmin"), F.col("vmin") + 1.0).otherwise(F.col("vmax"))
    step = (vmax - F.col("vmin")) / F.lit(buckets)
    linear = F.transform(F.sequence(F.lit(0), F.lit(buckets)),
                         lambda i: F.round(F.col("vmin") + i * step, 9))
    all_edges = F.when(F.size("qedges") <= 2, linear).otherwise(F.col("qedges"))
    edges = edges.select("feature", "n", all_edges.alias("edges"))
    # Outer edges become -inf/+inf, so bins = size - 1, interior = edges[1..size-2]
    return edges.select("feature", "n", (F.size("edges") - 1).alias("bins"),
                         F.slice("edges", 2, F.size("edges") - 2).alias("inner"))



def overall_psi_status(per_feature: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst status over the features (per key)."""
    sev = (F.when(F.col("status") == STATUS_SIGNIFICANT, 2)
            .when(F.col("status") == STATUS_MODERATE, 1).otherwise(0))
    worst = per_feature.groupBy(*keys).agg(F.max(sev).alias("sev"))
    return worst.select(*keys, F.when(F.col("sev") == 2, STATUS_SIGNIFICANT)
                        .when(F.col("sev") == 1, STATUS_MODERATE)
                        .otherwise(STATUS_NO_CHANGE).alias("status"))


def ks_statistic(rows: DataFrame) -> DataFrame:
    """One row ``(n1, n2, ks_statistic)`` of the two-sample KS statistic of
    ``(_side, value)`` rows (0: first sample, 1: second); null where a sample is
    empty.

    Both samples become value counts in one pass; the empirical CDFs are compared
    at every distinct value through running totals."""
    counts = rows.groupBy("value").agg(*[F.count(F.when(F.col("_side") == k, 1)).alias(c)
                                         for k, c in ((0, "ca"), (1, "cb"))])
    counts = materialize(counts)
    n = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(k) for c, k in (("ca", "n1"), ("cb", "n2"))])
    cum = attach(running_total(counts, [], "value", ["ca", "cb"]), n)
    gap = F.abs(F.try_divide(F.col("ca_cum"), F.col("n1")) - F.try_divide(F.col("cb_cum"), F.col("n2")))
    return attach(cum.agg(F.max(gap).alias("ks_statistic")), n).select("n1", "n2", "ks_statistic")


def text_length_drift(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """G8 + G9 on character length of ``(_side, text)`` rows:
    ``(n1, n2, ks_statistic, p_value, drift_detected)``. Without rows on either
    side there is nothing to compare: null statistic and p-value, no drift."""
    ks = ks_statistic(rows.select("_side", F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("value")))
    p = stats.ks_pvalue(F.col("ks_statistic"), F.col("n1"), F.col("n2"))
    return ks.select("n1", "n2", "ks_statistic", p.alias("p_value")) \
             .withColumn("drift_detected", F.coalesce(F.col("p_value") < KS_ALPHA, F.lit(False)))


def sides(reference: DataFrame, production: DataFrame) -> DataFrame:
    """Two frames with the same columns as one, with ``_side`` 0 and 1."""
    return reference.withColumn("_side", F.lit(0)).unionByName(production.withColumn("_side", F.lit(1)))


def label_drift(reference: DataFrame, production: DataFrame, label_col: str = "label") -> DataFrame:
    """L1 distance between class shares, nulls excluded; full outer join
    over the union of labels. One row ``(distribution_shift, drift_detected)``."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        c = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("lbl")) \
              .agg(F.count(F.lit(1)).alias("c"))
        tot = c.agg(F.sum("c").alias("t"))
        return attach(c, tot).select("lbl", (F.col("c") / F.col("t")).alias(name))
    j = shares(reference, "pa").join(shares(production, "pb"), "lbl", "full_outer")
    shift = F.sum(F.abs(F.coalesce(F.col("pa"), F.lit(0.0)) - F.coalesce(F.col("pb"), F.lit(0.0))))
    return j.agg(F.coalesce(shift, F.lit(0.0)).alias("distribution_shift")) \
            .withColumn("drift_detected", F.col("distribution_shift") > LABEL_SHIFT_THRESHOLD)


def concept_drift(scored: DataFrame, pred_col: str = "prediction", label_col: str = "true_label",
                  conf_col: str = "confidence") -> DataFrame:
    """Mean confidence of wrong minus mean confidence of correct
    predictions (empty side -> 0). One row."""
    lab = scored.where(F.col(label_col).isNotNull())
    ok = F.col(pred_col) == F.col(label_col)
    res = lab.agg(
        F.coalesce(F.avg(F.when(ok, F.col(conf_col))), F.lit(0.0)).alias("avg_conf_correct"),
        F.coalesce(F.avg(F.when(~ok, F.col(conf_col))), F.lit(0.0)).alias("avg_conf_wrong"))
    res = res.withColumn("confidence_gap", F.col("avg_conf_wrong") - F.col("avg_conf_correct"))
    return res.withColumn("drift_detected", F.col("confidence_gap") > CONFIDENCE_GAP_THRESHOLD)


def full_drift(texts: DataFrame, reference_labels: DataFrame, production_labels: DataFrame,
               scored: DataFrame | None, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Covariate (KS on length of ``(_side, text)`` rows), label, concept
    and domain results as one row of four structs. ``scored`` None means no
    model: concept drift is not detected and carries a note."""
    cov = text_length_drift(texts, text_col)
    lab = label_drift(reference_labels, production_labels, label_col)
    if scored is None:
        con = cov.select(*[F.lit(None).cast("double").alias(c) for c in
                           ("avg_conf_correct", "avg_conf_wrong", "confidence_gap")], F.lit(False).alias("drift_detected"))
        note = F.lit("model_not_loaded")
    else:
        con = concept_drift(scored)
        note = F.lit(None).cast("string")
    method = lambda name: F.lit(name).alias("method")
    row = cov.select(F.struct(method("covariate_text_length_ks"), "ks_statistic", "p_value", "drift_detected",
                              "n1", "n2").alias("covariate_drift"))
    row = attach(row, lab.select(F.struct(method("label_distribution_shift"), "distribution_shift",
                                          "drift_detected").alias("label_drift")))
    row = attach(row, con.select(F.struct(method("concept_confidence_mismatch"), "avg_conf_correct", "avg_conf_wrong",
                                          "confidence_gap", "drift_detected", note.alias("note"))
                                 .alias("concept_drift")))
    return row.withColumn("domain_shift", F.struct(
        method("domain_shift_detection"),
        (F.col("covariate_drift.drift_detected") & F.col("concept_drift.drift_detected")).alias("drift_detected")))


def drift_flags(full: DataFrame) -> DataFrame:
    """G12 + H4: the four flags of ``full_drift`` and whether to retrain
    (covariate or label drift)."""
    names = ("covariate_drift", "label_drift", "concept_drift", "domain_shift")
    flags = full.select(*[F.col(f"{c}.drift_detected").alias(c) for c in names])
    return flags.withColumn("retrain_required", F.col("covariate_drift") | F.col("label_drift"))


def psi_report_status(per_feature: DataFrame, vc: DataFrame, feature: str = FEATURES[0]) -> DataFrame:
    """One row ``(status, reference_rows, production_rows)``; rows are
    those of ``feature`` (one for each text). An empty side leaves nothing to
    compare: ``insufficient_data``, never an all-clear."""
    side = lambda k: F.coalesce(F.sum(F.when(F.col("_side") == k, F.col("cnt"))), F.lit(0)).cast("bigint")
    counts = vc.where(F.col("feature") == feature).agg(side(0).alias("reference_rows"), side(1).alias("production_rows"))
    worst = overall_psi_status(per_feature).agg(F.max("status").alias("status"))  # one row, also without features
    return attach(counts, worst).select(
        F.when((F.col("reference_rows") == 0) | (F.col("production_rows") == 0), F.lit("insufficient_data"))
         .otherwise(F.col("status")).alias("status"), "reference_rows", "production_rows")
