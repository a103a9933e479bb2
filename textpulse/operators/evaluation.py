"""Evaluation aggregates.

Everything starts from one shuffle: ``groupBy(y_true, y_pred).count()``; the
metrics are arithmetic on that (labels x labels) table, so the work is the
same for a thousand rows or a hundred billion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach

from textpulse.operators.ordered import order_statistics
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
HEALTH_ACCURACY_FLOOR = 0.7
OFFLINE_PENALTY = 0.4
ONLINE_PENALTY = 0.3
STATUS_CRITICAL_BELOW = 0.4
STATUS_WARNING_BELOW = 0.7
DEFAULT_WINDOW = 50
MAX_CLASSES = 1000
# ---------------------------------------------------------------------------


def confusion_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """F3 long form ``(y_true, y_pred, n)`` over the full label cross product
    (labels = union of true and predicted), zero cells included."""
    pairs = df.where(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull()).groupBy(
        F.col(true_col).cast("string").alias("y_true"), F.col(pred_col).cast("string").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    labels = pairs.select(F.col("y_true").alias("label")).union(pairs.select("y_pred")).distinct()
    # every (true, predicted) label pair; the label set is the class list, and a
    # column with more values than MAX_CLASSES is no class column
    many = F.raise_error(F.lit(f"more than {MAX_CLASSES} classes"))
    labels = labels.limit(MAX_CLASSES + 1)
    ls = labels.agg(F.array_sort(F.collect_set("label")).alias("ls"))
    ls = ls.select(F.when(F.size("ls") > MAX_CLASSES, many.cast("array<string>")).otherwise(F.col("ls")).alias("ls"))
    grid = ls.select(F.explode("ls").alias("y_true"), "ls").select("y_true", F.explode("ls").alias("y_pred"))
    conf = grid.join(pairs, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    # labels x labels rows, read by several metric branches: written once
    return materialize(conf)


def per_class(conf: DataFrame) -> DataFrame:
    """F4 rows per label: precision, recall, f1, support (zero_division = 0)."""
    tp = conf.where(F.col("y_true") == F.col("y_pred")).select(F.col("y_true").alias("label"),
                                                               F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = tp.join(sup, "label").join(pred, "label")
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    j = j.select("label", p.alias("precision"), r.alias("recall"),
                 F.col("support").cast("bigint").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return j.select("label", "precision", "recall", f1.alias("f1_score"), "support")


def summary(conf: DataFrame) -> DataFrame:
    """F1, F2: accuracy and support-weighted precision / recall / F1."""
    pc = per_class(conf)
    acc = conf.agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
                    / F.sum("n")).alias("accuracy"), F.sum("n").cast("bigint").alias("samples"))
    w = pc.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                 for m in ("precision", "recall", "f1_score")])
    return attach(acc, w)


def report(conf: DataFrame) -> DataFrame:
    """per-class rows plus 'macro avg' and 'weighted avg' rows."""
    pc = per_class(conf)
    macro = pc.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in
                   ("precision", "recall", "f1_score")], F.sum("support").cast("bigint").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
                        for m in ("precision", "recall", "f1_score")],
                      F.sum("support").cast("bigint").alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def last_n_labelled(log: DataFrame, n: int = DEFAULT_WINDOW, key_col: str | None = None) -> DataFrame:
    """F6/F7 window: the last ``n`` labelled records by (ts, id), globally
    (top-k) or per key (row_number <= n; Spark's group-limit pushdown keeps at
    most n rows per key and partition before the shuffle, so a hot key is
    cheap)."""
    lab = log.where(F.col("true_label").isNotNull())
    if key_col is None:
        return lab.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    w = Window.partitionBy(key_col).orderBy(F.desc("ts"), F.desc("id"))
    return lab.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def window_accuracy(window: DataFrame, keys: list[str] | None = None) -> DataFrame:
    k = keys or []
    ok = F.when(F.col("prediction") == F.col("true_label"), 1).otherwise(0)
    return window.groupBy(*k).agg(F.count(F.lit(1)).cast("bigint").alias("total_samples"),
                                  F.sum(ok).cast("bigint").alias("correct"))


NO_LABELS = "no labelled data"


def _message(n: F.Column) -> F.Column:
    return F.when(n == 0, F.lit(NO_LABELS))


def offline(log: DataFrame) -> DataFrame:
    """``(accuracy, total_samples, type, message)`` over the labelled records;
    without any the accuracy is null and the message says so."""
    labelled = log.where(F.col("true_label").isNotNull())
    ok = F.when(F.col("prediction") == F.col("true_label"), 1.0).otherwise(0.0)
    n = F.count(F.lit(1)).cast("bigint")
    return labelled.agg(F.round(F.avg(ok), 4).alias("accuracy"), n.alias("total_samples")).select(
        "accuracy", "total_samples", F.lit("offline").alias("type"), _message(F.col("total_samples")).alias("message"))


def online(log: DataFrame, n: int = DEFAULT_WINDOW) -> DataFrame:
    """the same over the last ``n`` labelled records."""
    w = window_accuracy(last_n_labelled(log, n))
    acc = F.try_divide(F.col("correct"), F.col("total_samples"))
    return w.select("total_samples", F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"),
                    F.round(acc, 4).alias("accuracy"), F.round(acc, 3).alias("window_accuracy"),
                    F.lit(n).alias("window_size"), _message(F.col("total_samples")).alias("message"))


def health(offline_acc, online_acc):
    """F8: 1 - 0.4 [offline < 0.7] - 0.3 [online < 0.7, when known], floor 0."""
    score = (F.lit(1.0)
             - F.when(offline_acc < HEALTH_ACCURACY_FLOOR, OFFLINE_PENALTY).otherwise(0.0)
             - F.when(online_acc.isNotNull() & (online_acc < HEALTH_ACCURACY_FLOOR), ONLINE_PENALTY)
              .otherwise(0.0))
    return F.greatest(score, F.lit(0.0))


def health_status(score):
    return (F.when(score < STATUS_CRITICAL_BELOW, "CRITICAL")
             .when(score < STATUS_WARNING_BELOW, "WARNING").otherwise("HEALTHY"))


def latency_stats(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """per group mean, nearest-rank p50 / p95 (index round_half_even(p (n-1))),
    throughput = rows / (sum of latency in seconds).

    The ranks are read from value counts with the block-split running totals,
    so a hot group never sorts its raw rows in one task."""
    vc = df.groupBy(group_col, F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    g = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"),
                                  F.sum(value_col).alias("total"))
    targets = g.select(group_col, F.explode(F.array(
        F.struct(F.lit(50).alias("pct"), F.bround(F.lit(0.5) * (F.col("n") - 1), 0).cast("bigint").alias("rank")),
        F.struct(F.lit(95).alias("pct"), F.bround(F.lit(0.95) * (F.col("n") - 1), 0).cast("bigint").alias("rank"))
    )).alias("t")).select(group_col, "t.pct", "t.rank")
    at = order_statistics(vc, [group_col], "v", "c", targets)
    wide = at.groupBy(group_col).agg(F.max(F.when(F.col("pct") == 50, F.col("value"))).alias("p50"),
                                     F.max(F.when(F.col("pct") == 95, F.col("value"))).alias("p95"))
    return g.join(wide, group_col).select(
        group_col, F.col("n").cast("bigint").alias("samples"), F.round("mean", 3).alias("mean_latency_ms"),
        F.round("p50", 3).alias("p50_latency_ms"), F.round("p95", 3).alias("p95_latency_ms"),
        F.round(F.when(F.col("total") > 0, F.col("n") / (F.col("total") / 1000.0)).otherwise(0.0), 2)
        .alias("throughput_rps"))


def compare_variants(stats: DataFrame, variant_col: str, baseline: str = "baseline") -> DataFrame:
    """% improvement of each variant's mean and p95 latency, peak memory and
    model size against the 'baseline' row (else the first variant by name); 0
    when the baseline is 0. Adds the gains to the columns of ``stats``."""
    gains = {"mean_latency_ms": "latency_improvement_pct", "p95_latency_ms": "p95_improvement_pct",
             "peak_memory_mb": "memory_improvement_pct", "model_size_mb": "size_reduction_pct"}
    gains = {c: g for c, g in gains.items() if c in stats.columns}
    first = stats.orderBy(F.when(F.col(variant_col) == baseline, 0).otherwise(1), variant_col).limit(1)
    b = first.select(*[F.col(c).alias(f"_b_{c}") for c in gains])

    def gain(c):
        x, base = F.col(c), F.col(f"_b_{c}")
        return F.when(base == 0, F.lit(0.0)).otherwise(F.round(100.0 * (1 - x / base), 2))
    return attach(stats, b).select(*stats.columns, *[gain(c).alias(g) for c, g in gains.items()])


# ---- fixed values: the report's headings ----------------------------------
MARKDOWN_COLUMNS = ("Variant", "Mean Latency (ms)", "P50 (ms)", "P95 (ms)", "Throughput (req/s)",
                    "Peak Memory (MB)", "Model Size (MB)", "Latency vs Baseline", "Memory vs Baseline")
# ---------------------------------------------------------------------------
MARKDOWN_HEADER = "\n".join("| " + " | ".join(row) + " |" for row in
                            (MARKDOWN_COLUMNS, ["---"] * len(MARKDOWN_COLUMNS)))
MARKDOWN_ROW = "| %s | %.3f | %.3f | %.3f | %.2f | %.3f | %.3f | %.2f%% | %.2f%% |"


def markdown_table(comparison: DataFrame, variant_col: str) -> DataFrame:
    """the comparison, gains included, as one markdown table string."""
    numbers = ("mean_latency_ms", "p50_latency_ms", "p95_latency_ms", "throughput_rps", "peak_memory_mb",
               "model_size_mb", "latency_improvement_pct", "memory_improvement_pct")
    line = F.format_string(MARKDOWN_ROW, F.col(variant_col), *[F.col(c) for c in numbers])
    rows = comparison.select(F.col(variant_col).alias("_v"), line.alias("line"))
    body = rows.agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY _v)").alias("body"))
    return body.select(F.concat_ws("\n", F.lit(MARKDOWN_HEADER), F.col("body")).alias("markdown"))
