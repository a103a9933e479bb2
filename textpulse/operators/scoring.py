"""Relational linear scoring.

A linear text model is a weight per term plus an intercept, so scoring a
table is a join of its TF-IDF cells with the weight table (max_features rows),
a sum per document and a sigmoid. A document's cells lie together, so the sum is
all but done before the shuffle: one number per document moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach


def balanced_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``n / (k * n_c)`` per class (k = number of classes)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    t = c.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return attach(c, t).select(
        label_col, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def log_count_ratio_weights(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fixed, data-derived weight rule (so scoring is checkable by SQL) from a
    vocabulary with class counts (``tfidf.vocabulary`` with a label):
    coef(t) = ln((pos_df + 1) / (n_pos + 2)) - ln((neg_df + 1) / (n_neg + 2)),
    intercept = ln(n_pos / n_neg), for labels 1 (positive) / 0 (negative)."""
    coef = (F.log((F.col("pos_df") + 1.0) / (F.col("n_pos") + 2.0))
            - F.log((F.col("neg_df") + 1.0) / (F.col("n_neg") + 2.0)))
    intercept = vocab.agg(F.log(F.max("n_pos") / F.max("n_neg")).alias("intercept"))
    return vocab.select("term", coef.alias("coef")), intercept


def linear_scores(docs: DataFrame, cells: DataFrame, weights: DataFrame, intercept: DataFrame,
                  id_col: str) -> DataFrame:
    """``score = intercept + sum(weight * coef)``, ``probability = sigmoid``,
    ``prediction = probability >= 0.5``; documents without known terms score
    the intercept."""
    s = cells.join(weights, "term").groupBy(id_col).agg(
        F.sum(F.col("weight") * F.col("coef")).alias("_s"))
    z = F.coalesce(F.col("_s"), F.lit(0.0)) + F.col("intercept")
    out = attach(docs.join(s, id_col, "left"), intercept).withColumn("score", z)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score")))
    return out.select(*docs.columns, "score", p.alias("probability"),
                      F.when(p >= 0.5, 1).otherwise(0).alias("prediction"))
