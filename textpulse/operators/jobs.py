"""Swappable parts of a text job.

A loader turns a path into ``(id, text, label)`` rows, a cleaner a text column
into another, a model fits a ``PipelineModel``, a predictor applies one. Each is
looked up by name; ``register`` adds one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.functions.text import clean_text, compute_once
from textpulse.operators import model as MD
from textpulse.sources import sinks, tables

PARTS: dict[str, dict[str, Any]] = {"loader": {}, "cleaner": {}, "model": {}, "predictor": {}}


def register(kind: str, name: str, part: Any) -> Any:
    """Add a part; a name is taken once."""
    if name in PARTS[kind]:
        raise ValueError(f"there is a {kind} named {name} already")
    PARTS[kind][name] = part
    return part


def part(kind: str, name: str) -> Any:
    if name not in PARTS[kind]:
        raise KeyError(f"no {kind} named {name}; there are {', '.join(sorted(PARTS[kind]))}")
    return PARTS[kind][name]


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    return tables.reviews(spark, path).select(F.col("doc_id").alias("id"), "text", F.col("sentiment").alias("label"))


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("text").alias("id"), "text", F.col("sentiment").alias("label"))


register("loader", "reviews", _reviews)
register("loader", "csv", lambda spark, path: _with_id(sinks.read_review_csv(spark, path)))
register("loader", "star_json", lambda spark, path: _with_id(sinks.read_star_reviews(spark, path)[0]))
register("cleaner", "full", clean_text)
register("cleaner", "keep_case", lambda text: clean_text(text, lowercase=False, remove_special=False))
register("cleaner", "none", lambda text: F.coalesce(F.col(text), F.lit("")))
register("model", "baseline", MD.TextModel())
register("model", "pruned", MD.TextModel(max_features=MD.TF.PRUNED_MAX_FEATURES, stop_words=(), balanced=False))
register("model", "retrain", MD.RETRAIN_MODEL)
register("predictor", "records", MD.predict)


@dataclass(frozen=True)
class TextJob:
    """Names of the parts of one job."""

    loader: str = "reviews"
    cleaner: str = "full"
    model: str = "baseline"
    predictor: str = "records"

    def rows(self, spark: SparkSession, path: str) -> DataFrame:
        """Loaded and cleaned ``(id, text, label)``; empty texts are dropped."""
        clean: Callable[[str], Column] = part("cleaner", self.cleaner)
        df = part("loader", self.loader)(spark, path)
        return df.select("id", "label", compute_once(clean("text")).alias("text")).where(F.length("text") > 0)

    def fit(self, train: DataFrame) -> PipelineModel:
        return part("model", self.model).fit(train, "text", "label")

    def predict(self, fitted: PipelineModel, rows: DataFrame) -> DataFrame:
        return part("predictor", self.predictor)(fitted, rows, ["id"])
