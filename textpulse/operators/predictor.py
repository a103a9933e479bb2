"""The fitted classifier as an Arrow function for SQL.

``portable`` takes what scoring needs out of a fitted pipeline: vocabulary, idf,
coefficients and settings, bounded by ``max_features``. It is broadcast; a worker
builds its scorer once and keeps it for later batches and tasks. Texts arrive in
Arrow batches; a batch's cells are computed as flat arrays.

Tokens are read by Python's Unicode tables, which may know letters of newer
Unicode versions than the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textpulse.functions.labels import NUMERIC_LABELS, STANDARD_CLASSES
from textpulse.operators import model as MD
from textpulse.operators import tfidf as TF

RECORD = "prediction string, confidence double, " + ", ".join(f"p_{c} double" for c in STANDARD_CLASSES)


def portable(model: PipelineModel, settings: MD.TextModel) -> dict:
    """What scoring needs, as plain values."""
    of = lambda kind: next(s for s in model.stages if isinstance(s, kind))
    lr = of(LogisticRegressionModel)
    return {
        "terms": list(of(CountVectorizerModel).vocabulary), "idf": of(ElementwiseProduct).getScalingVec().toArray(),
        "coefficients": lr.coefficientMatrix.toArray(), "intercepts": lr.interceptVector.toArray(),
        "classes": MD.classes(model), "ngram_max": settings.ngram_max,
        "stop_words": list(TF.stop_word_list() if settings.stop_words is None else settings.stop_words),
    }


class Scorer:
    """Scores batches of texts by a portable model."""

    def __init__(self, spec: dict):
        import regex
        self.index = {t: i for i, t in enumerate(spec["terms"])}
        self.idf, self.stop = np.asarray(spec["idf"]), frozenset(spec["stop_words"])
        self.coefficients, self.intercepts = np.asarray(spec["coefficients"]), np.asarray(spec["intercepts"])
        self.bigrams, self.token = spec["ngram_max"] > 1, regex.compile(TF.TOKEN_RE)
        self.names = [NUMERIC_LABELS.get(c, c.lower()) for c in spec["classes"]]

    def cells(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of every term of the vocabulary in every text, repeats
        included."""
        rows, columns, get = [], [], self.index.get
        for at, text in enumerate(texts):
            words = [w for w in self.token.findall((text or "").lower()) if w not in self.stop]
            found = [i for i in map(get, words) if i is not None]
            if self.bigrams:
                found += [i for i in map(get, map(" ".join, zip(words, words[1:]))) if i is not None]
            rows.append(np.full(len(found), at))
            columns.append(np.array(found, np.int64))
        return np.concatenate(rows or [[]]).astype(np.int64), np.concatenate(columns or [[]]).astype(np.int64)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One row a text, one column a class."""
        row, column = self.cells(texts)
        size = len(self.idf)
        cell, count = np.unique(row * size + column, return_counts=True)
        row, column = cell // size, cell % size
        weight = count * self.idf[column]
        norm = np.sqrt(np.bincount(row, weight ** 2, len(texts)))
        weight = weight / norm[row]
        margins = np.stack([np.bincount(row, weight * c[column], len(texts)) for c in self.coefficients], axis=1)
        margins = margins + self.intercepts
        if margins.shape[1] == 1:  # two classes, one margin
            p = 1 / (1 + np.exp(-margins[:, 0]))
            return np.stack([1 - p, p], axis=1)
        margins = np.exp(margins - margins.max(axis=1, keepdims=True))
        return margins / margins.sum(axis=1, keepdims=True)

    def records(self, texts: list[str | None]) -> pd.DataFrame:
        """The prediction records."""
        p = self.probabilities(texts)
        own = {name: k for k, name in enumerate(self.names)}  # of equal names the last counts
        return pd.DataFrame({
            "prediction": np.array(self.names, object)[p.argmax(axis=1)], "confidence": p.max(axis=1),
            **{f"p_{c}": p[:, own[c]] if c in own else np.zeros(len(texts)) for c in STANDARD_CLASSES}})


_scorers: dict[str, Scorer] = {}


def register(spark: SparkSession, name: str, model: PipelineModel, settings: MD.TextModel = MD.TextModel()):
    """Make ``name(text)`` known to SQL: the prediction record of a text."""
    sent, key = spark.sparkContext.broadcast(portable(model, settings)), uuid.uuid4().hex

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _scorers:  # once a worker process
            _scorers[key] = Scorer(sent.value)
        for texts in batches:
            yield _scorers[key].records([t if isinstance(t, str) else None for t in texts])

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return spark.udf.register(name, F.pandas_udf(score, RECORD))
