"""Model fitting and scoring with ``pyspark.ml``.

A fitted model is one ``PipelineModel``: the featurizer of ``tfidf`` (terms,
counts over the fitted vocabulary, smooth IDF, L2 norm), the label index and a
logistic regression, binary or multinomial by the number of classes. Fitting
runs L-BFGS with distributed ``treeAggregate`` passes over saved feature rows;
the driver only ever holds the vocabulary (``max_features`` strings) and the
coefficients.

Objective mapping: C * sum_i w_i loss_i + |b|^2 / 2 (C = 1, balanced w_i)
divided by C * sum(w) is Spark's sum(w_i loss_i) / sum(w) + regParam / 2 |b|^2,
so regParam = 1 / (C * sum(w)); standardization off, no elastic net.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.labels import expand_probabilities, normalize_label
from textpulse.operators import scoring as SC
from textpulse.operators import tfidf as TF
from textpulse.operators.evaluation import confusion_counts, summary
from textpulse.operators.sampling import DEFAULT_SEED, hash_key
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
DEFAULT_C = 1.0
DEFAULT_MAX_ITER = 1000
DEFAULT_TOL = 1e-4
# ---------------------------------------------------------------------------
LABEL_INDEX = "_label"


@dataclass(frozen=True)
class TextModel:
    """Settings of the text classifier; ``fit`` gives a ``PipelineModel``. Any
    object with ``fit(train, text_col, label_col)`` can take its place (J3)."""

    max_features: int = TF.DEFAULT_MAX_FEATURES
    c: float = DEFAULT_C
    max_iter: int = DEFAULT_MAX_ITER
    tol: float = DEFAULT_TOL
    ngram_max: int = 2
    stop_words: tuple[str, ...] | None = None
    balanced: bool = True

    def fit(self, train: DataFrame, text_col: str, label_col: str) -> PipelineModel:
        """Vocabulary + IDF from ``train``, then the (weighted) LR. Labels
        may be numbers or strings; classes are their sorted texts."""
        train = train.where(F.col(label_col).isNotNull()).withColumn("_class", F.col(label_col).cast("string"))
        # the texts are read once: words serve for the vocabulary and the features
        args = {"stop_words": self.stop_words}
        words = materialize(TF.words_of(train, text_col, keep=["_class"], **args))
        indexer = StringIndexer(inputCol="_class", outputCol=LABEL_INDEX, stringOrderType="alphabetAsc").fit(words)
        if len(indexer.labels) < 2:
            raise ValueError("a classifier needs at least two classes to learn from")
        vocab = TF.vocabulary_of(words, self.max_features, ngram_max=self.ngram_max)
        features, features_of_words = TF.featurizers(vocab, text_col, self.ngram_max, **args)
        rows = words.select("words", "_class")
        if self.balanced:
            rows = rows.join(materialize(SC.balanced_weights(rows, "_class").select("_class", "weight")), "_class")
        else:
            rows = rows.withColumn("weight", F.lit(1.0))
        # saved: every L-BFGS pass reads these rows, also after a lost executor
        rows = materialize(indexer.transform(features_of_words.transform(rows)).select("features", LABEL_INDEX, "weight"))
        total = rows.agg(F.sum("weight")).first()[0]
        lr = LogisticRegression(featuresCol="features", labelCol=LABEL_INDEX, weightCol="weight",
                                regParam=1.0 / (self.c * total), elasticNetParam=0.0, standardization=False,
                                maxIter=self.max_iter, tol=self.tol, fitIntercept=True, family="auto")
        fitted = lr.fit(rows)
        model = PipelineModel(stages=[*features.stages, indexer, fitted])
        model.iterations = fitted.summary.totalIterations
        # the summary holds the session and the training rows, and would travel with every scoring task
        fitted._java_obj.setSummary(train.sparkSession.sparkContext._jvm.scala.Option.empty())
        return model


# the retrain variant (E12): unigrams of raw text, every word, no class weights
RETRAIN_MODEL = TextModel(max_features=TF.RETRAIN_MAX_FEATURES, ngram_max=1, stop_words=(), balanced=False)


def classes(model: PipelineModel) -> list[str]:
    """The model's classes, in the order of its probabilities."""
    return next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels


def predict(model: PipelineModel, docs: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep..., prediction, confidence, p_negative,
    p_neutral, p_positive)``; works on batch and streaming frames."""
    names = F.array(*[F.lit(c) for c in classes(model)])
    out = model.transform(docs)
    return out.select(*keep, *expand_probabilities(names, vector_to_array(F.col("probability"))))


def save(model: PipelineModel, path: str) -> None:
    """E8."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def nested_samples(train: DataFrame, id_col: str, sizes: list[int], seed: int = DEFAULT_SEED) -> DataFrame:
    """``(id, rank)`` of the first max(sizes) rows in seeded hash order, ranked
    once: the size-n sample is rank <= n. Bounded by the largest size."""
    first = (train.select(id_col).withColumn("_key", hash_key(id_col, seed))
             .orderBy("_key", id_col).limit(max(sizes)))
    rank = F.row_number().over(Window.orderBy("_key", id_col))
    return first.select(id_col, rank.alias("rank"))


def learning_curve(train: DataFrame, test: DataFrame, id_col: str, text_col: str, label_col: str,
                   sizes: list[int], model: TextModel = TextModel()) -> list[dict]:
    """One fit per nested sample, evaluated on ``test``; ``sample_size`` is
    the rows there were to fit on, ``requested`` the size asked for. What a fit
    can't learn from (one class, no term) is a failed run, not an error."""
    ranks = nested_samples(train, id_col, sizes)
    ranked = materialize(train.select(id_col, text_col, label_col).join(ranks, id_col))
    runs = []
    for size in sizes:
        part = ranked.where(F.col("rank") <= size)
        run = {"requested": size, "sample_size": part.count(), "status": "ok", "accuracy": None, "f1_score": None,
               "error": None}
        try:
            scored = predict(model.fit(part, text_col, label_col), test, [label_col])
            scored = scored.select(normalize_label(F.col(label_col)).alias("t"), F.col("prediction").alias("p"))
            s = summary(confusion_counts(scored, "t", "p")).first()
            run |= {"accuracy": float(s["accuracy"]), "f1_score": float(s["f1_score"])}
        except (ValueError, PySparkException) as ex:
            run |= {"status": "failed", "error": str(ex)[:200]}
        runs.append(run)
    return runs


def retrain(docs: DataFrame, text_col: str, label_col: str, path: str, required: bool,
            model: TextModel = RETRAIN_MODEL) -> dict:
    """Refit on the raw training texts and save the model at ``path`` if a
    retrain is required; ``(status, samples)`` says what was done."""
    if not required:
        return {"status": "skipped", "samples": 0}
    save(model.fit(docs, text_col, label_col), path)
    return {"status": "retrained", "samples": docs.where(F.col(label_col).isNotNull()).count()}
