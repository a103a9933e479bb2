"""The text classifier as a ``pyspark.ml`` Estimator and Model.

``TextClassifier`` fits what ``model.TextModel`` fits, with Params and ML
persistence, so it works in a Pipeline, in tuning and with ML's evaluators. The
prediction is the class index (classes in the order of their names);
``predictedLabel`` names it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasTol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.functions.labels import expand_probabilities
from textpulse.operators import model as MD
from textpulse.operators import tfidf as TF


class _TextParams(HasLabelCol, HasPredictionCol, HasProbabilityCol, HasMaxIter, HasTol):
    textCol = Param(Params._dummy(), "textCol", "text column", TypeConverters.toString)
    predictedLabelCol = Param(Params._dummy(), "predictedLabelCol", "name of the predicted class", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of the vocabulary", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "longest n-gram: 1 or 2", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "inverse strength of the penalty", TypeConverters.toFloat)
    balanced = Param(Params._dummy(), "balanced", "weigh classes by their size", TypeConverters.toBoolean)
    stopWords = Param(Params._dummy(), "stopWords", "words left out (unset: the default list)", TypeConverters.toListString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(textCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                         predictedLabelCol="predictedLabel", maxFeatures=TF.DEFAULT_MAX_FEATURES, ngramMax=2,
                         c=MD.DEFAULT_C, maxIter=MD.DEFAULT_MAX_ITER, tol=MD.DEFAULT_TOL, balanced=True)

    def settings(self) -> MD.TextModel:
        """The parameters as the plain settings."""
        get = self.getOrDefault
        stop_words = tuple(get("stopWords")) if self.isDefined("stopWords") else None
        return MD.TextModel(max_features=get("maxFeatures"), c=get("c"), max_iter=get("maxIter"), tol=get("tol"),
                            ngram_max=get("ngramMax"), stop_words=stop_words, balanced=get("balanced"))


class TextClassifier(Estimator, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, textCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 predictedLabelCol="predictedLabel", maxFeatures=TF.DEFAULT_MAX_FEATURES, ngramMax=2, c=MD.DEFAULT_C,
                 maxIter=MD.DEFAULT_MAX_ITER, tol=MD.DEFAULT_TOL, balanced=True, stopWords=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TextClassifierModel:
        fitted = self.settings().fit(dataset, self.getOrDefault("textCol"), self.getLabelCol())
        return self._copyValues(TextClassifierModel(fitted))


class TextClassifierModel(Model, _TextParams, MLWritable, MLReadable):
    """A fitted classifier; ``pipeline`` is the ``PipelineModel`` inside."""

    def __init__(self, pipeline: PipelineModel):
        super().__init__()
        self.pipeline = pipeline

    @property
    def classes(self) -> list[str]:
        return MD.classes(self.pipeline)

    def _columns(self) -> list[str]:
        return [self.getProbabilityCol(), self.getPredictionCol(), self.getOrDefault("predictedLabelCol")]

    def _scored(self, dataset: DataFrame) -> DataFrame:
        """The input as one struct, and the inner columns under their own names."""
        text = self.getOrDefault("textCol")
        return self.pipeline.transform(dataset.select(F.struct(*dataset.columns).alias("_row"), F.col(text)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        taken = set(self._columns()) & set(dataset.columns)
        if taken:
            raise ValueError(f"there are columns named {', '.join(sorted(taken))} already")
        names = F.array(*[F.lit(c) for c in self.classes])
        probability, prediction, label = self._columns()
        return self._scored(dataset).select(
            *[F.col("_row").getField(c).alias(c) for c in dataset.columns], F.col("probability").alias(probability),
            F.col("prediction").alias(prediction), F.element_at(names, F.col("prediction").cast("int") + 1).alias(label))

    def records(self, dataset: DataFrame, keep: list[str]) -> DataFrame:
        """The prediction record of each row, beside the columns ``keep``."""
        names = F.array(*[F.lit(c) for c in self.classes])
        return self._scored(dataset).select(*[F.col("_row").getField(c).alias(c) for c in keep], *expand_probabilities(
            names, vector_to_array(F.col("probability"))))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: TextClassifierModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.pipeline.write().save(f"{path}/pipeline")


class _ModelReader(MLReader):
    def load(self, path: str) -> TextClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextClassifierModel(PipelineModel.load(f"{path}/pipeline"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
