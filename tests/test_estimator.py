"""The classifier as Estimator and Model (J3) and as an Arrow function."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from textpulse.operators import model as MD
from textpulse.operators import predictor
from textpulse.operators.estimator import TextClassifier, TextClassifierModel

WORDS = {0: "awful dreadful boring bad", 1: "great lovely bright good"}


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(60):
        y = i % 2
        own, other = WORDS[y].split(), WORDS[1 - y].split()
        data.append((i, f"{own[i % 4]} film {own[(i // 4) % 4]} {other[i % 4] if i % 5 == 0 else 'scene'} number{i % 7}", y))
    return spark.createDataFrame(data, "id long, text string, label int").cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return TextClassifier(maxFeatures=40, maxIter=50).fit(rows)


def test_equals_the_plain_fit(rows, fitted):
    settings = MD.TextModel(max_features=40, max_iter=50)
    assert fitted.settings() == settings
    base = {r["id"]: r for r in MD.predict(settings.fit(rows, "text", "label"), rows, ["id"]).collect()}
    mine = {r["id"]: r for r in fitted.records(rows, ["id"]).collect()}
    assert base.keys() == mine.keys()
    for k, r in mine.items():
        assert r["prediction"] == base[k]["prediction"] and math.isclose(r["p_positive"], base[k]["p_positive"])


def test_transform_keeps_columns_and_names_the_class(rows, fitted):
    extra = rows.withColumn("_terms", F.lit(1)).withColumn("features", F.lit("x")).withColumn("_row", F.lit(2))
    out = fitted.transform(extra)
    assert out.columns == [*extra.columns, "probability", "prediction", "predictedLabel"]
    r = out.first()
    assert fitted.classes[int(r["prediction"])] == r["predictedLabel"] and r["_terms"] == 1
    with pytest.raises(ValueError, match="prediction"):
        fitted.transform(rows.withColumn("prediction", F.lit(1)))


def test_saved_and_loaded(rows, fitted, tmp_path):
    path = str(tmp_path / "model")
    fitted.write().save(path)
    again = TextClassifierModel.load(path)
    assert again.uid == fitted.uid and again.settings() == fitted.settings()
    same = lambda m: [(r["id"], r["prediction"], r["probability"]) for r in m.transform(rows).orderBy("id").collect()]
    assert same(again) == same(fitted)
    estimator = TextClassifier(maxFeatures=7, stopWords=["film"], textCol="t", balanced=False)
    estimator.write().save(str(tmp_path / "estimator"))
    loaded = TextClassifier.load(str(tmp_path / "estimator"))
    assert loaded.settings() == estimator.settings() and loaded.getOrDefault("textCol") == "t"
    assert loaded.settings().stop_words == ("film",)


def test_in_a_cross_validator(rows):
    estimator = TextClassifier(maxIter=20)
    grid = ParamGridBuilder().addGrid(estimator.maxFeatures, [1, 40]).build()
    evaluator = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
    found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=2, seed=1).fit(rows)
    assert found.avgMetrics[1] > max(found.avgMetrics[0], 0.8)
    assert found.bestModel.getOrDefault("maxFeatures") == 40
    in_pipeline = Pipeline(stages=[TextClassifier(maxFeatures=40, maxIter=20)]).fit(rows)
    assert evaluator.evaluate(in_pipeline.transform(rows)) > 0.9


@pytest.mark.parametrize("classes", [2, 3])
def test_sql_function_equals_the_transform(spark, rows, classes):
    train = rows if classes == 2 else rows.select(
        "id", "text", F.when(F.col("id") % 3 == 0, "Neutral").otherwise(F.col("label").cast("string")).alias("label"))
    for settings in (MD.TextModel(max_features=30, max_iter=30), MD.RETRAIN_MODEL):
        model = settings.fit(train, "text", "label")
        predictor.register(spark, "score_it", model, settings)
        texts = spark.createDataFrame(
            [(None,), ("",), ("nothing known",), ("GREAT Film film great film",), ("ünï Größe ÀÉ 漢字 great٣",), ("bad " * 5000,),
             ("_a b cc good-bad",)], "text string").unionByName(rows.select("text")).withColumn("id", F.monotonically_increasing_id())
        texts = texts.cache()
        mine = {r["id"]: r["r"] for r in texts.selectExpr("id", "score_it(text) AS r").collect()}
        want = {r["id"]: r for r in MD.predict(model, texts, ["id"]).collect()}
        assert mine.keys() == want.keys()
        for k, r in mine.items():
            assert r["prediction"] == want[k]["prediction"]
            for c in ("confidence", "p_negative", "p_neutral", "p_positive"):
                assert math.isclose(r[c], want[k][c], abs_tol=1e-12), (k, c)


def test_fit_against_an_independent_solver(rows, fitted):
    """Coefficients, objective and probabilities against Newton's method."""
    features = fitted._scored(rows).select("_row.label", "features", "probability").collect()
    x = np.array([r["features"].toArray() for r in features])
    y = np.array([r["label"] for r in features], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ones = np.column_stack([np.ones(len(y)), x])
    penalty = np.r_[0.0, np.ones(x.shape[1])]
    b = np.zeros(ones.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-ones @ b))
        hessian = ones.T @ (ones * (w * p * (1 - p))[:, None]) + np.diag(penalty)
        b -= np.linalg.solve(hessian + 1e-12 * np.eye(len(b)), ones.T @ (w * (p - y)) + penalty * b)
    value = lambda b: (w * np.log1p(np.exp(np.where(y == 1, -1, 1) * (ones @ b)))).sum() + (b[1:] ** 2).sum() / 2
    lr = fitted.pipeline.stages[-1]
    own = np.r_[lr.intercept, lr.coefficients.toArray()]
    assert np.abs(own - b).max() < 0.02 and value(own) - value(b) < 1e-3 * value(b)
    assert max(abs(r["probability"][1] - q) for r, q in zip(features, 1 / (1 + np.exp(-ones @ b)))) < 0.01
