"""Models (E1-E12), and streams over tables of several files."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from textpulse.functions import labels as L
from textpulse.operators import jobs
from textpulse.operators import model as MD
from textpulse.plans.q_features import split_clean
from textpulse.session import materialize
from textpulse.streaming import operators as SO
from textpulse.streaming.runner import run_available_now, table_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    sp = materialize(split_clean(spark, "/root/testdata/sf0.01"))
    return sp.where("split = 'train'"), sp.where("split = 'test'")


@pytest.fixture(scope="module")
def fitted(split):
    return MD.TextModel(max_features=500).fit(split[0], "cleaned_text", "sentiment")


def test_model_roundtrip_and_partitions(fitted, split, tmp_path):
    a = MD.predict(fitted, split[1], ["doc_id"])
    MD.save(fitted, str(tmp_path / "m"))
    loaded = MD.load(str(tmp_path / "m"))
    assert MD.classes(loaded) == ["0", "1"]
    b = MD.predict(loaded, split[1].repartition(3), ["doc_id"])
    ra, rb = ({r["doc_id"]: r for r in x.collect()} for x in (a, b))
    assert ra.keys() == rb.keys() and len(ra) > 0
    for k, r in ra.items():
        assert r["prediction"] == rb[k]["prediction"]
        assert math.isclose(r["p_negative"] + r["p_positive"], 1.0, rel_tol=1e-9)
        assert r["p_neutral"] == 0.0 and r["prediction"] in ("negative", "positive")


def test_gradient_is_near_zero_and_beats_the_majority(fitted, split):
    lr = next(s for s in fitted.stages if isinstance(s, LogisticRegressionModel))
    rows = fitted.transform(split[0].withColumn("_class", F.col("sentiment").cast("string")))
    rows = rows.select("features", "_label").collect()
    y = np.array([r["_label"] for r in rows])
    x = np.array([r["features"].toArray() for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ lr.coefficients.toArray() + lr.intercept)))
    slope = x.T @ (weight * (p - y)) / weight.sum() + lr.coefficients.toArray() / weight.sum()
    assert np.abs(slope).max() < 1e-3 and abs((weight * (p - y)).sum() / weight.sum()) < 1e-3
    recall = [(p[y == 0] < 0.5).mean(), (p[y == 1] >= 0.5).mean()]
    assert np.mean(recall) > 0.6


def test_held_out_rows_beat_the_majority(fitted, split):
    """Balanced accuracy on rows that the fit hasn't seen; one class for all has 0.5."""
    rows = MD.predict(fitted, split[1], ["sentiment"]).select(
        L.normalize_label(F.col("sentiment")).alias("truth"), "prediction")
    recall = rows.groupBy("truth").agg(F.avg((F.col("truth") == F.col("prediction")).cast("int")).alias("r")).collect()
    assert len(recall) == 2 and sum(r["r"] for r in recall) / 2 > 0.5


def test_three_string_classes(spark):
    words = {"negative": "awful dreadful", "neutral": "average middling", "positive": "great lovely"}
    rows = [(f"{w} film number {k}", c) for c, w in words.items() for k in range(12)] + [("no label", None)]
    df = spark.createDataFrame(rows, "text string, label string")
    m = MD.TextModel(max_features=50).fit(df, "text", "label")
    got = MD.predict(m, df.where("label IS NOT NULL"), ["label"]).collect()
    assert all(r["prediction"] == r["label"] for r in got)
    assert all(math.isclose(r["p_negative"] + r["p_neutral"] + r["p_positive"], 1.0) for r in got)
    with pytest.raises(ValueError, match="two classes"):
        MD.TextModel().fit(df.where("label = 'neutral'"), "text", "label")


def test_learning_curve_reports_rows_used_and_failures(spark):
    rows = [(k, f"{'good' if k % 2 else 'bad'} text {k}", k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    runs = MD.learning_curve(df, df, "id", "text", "label", [1, 10, 100], MD.TextModel(max_features=20, max_iter=20))
    assert [r["sample_size"] for r in runs] == [1, 10, 30] and [r["requested"] for r in runs] == [1, 10, 100]
    assert runs[0]["status"] == "failed" and runs[2]["accuracy"] == 1.0


def test_retrain_runs_and_saves(spark, tmp_path):
    rows = [(f"{'good' if k % 2 else 'bad'} thing", k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, "text string, label int")
    path = str(tmp_path / "model")
    assert MD.retrain(df, "text", "label", path, False) == {"status": "skipped", "samples": 0}
    assert MD.retrain(df, "text", "label", path, True) == {"status": "retrained", "samples": 20}
    assert {r.prediction for r in MD.predict(MD.load(path), df, []).collect()} == {"negative", "positive"}


def test_expand_probabilities_with_equal_names(spark):
    df = spark.range(1).select(*L.expand_probabilities(F.array(F.lit("0"), F.lit("Negative"), F.lit("x")),
                                                       F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))))
    assert tuple(df.first()) == ("negative", 0.5, 0.5, 0.0, 0.0)


def test_label_case_can_be_kept(spark):
    df = spark.createDataFrame([("0",), ("Mixed",), (None,)], "l string")
    assert [r[0] for r in df.select(L.normalize_label(F.col("l"), lowercase_unknown=False)).collect()] == \
        ["negative", "Mixed", None]


def test_parts_can_be_swapped(spark):
    assert "reviews" in jobs.PARTS["loader"]
    if "shout" not in jobs.PARTS["cleaner"]:
        jobs.register("cleaner", "shout", lambda text: F.upper(F.col(text)))
    rows = jobs.TextJob(cleaner="shout").rows(spark, SF)
    assert rows.where(F.upper("text") != F.col("text")).count() == 0 and rows.count() > 0
    with pytest.raises(ValueError):
        jobs.register("cleaner", "shout", None)
    with pytest.raises(KeyError, match="no model"):
        jobs.part("model", "none such")


# --- streams -------------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables as folders of part files."""
    path = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "events", "labels", "conversations", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def _close(a, b):
    """Equal rows but for the last digit of rounded means (sums in another order)."""
    key = lambda r: tuple(repr(v) for v in r if not isinstance(v, float))
    a, b = (sorted(map(tuple, x.collect()), key=key) for x in (a, b))
    assert a and len(a) == len(b)
    for x, y in zip(a, b):
        assert key(x) == key(y) and all(math.isclose(u, v, abs_tol=0.0011) for u, v in zip(x, y) if isinstance(u, float))


PAIRS = [("stream_clean_documents", "clean_documents"), ("stream_window_accuracy", "window_accuracy_by_key"),
         ("stream_service_metrics", "service_metrics_windows"), ("stream_daily_drift", "psi_daily_latency")]


@pytest.mark.parametrize("stream,batch", PAIRS)
def test_stream_over_part_files_equals_batch(spark, folder, stream, batch):
    import __spark_entry__ as E
    q = E.queries()
    s = q[stream](spark, folder)
    _close(s, q[batch](spark, SF).select(*s.columns))


@pytest.mark.parametrize("name", ["stream_prediction_log", "stream_service_metrics_sliding", "stream_delayed_labels",
                                  "stream_alerts"])
def test_stream_over_part_files_equals_single_file(spark, folder, name):
    import __spark_entry__ as E
    _close(*(E.queries()[name](spark, d) for d in (folder, SF)))


def test_scored_stream_equals_batch(spark, fitted, folder):
    stream = SO.scored_document_stream(table_stream(spark, folder, "documents", max_files_per_trigger=1), fitted)
    out = spark.read.parquet(run_available_now(stream))
    batch = SO.scored_document_stream(spark.read.parquet(f"{SF}/documents.parquet"), fitted)
    s, b = ({r.doc_id: r for r in x.collect()} for x in (out, batch))
    assert s.keys() == b.keys()
    assert all(s[k].prediction == b[k].prediction and math.isclose(s[k].confidence, b[k].confidence) for k in s)


def test_window_beyond_the_watermark_is_dropped_in_append_mode(spark, tmp_path):
    """A row that comes after its day was closed changes nothing in append mode."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    src, base = tmp_path / "src" / "events.parquet", str(tmp_path / "run")

    def put(rows, n):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    put([(1, "2024-01-01 10:00:00", 1, "a", 5.0, '{"k": 1}'), (2, "2024-01-03 10:00:00", 1, "a", 5.0, '{"k": 1}')], 0)
    stream = lambda: SO.windowed_metrics(SO.prediction_stream(
        spark.readStream.schema(schema).parquet(str(src))))
    run_available_now(stream(), base=base)
    put([(3, "2024-01-01 11:00:00", 1, "a", 50.0, '{"k": 1}'), (4, "2024-01-05 10:00:00", 1, "a", 5.0, '{"k": 1}')], 1)
    out = spark.read.parquet(run_available_now(stream(), base=base))
    got = {r.window_start: r.requests for r in out.collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-03 00:00:00"] == 1
