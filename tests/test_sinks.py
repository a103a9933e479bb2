"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from textpulse.sources import sinks as K
from textpulse.sources.fingerprint import changed, fingerprint


def test_star_json(spark, tmp_path):
    p = tmp_path / "stars.jsonl"
    p.write_text('{"text": "good", "stars": 5}\n{broken\n{"text": "meh", "stars": 3}\n'
                 '{"stars": 1}\n{"text": "bad", "stars": 2}\n')
    rows, bad = K.read_star_reviews(spark, str(p))
    assert sorted((r["text"], r["sentiment"]) for r in rows.collect()) == [
        ("bad", "negative"), ("good", "positive"), ("meh", "neutral")]
    assert bad.first()["bad_lines"] == 1


def test_review_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('review,label\n"a ""quoted""\nmulti-line review",1\nplain,0\n')
    df = K.read_review_csv(spark, str(p), multi_line=True)
    assert df.columns == ["text", "sentiment"]
    assert sorted(r["text"] for r in df.collect()) == ['a "quoted"\nmulti-line review', "plain"]


def test_feedback_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("t1", "x", "positive", None, None, None), ("t2", "y", "negative", "negative",
                                                                            True, "ok")],
                               "timestamp string, text string, predicted_label string, correct_label string, "
                               "is_accurate boolean, notes string")
    K.write_feedback_csv(df, str(tmp_path / "fb"))
    back = {r["timestamp"]: r for r in K.read_feedback_csv(spark, str(tmp_path / "fb")).collect()}
    assert back["t1"]["correct_label"] is None and back["t1"]["is_accurate"] is None
    assert back["t2"]["is_accurate"] is True


def test_json_log_and_alerts(spark, tmp_path):
    empty = K.read_json_log(spark, str(tmp_path / "missing"), K.FEEDBACK_SCHEMA)
    assert empty.count() == 0
    a = spark.createDataFrame([("DRIFT", "WARNING", "Covariate drift detected")], "type string, severity string, "
                                                                                  "message string")
    K.write_alerts(a, str(tmp_path / "alerts"))
    K.write_alerts(a, str(tmp_path / "alerts"))
    back = K.read_json_log(spark, str(tmp_path / "alerts"), K.ALERT_SCHEMA)
    assert back.count() == 2 and back.where(F.col("timestamp").isNull()).count() == 0


def test_split_write_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "doc_id int, split string")
    out = str(tmp_path / "splits")
    assert K.write_splits(df, out) == "written"
    assert K.write_splits(df, out) == "skipped"


def test_fingerprint_change(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, t string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "id int, t string")
    fa, fb, fc = (fingerprint(d, "t", ["id", "t"], "t") for d in (a, b, c))
    assert fa.collect() == fb.collect()
    assert changed(fa, fc).count() == 1 and changed(fa, fb).count() == 0


def test_fingerprint_sees_repeated_rows_and_nulls(spark):
    rows = lambda *r: fingerprint(spark.createDataFrame(list(r), "id int, t string"), "t", ["id", "t"], "t")
    assert changed(rows((1, "aa"), (1, "aa"), (3, "zz")), rows((2, "bb"), (2, "bb"), (3, "zz"))).count() == 1
    assert changed(rows((1, None), (2, "")), rows((1, ""), (2, None))).count() == 1


def test_star_json_caps(spark, tmp_path):
    p = tmp_path / "stars.jsonl"
    p.write_text("".join(f'{{"text": "t{k}", "stars": {1 + k % 5}}}\n' for k in range(50)))
    rows, _ = K.read_star_reviews(spark, str(p), max_per_class=4)
    assert {r["sentiment"]: r["count"] for r in rows.groupBy("sentiment").count().collect()} == {
        "negative": 4, "neutral": 4, "positive": 4}
    rows, counts = K.read_star_reviews(spark, str(p), max_lines=5)
    assert rows.count() == 5 and counts.first()["text_lines"] == 5


def test_feedback_inference_and_health_logs(spark, tmp_path):
    fb = spark.createDataFrame([("x", "positive", None, 0.9)], "text string, prediction string, true_label string, confidence double")
    K.write_feedback(fb, f"{tmp_path}/fb")
    K.write_feedback(fb, f"{tmp_path}/fb")
    back = K.read_json_log(spark, f"{tmp_path}/fb", K.FEEDBACK_SCHEMA)
    assert back.count() == 2 and back.where("timestamp IS NULL").count() == 0
    K.write_inference_log(fb.selectExpr("text", "prediction", "1.5 AS latency_ms"), f"{tmp_path}/inf")
    assert K.read_json_log(spark, f"{tmp_path}/inf", K.INFERENCE_LOG_SCHEMA).first()["text"] == "x"
    assert K.read_review_csv(spark, _csv(tmp_path, "text,labels\na,1\n,2\nb,\n")).collect() == [("a", "1")]
    with pytest.raises(ValueError, match="none of the columns"):
        K.read_review_csv(spark, _csv(tmp_path, "body,labels\na,1\n"))


def _csv(tmp_path, text):
    path = tmp_path / "r.csv"
    path.write_text(text)
    return str(path)
