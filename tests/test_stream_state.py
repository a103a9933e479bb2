"""Keyed state (I4, I6) and alerts written once (I7): restarts, replays, expiry."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textpulse.operators import evaluation as EV
from textpulse.sources.tables import prediction_columns
from textpulse.streaming import operators as SO
from textpulse.streaming import state as ST
from textpulse.streaming.runner import latest, run_available_now, run_updates, update_stream

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def put(spark, path, rows):
    df = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts string"))
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def event(i, user, ts, k=1, value=None, kind="view"):
    return (i, ts, user, kind, float(i % 40 if value is None else value), f'{{"k": {k}}}')


def batches(spark, path):
    """Rows by batch id."""
    out = {}
    for r in spark.read.parquet(path).collect():
        out.setdefault(r["batch_id"], []).append(r)
    return out


def test_rolling_state_touches_its_own_keys_and_survives_restarts(spark, tmp_path):
    src, base = str(tmp_path / "events.parquet"), str(tmp_path / "run")
    first = [event(i, i % 7, f"2024-01-01 00:{i % 60:02d}:00", i % 5, kind="error" if i % 6 == 0 else "view") for i in range(200)]
    # the second batch has late rows (older than what its keys hold), two keys only
    second = [event(1000 + i, (2, 9)[i % 2], f"2024-01-01 00:{(7 * i) % 60:02d}:30", i) for i in range(30)]
    third = [event(2000, 3, "2024-01-02 00:00:00", 2)]
    stream = lambda: ST.rolling_last_n(prediction_columns(spark.readStream.schema(EVENTS).parquet(src)), 5)
    for rows in (first, second, third):  # every run starts anew from the checkpoint
        put(spark, src, rows)
        path = run_updates(stream(), base=base, conf=ST.ROCKSDB)
    seen = batches(spark, path)
    assert [sorted(r["key"] for r in seen[b]) for b in sorted(seen) if seen[b]] == [list(range(7)), [2, 9], [3]]
    assert max(r["total_samples"] for b in seen.values() for r in b) == 5
    got = {r["key"]: (r["total_samples"], r["correct"]) for r in latest(spark.read.parquet(path), ["key"]).collect()}
    log = prediction_columns(spark.read.schema(EVENTS).parquet(src))
    want = EV.window_accuracy(EV.last_n_labelled(log, 5, "key"), ["key"]).collect()
    assert got == {r["key"]: (r["total_samples"], r["correct"]) for r in want}


def test_idle_keys_lose_their_state(spark, tmp_path):
    src, base = str(tmp_path / "events.parquet"), str(tmp_path / "run")
    runs = ([event(i, 1, f"2024-01-01 00:00:{i:02d}") for i in range(4)], [event(10, 2, "2024-01-20 00:00:00")],
            [event(20, 1, "2024-01-21 00:00:00"), event(21, 1, "2024-01-02 00:00:00")])
    for rows in runs:
        put(spark, src, rows)
        stream = ST.rolling_last_n(prediction_columns(spark.readStream.schema(EVENTS).parquet(src)), 5, idle="10 days")
        path = run_updates(stream, base=base, conf=ST.ROCKSDB)
    rows = {r["key"]: r["total_samples"] for r in latest(spark.read.parquet(path), ["key"]).collect()}
    assert rows == {1: 1, 2: 1}  # key 1 began anew; its late row doesn't count


def test_batches_are_reduced_before_the_shuffle():
    ts = pa.array(np.arange(10_000) * 1_000_000, pa.timestamp("us"))
    batch = pa.RecordBatch.from_pydict({"key": pa.array([1] * 9_990 + [None] * 6 + [2] * 4, pa.int64()), "ts": ts,
                                        "id": pa.array(range(10_000)), "ok": pa.array([True] * 10_000)})
    [out] = ST._newest_of(3)(iter([batch]))
    assert sorted(out.column("id").to_pylist()) == [9987, 9988, 9989, 9993, 9994, 9995, 9997, 9998, 9999]
    [counts] = ST._bucket_counts([10.0, 20.0])(iter([pa.RecordBatch.from_pydict(
        {"ts": ts, "at": ts.cast(pa.int64()), "day": ["a"] * 10_000, "value": pa.array(np.arange(10_000) % 30, pa.float64())})]))
    assert sorted(zip(counts.column("bucket").to_pylist(), counts.column("cnt").to_pylist())) == [(0, 3340), (1, 3330), (2, 3330)]


def test_daily_psi_needs_its_own_days_only(spark, tmp_path):
    src, base = str(tmp_path / "events.parquet"), str(tmp_path / "run")
    edges, shares = [10.0, 20.0, 30.0], [0.25, 0.25, 0.25, 0.25]
    days = ([event(i, 1, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(90)],
            [event(i, 1, "2024-01-02 11:00:00", value=35) for i in range(200, 230)])
    for rows in days:
        put(spark, src, rows)
        pred = prediction_columns(spark.readStream.schema(EVENTS).parquet(src))
        path = run_updates(ST.daily_psi(pred, "latency_ms", edges, shares, idle="30 days"), base=base, conf=ST.ROCKSDB)
    seen = batches(spark, path)
    assert [sorted(r["day"] for r in seen[b]) for b in sorted(seen) if seen[b]] == \
        [["2024-01-01", "2024-01-02", "2024-01-03"], ["2024-01-02"]]
    for r in latest(spark.read.parquet(path), ["day"]).collect():
        values = [e[4] for batch in days for e in batch if e[1].startswith(r["day"])]
        a = np.bincount(np.searchsorted(edges, values, side="right"), minlength=4) / len(values)
        a = np.where(a == 0, ST.PSI_EPSILON, a)
        assert r["production_rows"] == len(values)
        assert math.isclose(r["psi_raw"], float(((a - 0.25) * np.log(a / 0.25)).sum()))


@pytest.mark.parametrize("replay", [False, True])
def test_alerts_are_written_once(spark, tmp_path, replay):
    psi, acc, base = str(tmp_path / "psi"), str(tmp_path / "acc"), str(tmp_path / "run")
    kinds = {psi: "day string, psi double, status string", acc: "day string, accuracy double"}

    def batch(path, n, rows):
        spark.createDataFrame(rows, kinds[path]).coalesce(1).write.mode("append").parquet(f"{path}/batch_id={n}")

    def run():
        streams = [update_stream(spark, p, spark.createDataFrame([], k).schema) for p, k in kinds.items()]
        return spark.read.json(run_available_now(SO.daily_alert_stream(*streams), fmt="json", base=base)).collect()

    shift, none = "Significant shift", "No change"
    one = [("2024-01-01", 0.5, shift), ("2024-01-02", 0.01, none)]
    batch(psi, 0, one)
    batch(acc, 0, [("2024-01-01", 0.7), ("2024-01-02", 0.9)])
    before = {r["alert_id"] for r in run()}
    assert len(before) == 2
    if replay:  # the same updates come again, and a day is updated without a new alert
        batch(psi, 0, one)
        batch(psi, 1, [("2024-01-01", 0.6, shift)])
        assert {r["alert_id"] for r in run()} == before and len(run()) == 2
    batch(psi, 2, [("2024-01-03", 0.15, "Moderate shift")])
    batch(acc, 2, [("2024-01-01", 0.5)])  # worse than before
    after = run()
    assert len(after) == 4 and before < {r["alert_id"] for r in after}
    assert {(r["type"], r["severity"]) for r in after} == {
        ("DRIFT", "CRITICAL"), ("METRICS", "WARNING"), ("DRIFT", "WARNING"), ("METRICS", "CRITICAL")}
