"""JSON-lines data sources (J1) and the star reader's cap and counts."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from textpulse.sources import datasource as DS
from textpulse.sources import sinks as K
from textpulse.streaming.runner import run_available_now


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_every_line_belongs_to_one_split(monkeypatch, block):
    monkeypatch.setattr(DS, "BLOCK", block)
    rnd = random.Random(1)
    for _ in range(60):
        data = b"".join(b"x" * rnd.choice([0, 1, 2, 9]) + b"\n" * rnd.choice([1, 1, 2]) for _ in range(rnd.randint(0, 12)))
        data += rnd.choice([b"", b"tail", b"\n"])
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        if not want[-1][1]:
            want.pop()
        for size in (1, 2, 5, 1000):
            got = [x for s in DS.splits({"f": len(data)}, size) for x in DS.lines(io.BytesIO(data), s)]
            assert got == want


def write_lines(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


LINES = [json.dumps({"text": "a", "stars": 5}), '{"text": "broken', "[1]", "", json.dumps({"stars": 2.5}), "3", "   ",
         json.dumps({"text": None, "stars": None}), json.dumps({"text": 7, "stars": 1}), json.dumps({"text": "b", "stars": "x"}),
         json.dumps({"text": "ünï ", "stars": True, "more": {"x": 1}}), '{"text": "c", "stars": 1e2}']


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_star_reviews_source(spark, tmp_path, size):
    write_lines(tmp_path, "one.json", LINES)
    write_lines(tmp_path, "two.json", LINES[:3])
    write_lines(tmp_path, "_hidden.json", LINES)
    DS.register(spark)
    rows = spark.read.format("star_reviews").option("splitBytes", size).load(str(tmp_path)).collect()
    got = {(r["file"].rsplit("/", 1)[1], r["position"]): (r["text"], r["stars"], r["broken"]) for r in rows}
    assert len(got) == len(rows)  # the identity
    want = {}
    for name, lines in (("one.json", LINES), ("two.json", LINES[:3])):
        at = 0
        for line, row in zip(lines, [("a", 5.0, False), (None, None, True), (None, None, True), None, (None, 2.5, False),
                                     (None, None, True), None, (None, None, False), (None, 1.0, True), ("b", None, True),
                                     ("ünï ", None, True), ("c", 100.0, False)]):
            if row is not None:
                want[name, at] = row
            at += len(line.encode()) + 1
    assert got == want
    assert spark.read.format("star_reviews").load(str(tmp_path / "none such")).count() == 0


def test_stream_reads_each_file_once_across_restarts(spark, tmp_path):
    src, base = tmp_path / "src", str(tmp_path / "run")
    DS.register(spark)
    for n in range(3):
        for k in range(2):
            write_lines(src, f"{n}{k}.json", [json.dumps({"text": f"{n}{k}{i}", "stars": i}) for i in range(5)])
        stream = spark.readStream.format("star_reviews").load(str(src))
        out = spark.read.parquet(run_available_now(stream, base=base))
        assert sorted(r["text"] for r in out.collect()) == sorted(f"{m}{k}{i}" for m in range(n + 1) for k in range(2) for i in range(5))


def test_feedback_source_equals_the_json_reader(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(100).select(F.concat(F.lit("t\n"), "id").alias("text"), F.lit("positive").alias("prediction"),
                                 F.when(F.col("id") % 3 > 0, "negative").alias("true_label"), (F.col("id") / 7).alias("confidence"))
    K.write_feedback(df, path)
    DS.register(spark)
    got = spark.read.format("feedback_log").load(path).drop("broken", "file", "position")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, K.read_json_log(spark, path, K.FEEDBACK_SCHEMA).collect()))


def test_cap_is_exact_on_equal_texts(spark, tmp_path):
    write_lines(tmp_path, "a.json", [json.dumps({"text": "same", "stars": 5})] * 50 + [json.dumps({"text": f"t{i}", "stars": 5}) for i in range(9)]
                + ["{broken"] * 3 + [json.dumps({"text": "no stars"})])
    for cap in (1, 10, 55, 100):
        rows, counts = K.read_star_reviews(spark, str(tmp_path), max_per_class=cap)
        assert rows.count() == min(cap, 59)
        assert tuple(counts.first()) == (3, 60)
    assert rows.columns == ["text", "stars", "sentiment"]


def test_first_lines_go_by_file_and_place(spark, tmp_path):
    for k in range(3):
        write_lines(tmp_path, f"{k}.json", [json.dumps({"text": f"{k}{i}", "stars": 1 + i % 5}) for i in range(10)])
    for n in (0, 1, 10, 25, 30, 99):
        rows, counts = K.read_star_reviews(spark, str(tmp_path), max_lines=n)
        assert sorted(r["text"] for r in rows.collect()) == [f"{k // 10}{k % 10}" for k in range(min(n, 30))]
        assert counts.first()["text_lines"] == min(n, 30)
