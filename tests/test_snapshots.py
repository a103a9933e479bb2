"""Fingerprints by file and table (A14); accepted and quarantined rows."""

import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textpulse.functions.validation import MAX_TEXT_CHARS
from textpulse.sources import sinks as K
from textpulse.sources.fingerprint import DIGEST, changed, changed_files, file_fingerprints, fingerprint, fold, row_hash
from textpulse.streaming.runner import run_available_now

COLS = ["id", "t", "u"]


def one(spark, *rows):
    df = spark.createDataFrame(list(rows), "id int, t string, u string")
    return tuple(fingerprint(df, "x", COLS, "t").first())


def test_different_rows_have_different_digests(spark):
    words = ["", "a", "b", "|", "a|b", "1:a", "-", ":", "1", "1:", None, "\x00"]
    rows = [(1, t, u) for t, u in itertools.product(words, words)]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    digests = [r[0] for r in df.select(row_hash(COLS)).collect()]
    assert len(set(digests)) == len(rows)
    assert one(spark, (1, "a|b", "c")) != one(spark, (1, "a", "b|c"))


def snapshot(spark, path):
    return file_fingerprints(spark.read.parquet(str(path)), "x", COLS, "t")


def test_changed_files_are_named(spark, tmp_path):
    def put(name, rows):
        pq.write_table(pa.table({"id": pa.array([r[0] for r in rows], pa.int32()), "t": [r[1] for r in rows],
                                 "u": pa.array([r[2] for r in rows], pa.string())}), tmp_path / name)

    parts = {f"{k}.parquet": [(k * 10 + i, f"text {i}", None if i % 2 else "u") for i in range(10)] for k in range(5)}
    for name, rows in parts.items():
        put(name, rows)
    before = spark.createDataFrame(
        snapshot(spark, tmp_path).collect(), snapshot(spark, tmp_path).schema)
    whole = fingerprint(spark.read.parquet(str(tmp_path)), "x", COLS, "t")
    assert fold(before, "x").collect() == whole.collect()
    assert changed_files(before, snapshot(spark, tmp_path)).count() == 0
    put("1.parquet", parts["1.parquet"][::-1])  # another order is no change
    put("2.parquet", [(20, "other", "u"), *parts["2.parquet"][1:]])
    put("3.parquet", [*parts["3.parquet"], (99, None, None)])
    put("5.parquet", parts["0.parquet"])
    (tmp_path / "4.parquet").unlink()
    found = changed_files(before, snapshot(spark, tmp_path)).collect()
    assert {(r["file"].rsplit("/", 1)[1], r["change"]) for r in found} == {
        ("2.parquet", "changed"), ("3.parquet", "changed"), ("4.parquet", "removed"), ("5.parquet", "added")}
    after = fold(snapshot(spark, tmp_path), "x")
    assert [r[0] for r in changed(fold(before, "x"), after).collect()] == ["x"]
    assert changed(fold(before, "x"), fold(before, "x")).count() == 0


def test_no_rows_have_a_fingerprint(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, t string, u string")
    row = fingerprint(empty, "x", COLS, "t")
    assert tuple(row.first()) == ("x", 0, 0, None, None)
    assert changed(row, fingerprint(empty, "x", COLS, "t")).count() == 0
    empty.write.parquet(str(tmp_path / "e"))
    assert fold(snapshot(spark, tmp_path / "e"), "x").select(*DIGEST).first() == row.select(*DIGEST).first()


TEXTS = [None, "", " \t \n", "ok", "  padded\n", "x" * MAX_TEXT_CHARS, "x" * (MAX_TEXT_CHARS + 1), " " * MAX_TEXT_CHARS + "y", "ok"]
REASONS = ["missing", "blank", "blank", None, None, None, "too_long", "too_long", None]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_every_row_lands_in_one_table_by_one_pass(spark, requests, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    path = str(tmp_path / "v")
    K.write_validated(requests.mapInArrow(counted, requests.schema), "text", path)
    assert read.value == len(TEXTS)
    good = {r["id"]: r["text"] for r in K.read_accepted(spark, path, requests.schema).collect()}
    bad = {r["id"]: (r["text"], r["reject_reason"]) for r in K.read_quarantine(spark, path, requests.schema).collect()}
    assert good == {k: TEXTS[k].strip() for k, why in enumerate(REASONS) if why is None}
    assert bad == {k: (TEXTS[k], why) for k, why in enumerate(REASONS) if why}
    # a table without one of the outcomes still reads
    only = str(tmp_path / "only")
    K.write_validated(requests.where("id = 3"), "text", only)
    assert K.read_quarantine(spark, only, requests.schema).count() == 0


def test_a_retried_batch_writes_its_rows_once(spark, requests, tmp_path):
    path, src = str(tmp_path / "v"), str(tmp_path / "src")
    sink = K.validated_sink("text", path)
    for _ in range(2):
        sink(requests, 0)
    assert K.read_accepted(spark, path, requests.schema).count() == 4
    requests.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streamed = str(tmp_path / "s")
    run_available_now(stream, foreach_batch=K.validated_sink("text", streamed))
    for read in (K.read_accepted, K.read_quarantine):
        a, b = (sorted(map(repr, read(spark, p, requests.schema).collect())) for p in (path, streamed))
        assert a == b and a
