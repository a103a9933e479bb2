"""The run log (A12, E9): keyed by data and settings, each run once."""

from textpulse.operators import runs as RN
from textpulse.sources.fingerprint import fingerprint


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "requested bigint, sample_size bigint, status string, accuracy double, "
                                             "f1_score double, error string")


def test_runs_are_logged_once_and_found_by_their_data(spark, tmp_path):
    path = str(tmp_path / "log")
    assert RN.read_runs(spark, path).count() == 0 and RN.best(RN.read_runs(spark, path)).count() == 0
    old = frame(spark, (100, 100, "ok", 0.9, 0.9, None), (200, 150, "ok", 0.95, 0.9, None))
    new = frame(spark, (100, 100, "ok", 0.7, 0.7, None), (200, 150, "ok", 0.7, 0.6, None), (400, 150, "failed", None, None, "x"))
    for _ in range(2):
        RN.append_runs(RN.keyed(old, "old", ["requested"]), path)
        RN.append_runs(RN.keyed(new, "new", ["requested"]), path)
    assert RN.read_runs(spark, path).count() == 5
    assert tuple(RN.best(RN.read_runs(spark, path, "new")).select("requested", "accuracy").first()) == (200, 0.7)
    assert RN.best(RN.read_runs(spark, path, "old")).first()["accuracy"] == 0.95


def test_data_id_follows_the_content(spark):
    one, same, other = (spark.createDataFrame(r, "id int, t string") for r in (
        [(1, "a"), (2, "b")], [(2, "b"), (1, "a")], [(1, "a"), (2, "c")]))
    ids = [RN.data_id(fingerprint(d, "x", ["id", "t"], "t")) for d in (one, same, other)]
    assert ids[0] == ids[1] != ids[2]
