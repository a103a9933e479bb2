"""Quotas that hold exactly: repeated ids, equal rows, null ids, keys that tie."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textpulse.operators import ordered as O
from textpulse.operators import sampling as S


@pytest.mark.parametrize("few", [100_000, 3])
def test_cap_holds_with_repeated_ids(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    rnd = random.Random(few)
    rows = [(rnd.choice([None, *range(8)]), rnd.choice(["a", "a", "b", None]), rnd.choice(["x", "y"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, g string, t string")
    for cap in (1, 7, 30, 500):
        got = S.cap_per_class(df, "g", "doc_id", cap=cap)
        sizes = {g: sum(r[1] == g for r in rows) for g in ("a", "b", None)}
        assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {g: min(cap, n) for g, n in sizes.items()}
        assert got.exceptAll(df).count() == 0
        # whole ids in hash order but for the last one of a group
        order = Window.partitionBy("g").orderBy(S.hash_key("doc_id"), F.col("doc_id").asc_nulls_first())
        want = df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
        ids = lambda d: sorted(map(repr, ((r["g"], r["doc_id"]) for r in d.collect())))
        assert ids(got) == ids(want)


def test_split_keeps_every_row_once_with_repeated_ids(spark):
    df = spark.createDataFrame([(k % 3, k % 2, "same") for k in range(60)], "doc_id long, label int, t string")
    sp = S.stratified_split(df, "label", "doc_id")
    assert sp.drop("split").exceptAll(df).count() == df.exceptAll(sp.drop("split")).count() == 0
    assert {(r["label"], r["split"]): r["count"] for r in sp.groupBy("label", "split").count().collect()} == {
        (0, "test"): 6, (0, "train"): 24, (1, "test"): 6, (1, "train"): 24}


@pytest.mark.parametrize("few", [100_000, 2])
def test_threshold_of_any_keys(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    rnd = random.Random(5)
    keys = [-2**63, 2**63 - 1, 0, -1, 1, 7, 7, 7, 2**40, 2**40 + 1] + [rnd.randrange(-2**63, 2**63) for _ in range(60)]
    rows = [(rnd.choice("abc"), k, i // 2) for i, k in enumerate(keys * 2)] + [("one", 5, 1)]
    df = spark.createDataFrame(rows, "g string, k long, id long")
    for share in (1, 3, 20, 1000):
        got = {r["g"]: r for r in O.rank_threshold(df, ["g"], "k", "id", lambda s: s.select(
            "g", F.least("_rows", F.lit(share)).alias("quota"))).collect()}
        for g in ("a", "b", "c", "one"):
            own = sorted((k, i) for h, k, i in rows if h == g)
            n = min(share, len(own))
            cut = own[n - 1]
            assert (got[g]["cut_key"], got[g]["cut_id"]) == cut
            assert got[g]["cut_rows"] == own.count(cut) and got[g]["cut_take"] == n - sum(x < cut for x in own)
