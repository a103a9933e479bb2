"""Ordered helpers and sampling against plain windows, on hot and skewed data."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textpulse.operators import ordered as O
from textpulse.operators import sampling as S
from textpulse.sources.tables import reviews

SF = "/root/testdata/sf0.01"


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def _skewed(spark):
    """A group with a third of all rows, one far outlier, a null group."""
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    v = F.when(F.col("id") == 9, 1e12).otherwise(F.col("id").cast("double"))
    return spark.range(9000).select(g.alias("g"), v.alias("v"), (F.col("id") % 7 + 1).alias("c"))


def test_running_total_with_outlier_and_hot_group(spark):
    df = _skewed(spark)
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    _same(O.running_total(df, ["g"], "v", ["c"]), df.withColumn("c_cum", F.sum("c").over(w)))
    got = O.running_total(df, [], "v", ["c"])
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    _same(got, df.withColumn("c_cum", F.sum("c").over(w)))


def test_rank_threshold_is_the_rank(spark):
    rows = spark.createDataFrame([("a", -5, 1), ("a", 2**62, 2), ("a", 7, 3), ("a", 7, 4), ("a", 7, 5), ("b", 0, 6),
                                  (None, 3, 7), (None, 1, 8)], "g string, k long, id long")
    q = spark.createDataFrame([("a", 3), ("b", 9), (None, 1), ("c", 2)], "g string, quota long")
    got = {r.g: (r.cut_key, r.cut_id) for r in O.rank_threshold(rows, ["g"], "k", "id", q).collect()}
    assert got == {"a": (7, 4), "b": (0, 6), None: (1, 8)}
    all_ = O.rank_threshold(rows, [], "k", "id", spark.createDataFrame([(2,)], "quota long")).collect()
    assert [(r.cut_key, r.cut_id) for r in all_] == [(0, 6)]


def test_split_properties(spark):
    rv = reviews(spark, SF).select("doc_id", "sentiment")
    sp = S.stratified_split(rv, "sentiment", "doc_id")
    n = rv.count()
    assert sp.count() == n and sp.select("doc_id").distinct().count() == n
    c = {(r["split"], r["sentiment"]): r["count"] for r in sp.groupBy("split", "sentiment").count().collect()}
    assert sum(v for (s, _), v in c.items() if s == "test") == -(-n // 5)
    for lab in (0, 1):
        share = c[("test", lab)] / (c[("test", lab)] + c[("train", lab)])
        assert abs(share - 0.2) < 0.02
    again = S.stratified_split(rv, "sentiment", "doc_id")
    assert sp.exceptAll(again).count() == 0


def test_sample_and_cap(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    w = Window.orderBy(S.hash_key("doc_id"), "doc_id")
    _same(S.sample_rows(docs, 100, "doc_id"), docs.withColumn("r", F.row_number().over(w)).where("r <= 100").drop("r"))
    assert S.sample_rows(docs, 10**9, "doc_id").count() == docs.count()
    caps = {r["lang"]: r["count"] for r in S.cap_per_class(docs, "lang", "doc_id", cap=50).groupBy("lang").count().collect()}
    assert set(caps.values()) == {50} and len(caps) == 4
    assert S.sample_rows(docs.limit(0), 5, "doc_id").count() == 0


def test_repeated_ids_are_selected_together(spark):
    df = spark.createDataFrame([(k % 10, "a") for k in range(30)], "doc_id long, g string")
    got = S.cap_per_class(df, "g", "doc_id", cap=6)
    assert all(r["count"] == 3 for r in got.groupBy("doc_id").count().collect())


def test_shuffled_write_is_one_global_order(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    S.shuffled_write(df, str(tmp_path / "s"), "doc_id", partitions=4)
    files = sorted((tmp_path / "s").glob("*.parquet"))
    import pyarrow.parquet as pq
    ids = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    want = [r.doc_id for r in df.orderBy(S.hash_key("doc_id"), "doc_id").collect()]
    assert ids == want and len(files) > 1


def test_order_statistics(spark):
    vc = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 1), ("a", 7.0, 3), ("b", 2.0, 1)],
                               "g string, v double, c long")
    t = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 5), ("b", 0)], "g string, rank long")
    got = sorted(tuple(r) for r in O.order_statistics(vc, ["g"], "v", "c", t).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 5.0), ("a", 5, 7.0), ("b", 0, 2.0)]


def test_no_text_shuffle_in_tfidf(spark):
    """The only exchange over the text scan is that of term counts."""
    from textpulse.operators import tfidf as TF
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = TF.counted_terms(docs, "text").groupBy("term").agg(F.sum("first"))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "term" in line and "text" not in line
    cells = TF.tfidf(docs, "text", TF.vocabulary(docs, "text", 100), ["doc_id"])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_materialize_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from textpulse import session

    class Sc:
        master = "spark://elsewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Sc._jsc

            @staticmethod
            def getCheckpointDir():
                class Empty:
                    @staticmethod
                    def isDefined():
                        return False
                return Empty

        @staticmethod
        def getConf():
            return {}

    class Spark:
        sparkContext = Sc
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark)
