"""Compatibility decomposition in the JVM (D1) against Python's."""

import unicodedata

from pyspark.sql import functions as F

from textpulse.operators import tfidf as TF

SF01 = "/root/testdata/sf0.01"


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_every_code_point(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(points[k:k + 997]) for k in range(0, len(points), 997)] + ["", "Tiếng Việt ﬁne ａbc", "각 가각 ㌀", "ȩ̣́a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").union(spark.createDataFrame([(-1, None)], "k int, t string"))
    got = {r["k"]: r["s"] for r in df.select("k", F.expr(TF.strip_accents_sql("t")).alias("s")).collect()}
    assert got.pop(-1) is None
    for k, t in enumerate(texts):
        assert got[k] == plain(t), [hex(ord(c)) for c in t if plain(c) != c][:5]


def test_documents(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("text", F.expr(TF.strip_accents_sql("text")).alias("s"))
    rows = df.collect()
    assert rows and all(r["s"] == plain(r["text"]) for r in rows)


def test_terms_of_accented_text(spark):
    df = spark.createDataFrame([("Tiếng Việt ﬁne ａbc ĐẸP",)], "t string")
    terms = df.select(TF.terms("t", ngram_max=1, stop_words=(), accents=True).alias("t")).first()[0]
    assert terms == ["tieng", "viet", "fine", "abc", plain("đẹp")]
