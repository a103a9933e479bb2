"""Cleaner (B2-B12) edge rows and features."""

from pyspark.sql import functions as F

from textpulse.functions import text as T

CASES = [
    ("Contact me at test@example.com this movie was AMAZING",
     "contact me at [anonymized_email] this movie was amazing"),
    ("Hi @bob_99, see https://a.b/c?d=e now", "hi [anonymized_user] see now"),
    ("<b>Good</b> film - really", "good film  really"),
    ("line<br\n/>break", "linebr break"),
    ("café naïve 5*", "caf nave 5"),
    ("!!!", ""),
    ("", ""),
    ("   ", ""),
    (None, ""),
]


def test_clean_edge_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = dict(df.select("id", T.clean_text("text").alias("c")).collect())
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, (CASES[i][0], got[i])


def test_clean_flags_off(spark):
    df = spark.createDataFrame([("Mail a@b.co NOW!",)], "text string")
    kept = df.select(T.clean_text("text", lowercase=False, remove_special=False, anonymize_pii=False)).first()[0]
    assert kept == "Mail a@b.co NOW!"


def test_features(spark):
    rows = [("  two words ",), ("",), (None,), ("a　bb\tccc",)]
    df = spark.createDataFrame(rows, "text string")
    got = df.select(T.char_length("text"), T.word_count("text"), T.avg_word_length("text")).collect()
    assert [tuple(r) for r in got] == [(12, 2, 4.0), (0, 0, 0.0), (0, 0, 0.0), (8, 3, 2.0)]


def test_staged_features_match_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = T.with_text_features(df, "text").select("doc_id", "char_length", "word_count", "avg_word_length")
    b = df.select("doc_id", *T.text_features("text"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_validation(spark):
    from textpulse.functions.validation import validate_request
    df = spark.createDataFrame([(None,), ("  ",), ("x" * 10_000,), ("x" * 10_001,), (" ok ",)], "text string")
    v = validate_request(F.col("text"))
    got = [tuple(r) for r in df.select(v["reject_reason"], v["stripped"]).collect()]
    assert [g[0] for g in got] == ["missing", "blank", None, "too_long", None]
    assert got[4][1] == "ok"
    # the limit of a single request is on the text as sent, a batch's on the stripped text
    padded = spark.createDataFrame([(" " * 5 + "x" * 9_998,)], "text string")
    single, batch = validate_request(F.col("text")), validate_request(F.col("text"), stripped_length=True)
    assert tuple(padded.select(single["reject_reason"].alias("a"), batch["reject_reason"].alias("b")).first()) == ("too_long", None)


def plain_clean(text):
    """The cleaner's rules in plain Python, written from their description."""
    import re
    t = text or ""
    t = re.sub(r"[\w.\-]+@[\w.\-]+\.\w+", "[ANONYMIZED_EMAIL]", t)
    t = re.sub(r"@\w+", "[ANONYMIZED_USER]", t)
    t = re.sub(r"http\S+|www\S+", "", t)
    t = re.sub(r"<.*?>", "", t)
    t = " ".join(t.split())
    return re.sub(r"[^a-zA-Z0-9\s\[\]_]", "", t.lower()).strip()


def test_cleaner_against_plain_python(spark):
    odd = ["a<b<c>d>e", "<\n>x", "x@y.z@w.q", "ＡＢ c", "İı ẞ", "a_b-c", "www", "tab\tand\x0bvt\u2003em", "@@a @b-c", "<>"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    df = docs.unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in df.select("text", T.clean_text("text").alias("c")).collect():
        assert r.c == plain_clean(r.text), r.text[:80]


def test_accents_and_column_names(spark):
    import pytest
    from textpulse.operators import tfidf as TF
    df = spark.createDataFrame([("Café Ünïted e\u0301t ñandú the Ångström",)], "text string")
    got = df.select(TF.terms("text", ngram_max=1, accents=True)).first()[0]
    assert got == ["cafe", "united", "et", "nandu", "angstrom"]
    assert T.first_present(["label", "text", "cleaned_text"], T.TEXT_COLUMNS) == "cleaned_text"
    with pytest.raises(ValueError):
        T.first_present(["a"], T.LABEL_COLUMNS)


def test_quality_gate_checks_the_cleaned_text_and_columns(spark):
    import pytest
    from textpulse.operators.sampling import split_quality_gate
    rows = [("train", "x", k % 2) for k in range(101)] + [("test", "y", 0)] * 20 + [("test", "", 1)]
    df = spark.createDataFrame(rows, "split string, cleaned_text string, sentiment int")
    got = {r.check: r.passed for r in split_quality_gate(df, "cleaned_text", "sentiment").collect()}
    assert got == {"train_rows": True, "test_rows": True, "no_empty_text": False, "two_classes": True}
    with pytest.raises(ValueError, match="sentiment"):
        split_quality_gate(df.drop("sentiment"), "cleaned_text", "sentiment")
