"""Term counts: pairs are only counted where they can reach the vocabulary; whitespace of all kinds."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textpulse.functions import text as T
from textpulse.operators import tfidf as TF

TEXTS = ["aa bb cc aa bb", "aa bb dd", "bb aa ee ff gg", "aa bb", "hh ii jj kk", "", None, "aa aa bb cc cc", "x aa y", "\u00e4\u00f6 aa bb"]


def _docs(spark):
    return spark.createDataFrame([(t, k % 3) for k, t in enumerate(TEXTS)], "text string, label int").repartition(3)


def _expected(k, ngram_max, label):
    cf, df = Counter(), Counter()
    for i, t in enumerate(TEXTS):
        w = re.findall(r"\w{2,}", (t or "").lower())
        found = w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if ngram_max > 1 else [])
        cf.update(found)
        df.update(set(found) if label is None or i % 3 == label else ())
    return [(t, n, df[t]) for t, n in sorted(cf.items(), key=lambda x: (-x[1], x[0].encode()))[:k]]


@pytest.mark.parametrize("ngram_max", [1, 2])
@pytest.mark.parametrize("held", [1, 300_000])
def test_vocabulary_against_counting_all(spark, monkeypatch, ngram_max, held):
    """Also with ties at the cut, more terms asked for than there are, counts handed on document by document."""
    monkeypatch.setattr(TF, "HELD_TERMS", held)
    for k in (1, 2, 3, 5, 50):
        v = TF.vocabulary(_docs(spark), "text", k, "label", ngram_max=ngram_max, stop_words=()).orderBy("index").collect()
        assert [(r.term, r.cf, r.df) for r in v] == _expected(k, ngram_max, None)
        assert [r.pos_df for r in v] == [n for _, _, n in _expected(k, ngram_max, 1)]
        assert [r.neg_df for r in v] == [n for _, _, n in _expected(k, ngram_max, 0)]
        assert {(r.n_pos, r.n_neg) for r in v} == {(3, 4)}


def test_pairs_of_rare_words_are_not_counted(spark):
    words = TF.words_of(_docs(spark), "text", stop_words=())
    among = TF.frequent_words(TF._summed(TF.counted_words(words, [1])), 2)
    assert among == {"aa", "bb"}
    assert {r.term for r in TF.counted_words(words, [2], among).collect()} == {"aa bb", "bb aa", "aa aa"}
    # so many words as rare as the last one: any pair may count
    assert TF.frequent_words(TF._summed(TF.counted_words(words, [1])), 50) is None


def test_collapse_of_every_whitespace(spark):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}c{c} d{c}{c}e  f" for c in points]
    space = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.collapse_whitespace("text").alias("t"))
    assert {r.id: r.t for r in got.collect()} == {k: re.sub(space, " ", t).strip(" ") for k, t in enumerate(texts)}


def test_counts_of_runs_against_counting_each_document(spark, monkeypatch):
    """Labels of all kinds, texts without words, one word and many; runs of a document, of some, of all."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "eé"], k=rng.choice([0, 0, 1, 2, 9, 40]))) for _ in range(60)]
    rows = [(rng.choice([None, 0, 1]), t) for t in texts]
    n, first = Counter(), Counter()
    for label, t in rows:
        w = t.split()
        found = ["", *w, *(f"{a} {b}" for a, b in zip(w, w[1:]) if "bb" not in (a, b))]
        n.update((label, x) for x in found)
        first.update((label, x) for x in set(found))
    words = spark.createDataFrame(rows, "label int, words string").repartition(2)
    for held in (1, 50, 1_000_000):
        monkeypatch.setattr(TF, "HELD_TERMS", held)
        got = TF.counted_words(words, [1]).unionByName(TF.counted_words(words, [2], frozenset({"aa", "cc", "dd", "eé", "zz"})))
        got = got.groupBy("label", "term").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).collect()
        assert {(r.label, r.term): r.n for r in got} == n
        assert {(r.label, r.term): r["first"] for r in got} == first


def test_features_of_words_are_those_of_the_texts(spark):
    """A fit takes its features from the words it has counted, and makes only pairs that the vocabulary can have."""
    docs = _docs(spark)
    for ngram_max, stop_words, k in ((2, (), 4), (2, (), 50), (2, ("bb",), 5), (1, (), 50), (2, ("aa", "bb"), 0)):
        args = {"ngram_max": ngram_max, "stop_words": stop_words}
        words = TF.words_of(docs, "text", keep=["text"], stop_words=stop_words)
        vocab = TF.vocabulary_of(words, k, ngram_max=ngram_max)
        of_texts, of_words = TF.featurizers(vocab, "text", **args)
        terms = [r.term for r in vocab.orderBy("index").collect()]
        for row in of_texts.transform(docs).collect():
            w = [x for x in re.findall(r"\w{2,}", (row.text or "").lower()) if x not in stop_words]
            all_terms = Counter(w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if ngram_max > 1 else []))
            assert {terms[i]: int(n) for i, n in zip(row._tf.indices, row._tf.values)} == {
                t: n for t, n in all_terms.items() if t in terms} if terms else row._tf.numNonzeros() == 0
        by_text = {r.text: r.features for r in of_texts.transform(docs).collect()}
        assert {r.text: r.features for r in of_words.transform(words).collect()} == by_text
    only = TF.featurizer(TF.vocabulary(docs, "text", 4, stop_words=()), "text", stop_words=())
    made = {t for r in only.transform(docs).collect() for t in r._terms if " " in t}
    assert made == {"aa bb"}
