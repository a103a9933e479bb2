"""TF-IDF features (D1-D10) as DataFrame jobs.

Texts are never shuffled. Tokenizing, stop-word removal, n-grams and sorting are
array expressions on the row; term counts, weights and the L2 norm are computed
inside the row too, by the library's vectorizer over the fitted vocabulary. What
moves is the corpus statistics: ``(term, cf, df)`` partials after map-side
combination, so a term present in every document costs a few rows per task.
The vocabulary is bounded by ``max_features`` and held by the driver.

Formulas are the smooth-IDF defaults of the reproduced vectorizer:
idf = ln((1 + n) / (1 + df)) + 1, weight = tf * idf, rows L2-normalized.
"""

from __future__ import annotations

import unicodedata
import zipfile
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer,
                                StopWordsRemover)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
DEFAULT_MAX_FEATURES = 10_000
RETRAIN_MAX_FEATURES = 5_000
PRUNED_MAX_FEATURES = 1_000
HELD_TERMS = 1_000_000  # words that a task counts before it hands their counts on
OUT_TERMS = 50_000  # rows of a batch of counts
# ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def stop_word_list() -> tuple[str, ...]:
    """Spark's default English stop words: from its library, where that lies
    beside the Python package (no session needed), else from the JVM."""
    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            return tuple(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


@lru_cache(maxsize=1)
def decompositions() -> tuple[str, str, dict[int, str]]:
    """What becomes of code points when a text is decomposed for compatibility
    (NFKD) and loses its combining marks, from Python's Unicode tables: code
    points that turn into one other, or (at the end) vanish; what they turn into;
    and those that turn into several. Decomposition works code point by code point
    but for the order of the marks, which go."""
    one, gone, several = {}, [], {}
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        letter = chr(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x))
        if not plain:
            gone.append(letter)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != letter:
            one[letter] = plain
    return "".join([*one, *gone]), "".join(one.values()), several


def _ranges(points: Sequence[int]) -> str:
    """A character class of the code points."""
    out, begin = [], None
    points = sorted(points)
    for k, c in enumerate(points):
        begin = c if begin is None else begin
        if k + 1 == len(points) or points[k + 1] != c + 1:
            out.append(f"\\x{{{begin:x}}}-\\x{{{c:x}}}")
            begin = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _several_sql() -> tuple[str, str, str]:
    """SQL literals: the character class of code points that turn into several;
    for each 256 code points their block in the table (-1: none); the table, one
    entry a code point of those blocks."""
    _, _, several = decompositions()
    blocks = sorted({c >> 8 for c in several})
    at = [-1] * (blocks[-1] + 1)
    for k, block in enumerate(blocks):
        at[block] = k
    separator = "\ue000"
    entries = [several.get(block * 256 + k, "") for block in blocks for k in range(256)]
    return (_quoted(_ranges(several)), f"cast(split('{','.join(map(str, at))}', ',') AS array<int>)",
            f"split({_quoted(separator.join(entries))}, '{separator}')")


def strip_accents_sql(text: str) -> str:
    """Spark SQL: ``text`` decomposed for compatibility, without combining marks.
    One translation for code points that become one or none; texts with others
    (ligatures, Hangul, squared words) also go through the table, letter by
    letter. Both tables are constants of the expression."""
    changed, plain, _ = decompositions()
    several, at, table = _several_sql()
    entry = f"get({table}, get({at}, ascii(c) div 256) * 256 + ascii(c) % 256)"
    return (f"transform(array(translate({text}, {_quoted(changed)}, {_quoted(plain)})), x -> CASE WHEN x RLIKE {several} "
            f"THEN array_join(transform(split(x, ''), c -> CASE WHEN get({at}, ascii(c) div 256) >= 0 "
            f"THEN coalesce(nullif({entry}, ''), c) ELSE c END), '') ELSE x END)[0]")


def terms(text_col: str, **term_args) -> Column:
    """Lowercase, tokens of >= 2 word characters, stop words removed
    (before n-grams; None: the default list), then unigrams followed by bigrams.
    ``accents`` strips them first (cleaned text is ASCII and has none)."""
    return F.expr(terms_sql(text_col, **term_args))


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _counts(texts: pa.Array, size: int, among: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of ``size`` words of the texts (words joined by spaces): the distinct
    terms, their occurrences, and the texts they occur in."""
    lists = pc.split_pattern(texts, " ")
    at = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if size == 1:
        known = code[code != names.index("").as_py()]  # a text without words is one empty word
        at, n = at[code != names.index("").as_py()], np.bincount(known, minlength=len(names))
        cells = _distinct(at * len(names) + known)
        return names, n, np.bincount(cells % len(names), minlength=len(names)) if len(names) else n
    wanted = np.ones(len(names), bool) if among is None else pc.is_in(names, among).to_numpy(zero_copy_only=False)
    wanted = wanted[code]
    some = np.flatnonzero(wanted[:-1] & wanted[1:] & (at[:-1] == at[1:]))
    pairs, pair, n = np.unique(code[some] * len(names) + code[some + 1], return_inverse=True, return_counts=True)
    cells = _distinct(at[some] * len(pairs) + pair)
    first = np.bincount(cells % len(pairs), minlength=len(pairs)) if len(pairs) else n
    left, right = (names.take(pa.array(x)) for x in (pairs // max(len(names), 1), pairs % max(len(names), 1)))
    return pc.binary_join_element_wise(left, right, " "), n, first


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.diff(numbers, prepend=-1) != 0]


def _partial_counts(sizes: Sequence[int], among: frozenset[str] | None):
    """For ``mapInArrow`` over ``(label, words)``: counts of runs of documents that
    have about ``HELD_TERMS`` words."""
    among = None if among is None else pa.array(sorted(among), pa.string())

    def counted(label, texts):
        found = [_counts(texts, size, among) for size in sizes]
        if 1 in sizes:
            found.append((pa.array([""]), np.array([len(texts)]), np.array([len(texts)])))
        for terms_, n, first in found:
            some = np.flatnonzero(n)
            for k in range(0, len(some), OUT_TERMS):
                part = some[k:k + OUT_TERMS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([label] * len(part), pa.int32()), terms_.take(pa.array(part)).cast(pa.string()),
                    pa.array(n[part], pa.int64()), pa.array(first[part], pa.int64())],
                    names=["label", "term", "n", "first"])

    def run(batches):
        for batch in batches:
            labels, texts = batch.column(0), batch.column(1)
            words = np.cumsum(pc.add(pc.count_substring(texts, " "), 1).to_numpy(zero_copy_only=False))
            # a run ends before the document that reaches the next multiple of HELD_TERMS
            ends = np.append(np.flatnonzero(np.diff(words // HELD_TERMS)) + 1, len(words))
            for begin, end in zip([0, *ends], ends):
                run_labels, run_texts = labels.slice(begin, end - begin), texts.slice(begin, end - begin)
                for label in run_labels.unique().to_pylist():
                    same = pc.is_null(run_labels) if label is None else pc.fill_null(pc.equal(run_labels, label), False)
                    yield from counted(label, run_texts.filter(same))
    return run


def words_of(docs: DataFrame, text_col: str, label_col: str | None = None, keep: Sequence[str] = (),
             **term_args) -> DataFrame:
    """``(keep, label, words)``: the words of each document (D1-D3) joined by spaces,
    and its label if that is 0 or 1, else null."""
    label = F.when(F.col(label_col) == 1, 1).when(F.col(label_col) == 0, 0) if label_col else F.lit(None)
    joined = F.array_join(terms(text_col, ngram_max=1, **term_args), " ")
    return docs.select(*keep, label.cast("int").alias("label"), joined.alias("words"))


def counted_words(words: DataFrame, sizes: Sequence[int], among: frozenset[str] | None = None) -> DataFrame:
    """Of ``words_of``, partial counts ``(label, term, n, first)``, to be summed: ``n``
    occurrences of a term in ``first`` documents, for terms of 1 or 2 words; with
    ``among`` only pairs of those words. Tasks count before terms move. Beside
    single words the empty term stands once for each document."""
    return words.select("label", "words").mapInArrow(_partial_counts(tuple(sizes), among), "label int, term string, n bigint, first bigint")


def counted_terms(docs: DataFrame, text_col: str, label_col: str | None = None, ngram_max: int = 2,
                  **term_args) -> DataFrame:
    """``counted_words`` of all terms of the documents, in one pass."""
    return counted_words(words_of(docs, text_col, label_col, **term_args), (1, 2) if ngram_max >= 2 else (1,))


def _summed(counts: DataFrame) -> DataFrame:
    by_label = [F.sum(F.when(F.col("label") == v, F.col("first")).otherwise(0)).alias(c) for v, c in ((1, "pos_df"), (0, "neg_df"))]
    return counts.groupBy("term").agg(F.sum("n").alias("cf"), F.sum("first").alias("df"), *by_label)


def frequent_words(counted: DataFrame, max_features: int) -> frozenset[str] | None:
    """The words whose pairs can be among the top ``max_features`` terms. A pair is
    at most as frequent as either of its words, so where so many words have a count
    of c, pairs with a rarer word are below them all. None (any word): there are
    fewer words, or so many at c that the driver should not hold them."""
    words = counted.where("term <> ''")
    top = words.orderBy(F.desc("cf")).limit(max_features).agg(F.min("cf").alias("cf"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < max_features <= top["n"]:
        return None
    most = 4 * max_features
    found = words.where(F.col("cf") >= top["cf"]).select("term").limit(most + 1).collect()
    return frozenset(r["term"] for r in found) if len(found) <= most else None


def vocabulary(docs: DataFrame, text_col: str, max_features: int = DEFAULT_MAX_FEATURES,
               label_col: str | None = None, ngram_max: int = 2, **term_args) -> DataFrame:
    """D5 + D7: top ``max_features`` terms by corpus count (ties by term) with
    document frequency, smooth idf and a 0-based column index; with a 0/1
    ``label_col`` also the document frequency in each class, and the class sizes
    ``n_pos`` and ``n_neg``. One pass over the texts. For pairs their words are saved
    and single words counted first, then the pairs that can still be among the top
    (most distinct terms are pairs that can't). Saved (small)."""
    words = words_of(docs, text_col, label_col, **term_args)
    return vocabulary_of(words if ngram_max < 2 else materialize(words), max_features, label_col is not None, ngram_max)


def vocabulary_of(words: DataFrame, max_features: int = DEFAULT_MAX_FEATURES, labelled: bool = False,
                  ngram_max: int = 2) -> DataFrame:
    """``vocabulary`` of ``words_of`` documents; saved words, where there are pairs."""
    stats = _summed(counted_words(words, [1]))
    if ngram_max >= 2:
        stats = materialize(stats)
        stats = stats.unionByName(_summed(counted_words(words, [2], frequent_words(stats, max_features))))
    # the empty term counts documents; it goes first here and is left out below
    order = [F.desc(F.col("term") == ""), F.desc("cf"), F.asc("term")]
    top = materialize(stats.orderBy(*order).limit(max_features + 1))
    sizes = top.where("term = ''").select(F.col("df").alias("n_docs"), *[
        F.col(f"{c}_df").alias(f"n_{c}") for c in (("pos", "neg") if labelled else ())])
    sizes = sizes.groupBy().agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in sizes.columns])
    at = F.row_number().over(Window.orderBy(F.desc("cf"), F.asc("term"))) - 1  # <= max_features rows
    idf = F.log((F.lit(1) + F.col("n_docs")) / (F.lit(1) + F.col("df"))) + F.lit(1.0)
    return attach(top.where("term <> ''"), sizes).select(
        "term", "cf", "df", at.alias("index"), idf.alias("idf"),
        *(["pos_df", "neg_df", "n_pos", "n_neg"] if labelled else []))


def featurizer(vocab: DataFrame, text_col: str, **term_args) -> PipelineModel:
    """D6-D8 as a pipeline: terms, counts over the vocabulary, times idf, L2
    norm; column ``features``. Only pairs of words that form pairs of the vocabulary
    are made. The driver holds the vocabulary (max_features)."""
    return _featurizers(vocab, lambda among: terms_sql(text_col, among=among, **term_args))[0]


def featurizers(vocab: DataFrame, text_col: str, ngram_max: int = 2, **term_args) -> tuple[PipelineModel, PipelineModel]:
    """``featurizer``, and one for ``words_of`` the texts, with the same features."""
    def of_words(among):
        found = "split(words, ' ')"
        return with_pairs_sql(found, among) if ngram_max >= 2 else found
    return _featurizers(vocab, lambda among: terms_sql(text_col, ngram_max, among=among, **term_args), of_words)


def _featurizers(vocab: DataFrame, *terms_for) -> tuple[PipelineModel, ...]:
    rows = vocab.orderBy("index").select("term", "idf").collect()
    pairs = [r["term"].split(" ") for r in rows if " " in r["term"]]
    among = tuple(sorted({p[k] for p in pairs}) for k in (0, 1))
    stages = [
        CountVectorizerModel.from_vocabulary([r["term"] for r in rows] or ["_"], inputCol="_terms", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows] or [1.0]), inputCol="_tf",
                           outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="features"),
    ]
    return tuple(PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {f(among)} AS _terms FROM __THIS__"), *stages])
                 for f in terms_for)


def tfidf(docs: DataFrame, text_col: str, vocab: DataFrame, keep: Sequence[str], **term_args) -> DataFrame:
    """``(keep, term, index, weight)``: the L2-normalized cells of every document."""
    rows = featurizer(vocab, text_col, **term_args).transform(docs.select(*keep, text_col))
    cells = rows.select(*keep, F.unwrap_udt("features").alias("_f")).select(
        *keep, F.explode(F.arrays_zip("_f.indices", "_f.values")).alias("_c"))
    cells = cells.select(*keep, F.col("_c.indices").alias("index"), F.col("_c.values").alias("weight"))
    return cells.join(vocab.select("term", "index"), "index").select(*keep, "term", "index", "weight")


def terms_sql(text_col: str, ngram_max: int = 2, stop_words: Sequence[str] | None = None,
              lowercase: bool = True, accents: bool = False,
              among: tuple[Sequence[str], Sequence[str]] | None = None) -> str:
    """Spark SQL text of ``terms``. Accents go after the change of case. ``among``:
    first and second words of the pairs that are wanted; others are empty."""
    t = f"lower({text_col})" if lowercase else text_col
    t = f"coalesce({strip_accents_sql(t) if accents else t}, '')"
    words = stop_word_list() if stop_words is None else stop_words
    found = f"regexp_extract_all({t}, {_quoted(TOKEN_RE)}, 0)"
    if words:
        found = f"filter({found}, x -> NOT x IN ({', '.join(map(_quoted, words))}))"
    return with_pairs_sql(found, among) if ngram_max >= 2 else found


def with_pairs_sql(words: str, among: tuple[Sequence[str], Sequence[str]] | None = None) -> str:
    """Spark SQL text of the array ``words`` followed by its pairs (D4), ``among`` as in
    ``terms_sql``."""
    pair = "concat_ws(' ', a, b)"
    if among is not None:
        if not all(among):
            return words
        first, second = (", ".join(map(_quoted, x)) for x in among)
        pair = f"CASE WHEN a IN ({first}) AND b IN ({second}) THEN {pair} ELSE '' END"
    # the list is named once, by a one-element transform
    n = "greatest(size(tk) - 1, 0)"
    return f"transform(array({words}), tk -> concat(tk, zip_with(slice(tk, 1, {n}), slice(tk, 2, {n}), (a, b) -> {pair})))[0]"


def sql_terms(text: str, ngram_max: int = 2, stop_words: Sequence[str] | None = None, lowercase: bool = True,
              accents: bool = False) -> str:
    """DuckDB twin of ``terms`` (for the oracle strings)."""
    stop_words = stop_word_list() if stop_words is None else stop_words
    t = f"lower({text})" if lowercase else text
    t = f"coalesce({f'strip_accents({t})' if accents else t}, '')"
    toks = f"regexp_extract_all({t}, '{TOKEN_RE}')"
    if stop_words:
        lst = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words) + "]"
        toks = f"list_filter({toks}, lambda x: NOT list_contains({lst}, x))"
    if ngram_max >= 2:
        return (f"(SELECT list_concat(tk, [tk[i] || ' ' || tk[i + 1] FOR i IN range(1, len(tk))]) "
                f"FROM (SELECT {toks} AS tk))")
    return toks
