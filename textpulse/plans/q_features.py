"""TF-IDF and relational scoring queries (D2-D10, E2, E7) over cleaned reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions.text import clean_text, compute_once, sql_clean
from textpulse.operators import scoring as SC
from textpulse.operators import sampling as S
from textpulse.operators import tfidf as TF
from textpulse.plans.catalog import register
from textpulse.plans.q_sampling import split_sql
from textpulse.plans.sqltext import view
from textpulse.session import materialize
from textpulse.sources.tables import reviews

TOKS = TF.sql_terms("cleaned_text", ngram_max=1)  # unigram list; bigrams added below


def cleaned_reviews(spark, sf):
    """reviews -> cleaned text, empty rows dropped."""
    rv = reviews(spark, sf).select("doc_id", "sentiment", compute_once(clean_text("text")).alias("cleaned_text"))
    return rv.where(F.length("cleaned_text") > 0)


CLEAN_REVIEWS_SQL = (f"(SELECT * FROM (SELECT doc_id, sentiment, {sql_clean('text')} AS cleaned_text "
                     f"FROM {view('reviews')}) WHERE length(cleaned_text) > 0)")


def tf_sql(src: str, text: str = "cleaned_text", ngram_max: int = 2, stop: bool = True,
           lowercase: bool = True, accents: bool = False) -> str:
    toks = TF.sql_terms(text, ngram_max=1, stop_words=None if stop else (), lowercase=lowercase, accents=accents)
    bi = "list_concat(tk, [tk[i] || ' ' || tk[i + 1] FOR i IN range(1, len(tk))])" if ngram_max >= 2 else "tk"
    return f"""
t1 AS (SELECT doc_id, {toks} AS tk FROM {src}),
t2 AS (SELECT doc_id, unnest({bi}) AS term FROM t1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t2 GROUP BY ALL)"""


def vocab_sql(src: str, k: int) -> str:
    return f"""
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
top AS (SELECT * FROM st ORDER BY cf DESC, term LIMIT {k}),
voc AS (SELECT term, CAST(cf AS BIGINT) AS cf, CAST(df AS BIGINT) AS df,
               CAST(row_number() OVER (ORDER BY cf DESC, term) - 1 AS BIGINT) AS idx,
               ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf FROM top)"""


def _vocab_query(spark, sf, k, **term_args):
    docs, text = cleaned_reviews(spark, sf), "cleaned_text"
    if term_args.pop("raw", False):
        docs, text = reviews(spark, sf).select("doc_id", "text"), "text"
    v = TF.vocabulary(docs, text, k, **term_args)
    return v.select("term", "cf", "df", F.col("index").cast("bigint").alias("idx"),
                    F.round("idf", 6).alias("idf"))


@register("vocabulary", f"""WITH {tf_sql(CLEAN_REVIEWS_SQL)}, {vocab_sql(CLEAN_REVIEWS_SQL, 10000)}
SELECT term, cf, df, idx, round(idf, 6) AS idf FROM voc""")
def vocabulary(spark, sf):
    """Top 10,000 uni+bigrams (stop words removed) with df and idf."""
    return _vocab_query(spark, sf, TF.DEFAULT_MAX_FEATURES)


@register("vocabulary_pruned", f"""WITH {tf_sql(CLEAN_REVIEWS_SQL)}, {vocab_sql(CLEAN_REVIEWS_SQL, 1000)}
SELECT term, cf, df, idx, round(idf, 6) AS idf FROM voc""")
def vocabulary_pruned(spark, sf):
    """The pruned 1,000-term vocabulary."""
    return _vocab_query(spark, sf, TF.PRUNED_MAX_FEATURES)


_RAW = f"(SELECT doc_id, text FROM {view('reviews')})"


@register("vocabulary_accents", f"""WITH {tf_sql(_RAW, text='text', ngram_max=1, stop=False, accents=True)},
{vocab_sql(_RAW, 5000)} SELECT term, cf, df, idx, round(idf, 6) AS idf FROM voc""")
def vocabulary_accents(spark, sf):
    """Accents stripped from raw text before tokenizing."""
    return _vocab_query(spark, sf, TF.RETRAIN_MAX_FEATURES, ngram_max=1, stop_words=(), accents=True, raw=True)


@register("vocabulary_retrain", f"""WITH {tf_sql(_RAW, text='text', ngram_max=1, stop=False)},
{vocab_sql(_RAW, 5000)} SELECT term, cf, df, idx, round(idf, 6) AS idf FROM voc""")
def vocabulary_retrain(spark, sf):
    """Retrain variant - unigrams, 5,000 terms, no stop words, raw text."""
    return _vocab_query(spark, sf, TF.RETRAIN_MAX_FEATURES, ngram_max=1, stop_words=(), raw=True)


@register("tfidf_weights", f"""WITH {tf_sql(CLEAN_REVIEWS_SQL)}, {vocab_sql(CLEAN_REVIEWS_SQL, 10000)},
w AS (SELECT tf.doc_id, tf.term, tf.tf * voc.idf AS w FROM tf JOIN voc ON tf.term = voc.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf):
    """L2-normalized TF-IDF cells of every cleaned review."""
    docs = cleaned_reviews(spark, sf)
    cells = TF.tfidf(docs, "cleaned_text", TF.vocabulary(docs, "cleaned_text"), ["doc_id"])
    return cells.select("doc_id", "term", F.round("weight", 6).alias("weight"))


_SPLIT_CLEAN = split_sql(CLEAN_REVIEWS_SQL)


@register("class_weights", f"""WITH {_SPLIT_CLEAN},
c AS (SELECT sentiment, count(*) AS n FROM sp WHERE split = 'train' GROUP BY sentiment)
SELECT sentiment, CAST(n AS BIGINT) AS n,
       round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def class_weights(spark, sf):
    """Balanced class weights n / (k * n_c) on the training split."""
    train = split_clean(spark, sf).where(F.col("split") == "train")
    return SC.balanced_weights(train, "sentiment").select(
        "sentiment", "n", F.round("weight", 6).alias("weight"))


def split_clean(spark, sf):
    """Cleaned reviews with their split. The split is found from ids and labels
    alone; cleaned texts are neither shuffled nor written."""
    return S.stratified_split(cleaned_reviews(spark, sf), "sentiment", "doc_id")


def split_frames(spark, sf):
    """Training and test rows; what a job reads several times is cleaned and
    written once, before the split."""
    sp = S.stratified_split(materialize(cleaned_reviews(spark, sf)), "sentiment", "doc_id")
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


_NB_SQL = f"""WITH {_SPLIT_CLEAN},
tr AS (SELECT doc_id, sentiment, cleaned_text FROM sp WHERE split = 'train'),
te AS (SELECT doc_id, sentiment, cleaned_text FROM sp WHERE split = 'test'),
{tf_sql('tr')}, {vocab_sql('tr', 10000)},
np AS (SELECT count(*) FILTER (WHERE sentiment = 1) AS n_pos, count(*) FILTER (WHERE sentiment = 0) AS n_neg FROM tr),
pd AS (SELECT tf.term, count(*) FILTER (WHERE tr.sentiment = 1) AS pos_df,
              count(*) FILTER (WHERE tr.sentiment = 0) AS neg_df
       FROM tf JOIN tr ON tf.doc_id = tr.doc_id GROUP BY tf.term),
coef AS (SELECT voc.term, voc.idf, ln((coalesce(pos_df, 0) + 1.0) / (n_pos + 2.0))
                                  - ln((coalesce(neg_df, 0) + 1.0) / (n_neg + 2.0)) AS c
         FROM voc LEFT JOIN pd ON voc.term = pd.term, np),
e1 AS (SELECT doc_id, {TF.sql_terms('cleaned_text', ngram_max=1)} AS tk FROM te),
e2 AS (SELECT doc_id, unnest(list_concat(tk, [tk[i] || ' ' || tk[i + 1] FOR i IN range(1, len(tk))])) AS term FROM e1),
etf AS (SELECT doc_id, term, count(*) AS tf FROM e2 GROUP BY ALL),
ew AS (SELECT etf.doc_id, etf.tf * coef.idf AS w, coef.c FROM etf JOIN coef ON etf.term = coef.term),
en AS (SELECT doc_id, sum(w * c) / sqrt(sum(w * w)) AS s FROM ew GROUP BY doc_id),
sc AS (SELECT te.doc_id, te.sentiment, coalesce(en.s, 0.0) + (SELECT ln(n_pos / n_neg) FROM np) AS z
       FROM te LEFT JOIN en ON te.doc_id = en.doc_id)"""


def nb_scores(spark, sf):
    train, test = split_frames(spark, sf)
    vocab = TF.vocabulary(train, "cleaned_text", label_col="sentiment")
    weights, intercept = SC.log_count_ratio_weights(vocab)
    cells = TF.tfidf(test, "cleaned_text", vocab, ["doc_id"])
    return SC.linear_scores(test.select("doc_id", "sentiment"), cells, weights, intercept, "doc_id")


@register("linear_scores", _NB_SQL + """
SELECT doc_id, sentiment, round(z, 6) AS score, round(1 / (1 + exp(-z)), 6) AS probability,
       CASE WHEN 1 / (1 + exp(-z)) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sc""")
def linear_scores(spark, sf):
    """Relational linear scoring of the test split: TF-IDF cells joined
    with a broadcast weight table, summed per document, sigmoid."""
    s = nb_scores(spark, sf)
    return s.select("doc_id", "sentiment", F.round("score", 6).alias("score"),
                    F.round("probability", 6).alias("probability"), "prediction")


@register("linear_score_evaluation", _NB_SQL + """,
pr AS (SELECT sentiment, CASE WHEN 1 / (1 + exp(-z)) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sc)
SELECT round(avg(CASE WHEN sentiment = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS samples FROM pr""")
def linear_score_evaluation(spark, sf):
    """E7 + F1: accuracy of the relational scorer on the test split."""
    s = nb_scores(spark, sf)
    ok = F.when(F.col("sentiment") == F.col("prediction"), 1.0).otherwise(0.0)
    return s.agg(F.round(F.avg(ok), 6).alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("samples"))
