"""Sampling, splitting and dataset-level queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from textpulse.functions.text import clean_text, sql_clean
from textpulse.operators import sampling as S
from textpulse.plans.catalog import register
from textpulse.plans.sqltext import view
from textpulse.sources.fingerprint import file_fingerprints, fingerprint, sql_fingerprint
from textpulse.session import scratch_path
from textpulse.sources.sinks import write_splits
from textpulse.sources.tables import reviews, table

H = S.sql_hash_key("doc_id")

def split_sql(src: str) -> str:
    """CTEs ending in ``sp`` = ``src`` columns + ``split`` (quota per class, hash order)."""
    return f"""
k AS (SELECT *, {H} AS h FROM {src}),
cc AS (SELECT sentiment, count(*) AS nc FROM k GROUP BY sentiment),
tot AS (SELECT sum(nc) AS n, CAST(ceil(0.2 * sum(nc)) AS BIGINT) AS nt FROM cc),
b AS (SELECT sentiment, (CAST(nt AS HUGEINT) * nc) // n AS base, (CAST(nt AS HUGEINT) * nc) % n AS rem, nt
      FROM cc, tot),
q AS (SELECT sentiment, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(sentiment AS VARCHAR))
                                     <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
sp AS (SELECT k.* EXCLUDE (h),
         CASE WHEN row_number() OVER (PARTITION BY k.sentiment ORDER BY k.h, k.doc_id) <= q.quota
              THEN 'test' ELSE 'train' END AS split
       FROM k JOIN q ON k.sentiment = q.sentiment)"""


RAW_SPLIT_SQL = split_sql(f"(SELECT doc_id, text, sentiment FROM {view('reviews')})")


def split_reviews(spark, sf):
    rv = reviews(spark, sf).select("doc_id", "text", "sentiment")
    return S.stratified_split(rv, "sentiment", "doc_id")


@register("stratified_split", f"WITH {RAW_SPLIT_SQL} SELECT doc_id, sentiment, split FROM sp")
def stratified_split(spark, sf):
    """80/20 stratified split of the labelled reviews, seed 42."""
    return split_reviews(spark, sf).select("doc_id", "sentiment", "split")


@register("split_class_counts", f"""WITH {RAW_SPLIT_SQL}
SELECT split, sentiment, CAST(count(*) AS BIGINT) AS n FROM sp GROUP BY split, sentiment""")
def split_class_counts(spark, sf):
    """C1 + C4: class counts per split (shares preserved)."""
    return split_reviews(spark, sf).groupBy("split", "sentiment").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


_CLEAN_RV = (f"(SELECT doc_id, sentiment, {sql_clean('text')} AS cleaned_text FROM {view('reviews')})")


@register("split_quality_gate", f"""WITH {split_sql(_CLEAN_RV)},
s AS (SELECT count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'test') AS te,
             count(*) FILTER (WHERE length(cleaned_text) = 0) AS em,
             count(DISTINCT sentiment) FILTER (WHERE split = 'train') AS cl FROM sp)
SELECT 'train_rows' AS "check", tr > 100 AS passed, CAST(tr AS VARCHAR) AS detail FROM s
UNION ALL SELECT 'test_rows', te > 20, CAST(te AS VARCHAR) FROM s
UNION ALL SELECT 'no_empty_text', em = 0, CAST(em AS VARCHAR) FROM s
UNION ALL SELECT 'two_classes', cl >= 2, CAST(cl AS VARCHAR) FROM s""")
def split_quality_gate(spark, sf):
    """Quality gate over the split of the cleaned reviews."""
    rv = reviews(spark, sf).select("doc_id", "sentiment", clean_text("text").alias("cleaned_text"))
    return S.split_quality_gate(S.stratified_split(rv, "sentiment", "doc_id"), "cleaned_text", "sentiment")


@register("sample_documents", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {H}, doc_id) AS rn FROM documents)
WHERE rn <= 100""")
def sample_documents(spark, sf):
    """Seeded sample of 100 documents (the sample is the feature)."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.sample_rows(d, 100, "doc_id")


@register("cap_per_class", f"""
SELECT doc_id, sentiment FROM (SELECT doc_id, sentiment,
  row_number() OVER (PARTITION BY sentiment ORDER BY {H}, doc_id) AS rn FROM {view('reviews')}) WHERE rn <= 100""")
def cap_per_class(spark, sf):
    """At most 100 reviews per class (seeded)."""
    rv = reviews(spark, sf).select("doc_id", "sentiment")
    return S.cap_per_class(rv, "sentiment", "doc_id", cap=100)


@register("balanced_extract", f"""
SELECT doc_id, sentiment, {H} AS shuffle_key FROM (SELECT doc_id, sentiment,
  row_number() OVER (PARTITION BY sentiment ORDER BY doc_id) AS rn FROM {view('reviews')}) WHERE rn <= 100""")
def balanced_extract(spark, sf):
    """First 100 reviews of each class by id (sample size 200), seeded order key."""
    rv = reviews(spark, sf).select("doc_id", "sentiment")
    return S.balanced_extract(rv, "sentiment", "doc_id", sample_size=200)


@register("class_distribution", f"""
WITH c AS (SELECT sentiment, count(*) AS n FROM {view('reviews')} GROUP BY sentiment)
SELECT sentiment, CAST(n AS BIGINT) AS n, round(n / (SELECT sum(n) FROM c), 6) AS share,
       CAST((SELECT count(*) FROM c) AS BIGINT) AS n_classes FROM c""")
def class_distribution(spark, sf):
    """C4: class counts, shares and number of classes of the reviews."""
    d = S.class_distribution(reviews(spark, sf), "sentiment")
    return d.withColumn("share", F.round("share", 6))


@register("head_documents", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def head_documents(spark, sf):
    """A3: first 50 documents by id (top-k)."""
    return S.head_rows(table(spark, sf, "documents").select("doc_id", "lang"), 50, "doc_id")


@register("shuffled_documents", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {H}, doc_id) AS BIGINT) AS position FROM documents""")
def shuffled_documents(spark, sf):
    """Documents written in seeded hash order, read back with their place in
    the files (rows before the file + row in the file)."""
    path = scratch_path(spark, "shuffled")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    S.shuffled_write(table(spark, sf, "documents").select("doc_id"), path, "doc_id", n)
    back = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("_file"),
                                           F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = back.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return back.join(files, "_file").select("doc_id", (F.col("_before") + F.col("_row") + 1).alias("position"))


@register("split_write", f"""WITH {RAW_SPLIT_SQL}
SELECT split, CAST(count(*) AS BIGINT) AS n, 'written' AS first, 'skipped' AS second FROM sp GROUP BY split""")
def split_write(spark, sf):
    """A5: the split written once; a second write is skipped; what is there."""
    path = scratch_path(spark, "splits")
    sp = split_reviews(spark, sf)
    first, second = write_splits(sp, path), write_splits(sp, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(
        "split", "n", F.lit(first).alias("first"), F.lit(second).alias("second"))


_FINGERPRINTED = (
    ("documents", ["doc_id", "text", "lang", "source", "n_chars"], "text"),
    ("labels", ["doc_id", "quality", "toxic"], None),
    ("pages", ["page_id", "url", "html"], "html"),
    ("conversations", ["conv_id", "turn", "role", "text"], "text"))


@register("dataset_fingerprint", " UNION ALL ".join(sql_fingerprint(*t) for t in _FINGERPRINTED))
def dataset_fingerprint(spark, sf):
    """Order-independent fingerprint (rows, text chars, folded row hashes) per table."""
    return reduce(lambda a, b: a.unionByName(b), (
        fingerprint(table(spark, sf, name), name, cols, text) for name, cols, text in _FINGERPRINTED))


@register("file_fingerprints", " UNION ALL ".join(
    f"SELECT *, '{t[0]}.parquet' AS file FROM {sql_fingerprint(*t)}" for t in _FINGERPRINTED))
def file_fingerprints_query(spark, sf):
    """The fingerprint of each file of the tables (here one a table)."""
    parts = [file_fingerprints(spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet"), name, cols, text)
             for name, cols, text in _FINGERPRINTED]
    files = reduce(lambda a, b: a.unionByName(b), parts)
    return files.withColumn("file", F.substring_index("file", "/", -1))
