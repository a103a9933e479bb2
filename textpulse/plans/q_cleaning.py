"""Cleaning, masking, validation and text-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse.functions import text as T
from textpulse.functions.validation import (sql_validate_request, validate_batches,
                                            validate_request)
from textpulse.plans.catalog import register
from textpulse.plans.sqltext import cleaned_docs
from textpulse.sources.tables import table


def cleaned_documents(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select("doc_id", "lang", "text", T.compute_once(T.clean_text("text")).alias("cleaned_text"))
    return c.where(F.length("cleaned_text") > 0)


@register("clean_documents", f"SELECT doc_id, cleaned_text FROM {cleaned_docs()}")
def clean_documents(spark, sf):
    """B2-B12 on documents.text: cleaned text, empty results dropped."""
    return cleaned_documents(spark, sf).select("doc_id", "cleaned_text")


@register("clean_pages", f"""
SELECT page_id, cleaned_text FROM (SELECT page_id, {T.sql_clean('html')} AS cleaned_text FROM pages)
WHERE length(cleaned_text) > 0""")
def clean_pages(spark, sf):
    """B11/B12 on raw HTML pages (tags, URLs, e-mails)."""
    p = table(spark, sf, "pages").select("page_id", T.compute_once(T.clean_text("html")).alias("cleaned_text"))
    return p.where(F.length("cleaned_text") > 0)


@register("clean_turns", f"""
SELECT conv_id, turn, cleaned_text FROM (SELECT conv_id, turn, {T.sql_clean('text')} AS cleaned_text
FROM conversations) WHERE length(cleaned_text) > 0""")
def clean_turns(spark, sf):
    """B11/B12 on conversation turns."""
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", T.compute_once(T.clean_text("text")).alias("cleaned_text"))
    return c.where(F.length("cleaned_text") > 0)


@register("clean_keep_case", f"""
SELECT doc_id, cleaned_text FROM (SELECT doc_id, {T.sql_clean('text', lowercase=False, remove_special=False)}
AS cleaned_text FROM documents) WHERE length(cleaned_text) > 0""")
def clean_keep_case(spark, sf):
    """B11 with lowercase and special-character removal switched off."""
    d = table(spark, sf, "documents").select(
        "doc_id", T.compute_once(T.clean_text("text", lowercase=False, remove_special=False))
        .alias("cleaned_text"))
    return d.where(F.length("cleaned_text") > 0)


@register("pii_masked", f"""
SELECT doc_id, masked FROM (SELECT doc_id, text,
  regexp_replace(regexp_replace(text, '{T.EMAIL_RE}', '{T.EMAIL_MASK}', 'g'), '{T.HANDLE_RE}', '{T.USER_MASK}', 'g')
  AS masked FROM documents) WHERE masked <> text""")
def pii_masked(spark, sf):
    """B2/B3 alone: documents whose text contained an e-mail or handle."""
    d = table(spark, sf, "documents").select("doc_id", "text", T.compute_once(T.mask_pii("text")).alias("masked"))
    return d.where(F.col("masked") != F.col("text")).select("doc_id", "masked")


@register("text_features", f"""
SELECT doc_id, {T.sql_char_length('text')} AS char_length, {T.sql_word_count('text')} AS word_count,
       round({T.sql_avg_word_length('text')}, 6) AS avg_word_length FROM documents""")
def text_features(spark, sf):
    """B18-B21 on raw document text."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.char_length("text").alias("char_length"),
                    T.word_count("text").alias("word_count"),
                    F.round(T.avg_word_length("text"), 6).alias("avg_word_length"))


@register("request_validation", f"""
SELECT doc_id, {sql_validate_request('text')} AS reject_reason,
       CAST(length(regexp_replace(coalesce(text, ''), '^[{T.WS_SET}]+|[{T.WS_SET}]+$', '', 'g')) AS BIGINT)
         AS stripped_length
FROM documents""")
def request_validation(spark, sf):
    """Every document as a scoring request; reject_reason null = accepted."""
    d = table(spark, sf, "documents")
    v = validate_request(F.col("text"))
    return d.select("doc_id", v["reject_reason"].alias("reject_reason"),
                    F.length(v["stripped"]).cast("bigint").alias("stripped_length"))


@register("batch_validation", f"""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_texts,
       CAST(count(*) FILTER (WHERE {sql_validate_request('text', True)} IS NOT NULL) AS BIGINT) AS n_invalid,
       (count(*) BETWEEN 1 AND 128 AND count(*) FILTER (WHERE {sql_validate_request('text', True)} IS NOT NULL) = 0)
         AS accepted
FROM conversations GROUP BY conv_id""")
def batch_validation(spark, sf):
    """B17 batch form: each conversation is one batch request of its turns."""
    return validate_batches(table(spark, sf, "conversations"), "conv_id", "text")
