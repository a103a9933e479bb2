"""Line dedup: lines found in many documents go, except in one of them.

Every text is split at newlines; a line's key is the line stripped of ASCII
white space at both ends and with A-Z lower-cased. Keys are exploded as 128-bit
hashes, the distinct documents of each hash are counted (first by hash and
document, then by hash, each combined before its shuffle, so that a line shared
by a third of all documents loads no single task), and the positions of the
lines to drop are joined to the texts by document, which move once.

Defined results: a null text is one empty line; a line's repeats inside a
document count once; rows with the same doc_id are one document; a row with a
null doc_id is no document: it counts for nothing and loses nothing; an empty
table gives an empty table; other columns of the input may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import ascii_lower, save

SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _exploded(docs: DataFrame, min_length: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # a shorter line can't have a longer key
    keys = (lines.where(F.length("line") >= min_length)
            .withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE))))
            .where(F.length("key") >= min_length))
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
                       F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, gone): sorted positions of the lines that go."""
    common = (_exploded(docs, min_length).groupBy("h1", "h2")
              .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
              .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))
    hits = _exploded(docs, min_length).join(save(common), ["h1", "h2"]).where("doc_id <> keeper")
    return (hits.groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_set("pos")).alias("gone")))


def line_dedup(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """Per row of ``docs``: row (struct of all its columns), n_lines, n_dropped
    and kept (the remaining lines joined by newlines)."""
    gone = dropped_positions(docs.select("doc_id", "text"), min_length, min_docs)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(gone, (F.col("row.doc_id") == F.col("gone_id"))
                     & (F.col("text_hash") == F.col("gone_hash")), "left")
    rows = rows.withColumn("lines", _lines(F.col("row.text")))
    # what lies between two neighbouring dropped lines stays: slices, in order
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")),
                       lambda i: F.slice("lines", cuts[i] + 2, cuts[i + 1] - cuts[i] - 1))
    kept = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))) \
        .otherwise(F.array_join(F.flatten(runs), "\n"))
    return rows.select("row", F.size("lines").cast("long").alias("n_lines"),
                       F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
                       kept.alias("kept"))


def digest(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(docs.select("doc_id", "text"), min_length, min_docs)
    return out.select("row.doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) t),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.key IS NOT NULL AND l.doc_id <> c.keeper) AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
