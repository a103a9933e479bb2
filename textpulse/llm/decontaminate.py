"""Benchmark decontamination: prefix-filtered set join, verified exactly.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.
A window is ``window`` consecutive words of an item; an item with fewer words,
but not none, is one window. A document contains a window only if it contains
every shingle (``shingle`` words) of it, so at a threshold of whole containment
one prefix token of the window's shingles, ordered by rarity, is necessary:
the rarest. Plan:

1. Windows of the benchmark, each distinct word sequence once, and their
   shingles with offsets.
2. One pass over the documents explodes shingle positions and keeps those whose
   shingle (by hash) occurs in the benchmark: numbers only, no words.
3. Rarity is the count of a shingle over all documents. Each window keeps its
   rarest shingle (ties: smallest offset) as its prefix; documents join on it.
4. Length and positional bounds: the window must fit between the document's
   ends at the prefix's offset. The places left go back to their texts, which are
   read once more, and the words there are compared with the window's, so
   neither hashes nor prefixes decide anything.

The benchmark's shingles are a saved table: Spark broadcasts it where its files
are below spark.sql.autoBroadcastJoinThreshold and shuffles it otherwise; then
ids, places and hashes of shingles are all that it shuffles of a document, and
a text travels once, if windows may occur in it.

Defined results: a null or wordless text has no words, no hits and the digest
of the empty string; wordless items match nothing; repeated items count once
per item_id; items with a null item_id have windows that hit but aren't named
or counted; equal rows of documents give equal rows; empty tables work; other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import ascii_lower, save

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _token(at: Column, array: str, length: Column | int, shingle: int) -> Column:
    """Hash of the ``length`` words from position ``at`` (0-based)."""
    if isinstance(length, int):
        return F.xxhash64(F.lit(length), *[F.get(array, at + i) for i in range(length)])
    out = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        out = F.when(length == n, _token(at, array, n, shingle)).otherwise(out)
    return out


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, seq): the distinct windows of each item."""
    rows = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item_id", "w", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at"))
    return rows.select("item_id", F.slice("w", F.col("at"), window).alias("seq")).distinct()


def window_hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, start, length, item_id): each occurrence of a window
    of an item in a document; start counts words from 0."""
    owners = save(item_windows(items, window).withColumn("window_id", F.xxhash64("seq")))
    wins = owners.select("window_id", "seq").distinct()
    n = F.size("seq")
    shingles = save(
        wins.withColumn("k", F.least(n, F.lit(shingle)))
        .select("window_id", "seq", "k", F.explode(F.sequence(F.lit(0), n - F.col("k"))).alias("shift"))
        .select("window_id", "seq", "k", "shift",
                _token(F.col("shift"), "seq", F.col("k"), shingle).alias("token")))
    tokens = save(shingles.select("token", "k").distinct())
    lengths = sorted(r[0] for r in tokens.select("k").distinct().collect())  # at most `shingle` values
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = None
    for k in lengths:
        at = (rows.where(F.size("w") >= k)
              .select("doc_id", "text_hash", F.size("w").alias("n_words"), "w",
                      F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
              .select("doc_id", "text_hash", "n_words", "pos", _token(F.col("pos"), "w", k, shingle).alias("token"))
              .join(tokens.where(F.col("k") == k).select("token"), "token"))
        found = at if found is None else found.unionByName(at)
    if found is None:  # no item has a word
        ids = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (items, "item_id"))]
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {ids[0]}, text_hash long, start int, length int, item_id {ids[1]}")
    found = save(found)
    rarity = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    prefix = (shingles.join(rarity, "token")  # a shingle in no document: the window is in none
              .groupBy("window_id", "seq")
              .agg(F.count(F.lit(1)).alias("present"),
                   F.min(F.struct("n", "shift", "token", "k")).alias("p"))
              .where(F.col("present") == F.size("seq") - F.col("p.k") + 1)
              .select("window_id", "seq", F.col("p.shift").alias("shift"), F.col("p.token").alias("token")))
    start, length = F.col("pos") - F.col("shift"), F.col("length")
    spots = save(found.join(save(prefix.select("token", "shift", F.size("seq").alias("length")).distinct()), "token")
                 .where((start >= 0) & (start + length <= F.col("n_words")))
                 .groupBy(F.col("doc_id").alias("spot_id"), F.col("text_hash").alias("spot_hash"))
                 .agg(F.collect_set(F.struct(start.alias("start"), "length")).alias("spots")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    hits = (texts.join(spots, F.col("doc_id").eqNullSafe(F.col("spot_id"))
                       & (F.col("text_hash") == F.col("spot_hash")))
            .select("doc_id", "text_hash", words(F.col("text")).alias("w"), "spots")  # words once a text
            .select("doc_id", "text_hash", "w", F.explode("spots").alias("spot"))
            .select("doc_id", "text_hash", "spot.start", "spot.length",
                    F.slice("w", F.col("spot.start") + 1, F.col("spot.length")).alias("seq")))
    hits = hits.withColumn("window_id", F.xxhash64("seq"))
    return hits.join(owners, ["window_id", "seq"]).select(
        "doc_id", "text_hash", "start", "length", "item_id")


def _covered(spans: Column) -> Column:
    """Number of words under the sorted spans (start, length)."""
    def step(acc: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(span["start"], acc["end"]), F.lit(0)))
                        .alias("n"), F.greatest(end, acc["end"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: row (struct of all its columns), n_words, n_hit,
    n_items, items (sorted item ids as strings) and contaminated."""
    hits = save(window_hits(docs.select("doc_id", "text"), items.select("item_id", "text"), window, shingle))
    per_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = per_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
                             _covered(F.col("spans")).alias("n_hit"), "items")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_hash"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(per_doc, F.col("row.doc_id").eqNullSafe(F.col("hit_id"))
                     & (F.col("text_hash") == F.col("hit_hash")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"),
                       (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate(docs.select("doc_id", "text"), items)
    return out.select("row.doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                      "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, k.item_id FROM dwin d JOIN wins k ON d.win = k.win AND d.n = k.n),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit,
       coalesce(named.n_items, 0) AS n_items, sha256(coalesce(named.items, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN named ON dw.doc_id = named.doc_id
"""
