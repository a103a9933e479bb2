"""Dataset fingerprint and change detection.

A row's digest is the first 15 hex digits of md5 over its columns, each written
with its length before it (a null as a mark that no length can be), so that rows
that differ have different writings. Digests fold by XOR and by sum (a pair of
equal rows cancels in the XOR, not in the sum), with the number of rows and of
text characters: first by file, then the files' to the table's. The table's
fingerprint is independent of the order of rows and of their division into files;
the files' say which file has changed. Two snapshots are equal iff their
fingerprints are equal (up to hash collisions), so a stage re-runs only when its
input changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "-"
DIGEST = ("rows", "text_chars", "content_hash", "content_sum")


def row_hash(cols: Sequence[str]) -> Column:
    texts = [F.col(c).cast("string") for c in cols]
    written = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(NULL_MARK)) for t in texts])
    return F.conv(F.substring(F.md5(written), 1, 15), 16, 10).cast("bigint")


def _digest(rows: DataFrame, name: str, cols: Sequence[str], text_col: str | None, keys: Sequence[str]) -> DataFrame:
    chars = F.length(F.col(text_col)) if text_col else F.lit(0)
    rows = rows.select(*keys, row_hash(cols).alias("_h"), chars.alias("_c"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("text_chars"),
        F.bit_xor("_h").alias("content_hash"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("content_sum")) \
        .select(F.lit(name).alias("table_name"), *keys, *DIGEST)


def fingerprint(df: DataFrame, name: str, cols: Sequence[str], text_col: str | None) -> DataFrame:
    """The fingerprint of any rows: one row."""
    return _digest(df, name, cols, text_col, [])


def file_fingerprints(scan: DataFrame, name: str, cols: Sequence[str], text_col: str | None) -> DataFrame:
    """``(table_name, file, rows, text_chars, content_hash, content_sum)`` of a
    scan of files, one row per file that has rows; rows are hashed once and folded
    before the shuffle."""
    return _digest(scan.withColumn("file", F.col("_metadata.file_path")), name, cols, text_col, ["file"])


def fold(files: DataFrame, name: str) -> DataFrame:
    """The table's fingerprint from those of its files (no file: zero rows)."""
    return files.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
                     F.coalesce(F.sum("text_chars"), F.lit(0)).cast("bigint").alias("text_chars"),
                     F.bit_xor("content_hash").alias("content_hash"),
                     F.sum(F.col("content_sum").cast("decimal(38,0)")).cast("string").alias("content_sum")) \
        .select(F.lit(name).alias("table_name"), *DIGEST)


def sql_row_hash(cols: Sequence[str]) -> str:
    parts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '{NULL_MARK}')" for c in cols]
    return "'0x' || substr(md5(" + " || ".join(parts) + "), 1, 15)"


def sql_fingerprint(name: str, cols: Sequence[str], text_col: str | None) -> str:
    chars = f"coalesce(sum(length({text_col})), 0)" if text_col else "0"
    return (f"(SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS rows, CAST({chars} AS BIGINT) AS text_chars, "
            f"bit_xor(CAST({sql_row_hash(cols)} AS BIGINT)) AS content_hash, "
            f"CAST(sum(CAST({sql_row_hash(cols)} AS HUGEINT)) AS VARCHAR) AS content_sum FROM {name})")


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose fingerprint differs between two snapshots (re-run needed)."""
    keys = ["table_name", *DIGEST]
    same = [current[k].eqNullSafe(previous[k]) for k in keys]
    return current.join(previous, same, "left_anti").select("table_name")


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(table_name, file, change)`` of the files that are ``added``, ``removed``
    or ``changed`` between two snapshots of file fingerprints."""
    old = previous.select("table_name", "file", F.struct(*DIGEST).alias("_old"))
    new = current.select("table_name", "file", F.struct(*DIGEST).alias("_new"))
    both = old.join(new, ["table_name", "file"], "full_outer")
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "changed"))
    return both.select("table_name", "file", change.alias("change")).where(F.col("change").isNotNull())
