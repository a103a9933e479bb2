"""Helpers shared by the operators: tables, ASCII words, saved intermediates,
hot-group splitting and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder shared by all executors and read it back:
    later steps start from files, so a lost executor costs no recomputation. The
    files go when the driver ends."""
    path = scratch_path(df.sparkSession, "tables")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else: ``lower`` does it for an all-ASCII text
    (as many bytes as characters); other texts are translated."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def learn_split(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (0: held out, never learned from)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def split_hot(rows: DataFrame, key: str, member: str, cap: int) -> DataFrame:
    """Deal the members of each ``key`` into cells of at most about ``2 * cap``
    rows so that any two members of a key meet in at least one cell.

    Keys of up to ``cap`` members are one cell. A larger key's members are
    hashed into g = ceil(n / cap) blocks, and each block travels to the g cells
    that pair it with every block, its own included: no pair is lost, no task
    holds a whole hot key. Adds ``block``, ``cell_i`` and ``cell_j``."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    big = save(sizes.where(F.col("members") > cap)
               .select(key, F.ceil(F.col("members") / cap).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    return (rows.join(big, key, "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("cell_i", F.least("block", "other"))
            .withColumn("cell_j", F.greatest("block", "other"))
            .drop("blocks", "other"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the graph with ``edges`` (a, b: long).

    Returns (node, component) for every node that has an edge; ``component``
    is the smallest node of its component. Alternates large-star and small-star
    steps until every node points at its minimum; each round is two grouped
    minima and two joins, saved as files, and the driver sees only a count and
    a checksum of the edges."""
    edges = save(edges.where("a <> b")
                 .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.join(low, "x").where("y > x")
                 .select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = save(small)
        now = edges.agg(F.count(F.lit(1)),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
            .distinct())
