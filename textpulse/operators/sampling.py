"""Deterministic sampling and splitting.

Random draws of other libraries cannot be reproduced; what is kept is:
disjoint, complete, class shares preserved, deterministic. Rows are ordered by
a seeded hash of their id (or by any bigint key), and a row is selected iff
its rank inside its group is within the group's quota.

Exact ranks inside a group would need the whole group in one task. Instead
(``select_by_rank``) the key at the quota's rank is found per group by radix
selection over narrow columns (``ordered.rank_threshold``), and a row is
selected iff its (key, id) is not above it: one comparison per row against one
row per group, so texts are never shuffled or ranked. Rows that repeat an id
are selected together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach

from textpulse.operators.ordered import rank_threshold, running_total
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2
DEFAULT_MAX_PER_CLASS = 30_000
DEFAULT_BALANCED_SAMPLE = 5_000
# ---------------------------------------------------------------------------


def hash_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    """60-bit non-negative bigint: first 15 hex digits of md5('<seed>:<id>')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string"))), 1, 15)
    return F.conv(hexed, 16, 10).cast("bigint")


def sql_hash_key(id_expr: str, seed: int = DEFAULT_SEED) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR)), 1, 15) AS BIGINT)"


def select_by_rank(df: DataFrame, group_cols: Sequence[str], key: Column, id_col: str,
                   quotas_of: Callable[[DataFrame], DataFrame], out_col: str = "selected") -> DataFrame:
    """Add boolean ``out_col``: the row's rank by (key, id) inside its group is
    within its group's quota (``quotas_of`` the group sizes ``(group cols, _rows)``:
    ``(group cols, quota)``, one row per group; missing group = nothing selected).
    Of rows that share the (key, id) at the quota's rank, as many are selected as
    the quota leaves. ``df`` is read once for the narrow rows and once for the
    result (twice, if such rows are to be told apart); no task ever holds a whole
    group."""
    g = list(group_cols)
    keyed = df.withColumn("_k", key)
    narrow = materialize(keyed.select(*dict.fromkeys([*g, "_k", id_col])))
    seen = Observation()
    cut = materialize(rank_threshold(narrow, g, "_k", id_col, quotas_of).observe(  # one row a group
        seen, F.count(F.when(F.col("cut_take") < F.col("cut_rows"), 1)).alias("torn")))
    names = ("cut_key", "cut_id", "cut_rows", "cut_take")
    if g:
        cut = cut.select(*[F.col(c).alias(f"_o_{c}") for c in g], *names)
        same = [keyed[c].eqNullSafe(cut[f"_o_{c}"]) for c in g]
        j = keyed.join(cut, reduce(lambda a, b: a & b, same), "left")
    else:
        j = attach(keyed, cut.agg(*[F.max(c).alias(c) for c in names]))
    at_key = F.col("_k") == F.col("cut_key")
    before = F.col(id_col).isNull() & F.col("cut_id").isNotNull() | F.coalesce(F.col(id_col) < F.col("cut_id"), F.lit(False))
    equal = at_key & F.col(id_col).eqNullSafe(F.col("cut_id"))
    below = (F.col("_k") < F.col("cut_key")) | (at_key & before) | equal
    flag = F.coalesce(below, F.lit(False)).alias(out_col)
    if not seen.get["torn"]:
        return j.select(*df.columns, flag)
    torn = F.coalesce(equal & (F.col("cut_take") < F.col("cut_rows")), F.lit(False))
    rest = j.where(~torn).select(*df.columns, flag)
    # equal rows are counted, ordered by a hash of all columns, and written out again
    kinds = j.where(torn).groupBy(*df.columns, "cut_take").agg(F.count(F.lit(1)).alias("_n"))
    kinds = running_total(kinds.withColumn("_x", F.xxhash64(*df.columns)), g, "_x", ["_n"])
    take = F.least("_n", F.greatest(F.lit(0), F.col("cut_take") - (F.col("_n_cum") - F.col("_n")))).cast("int")
    flags = F.concat(F.array_repeat(F.lit(True), take), F.array_repeat(F.lit(False), F.col("_n").cast("int") - take))
    return rest.unionByName(kinds.select(*df.columns, F.explode(flags).alias(out_col)))


def stratified_quotas(sizes: DataFrame, label_col: str, test_size: float = DEFAULT_TEST_SIZE) -> DataFrame:
    """Per-class test quota from the class sizes ``(label, _rows)``: n_test =
    ceil(test_size * n); floor(n_test * n_c / n) seats each, remaining seats by
    largest remainder, ties by label text."""
    cc = sizes.select(label_col, F.col("_rows").alias("nc"))
    tot = cc.agg(F.sum("nc").alias("n")).select(
        "n", F.ceil(F.lit(test_size) * F.col("n")).cast("bigint").alias("nt"))
    b = attach(cc, tot)
    prod = F.col("nt").cast("decimal(38,0)") * F.col("nc").cast("decimal(38,0)")
    b = b.select(label_col, "nc", "nt", F.expr("0").alias("_z"),
                 (prod - (prod % F.col("n"))).alias("_p"), (prod % F.col("n")).alias("rem"), "n")
    b = b.withColumn("base", (F.col("_p") / F.col("n")).cast("bigint"))
    w_all = Window.partitionBy("_z")
    w_rank = Window.partitionBy("_z").orderBy(F.desc("rem"), F.col(label_col).cast("string"))
    extra = F.when(F.row_number().over(w_rank) <= F.col("nt") - F.sum("base").over(w_all), 1).otherwise(0)
    return b.select(label_col, (F.col("base") + extra).cast("bigint").alias("quota"))


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``split`` = 'test' / 'train' (quota per class, hash order)."""
    s = select_by_rank(df, [label_col], hash_key(id_col, seed), id_col,
                       lambda sizes: stratified_quotas(sizes, label_col, test_size), "_test")
    return s.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def _at_most(n: int, *group_cols: str) -> Callable[[DataFrame], DataFrame]:
    return lambda sizes: sizes.select(*group_cols, F.least("_rows", F.lit(n)).alias("quota"))


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """min(n, rows) rows, the same rows for the same seed."""
    return select_by_rank(df, [], hash_key(id_col, seed), id_col, _at_most(n), "_s").where("_s").drop("_s")


def cap_per_class(df: DataFrame, label_col: str, id_col: str, cap: int = DEFAULT_MAX_PER_CLASS,
                  seed: int = DEFAULT_SEED, order_col: str | None = None) -> DataFrame:
    """At most ``cap`` rows of each class, in seeded hash order of
    ``order_col`` (the id, if none is named) and then of the id."""
    return select_by_rank(df, [label_col], hash_key(order_col or id_col, seed), id_col, _at_most(cap, label_col), "_s") \
        .where("_s").drop("_s")


def balanced_extract(df: DataFrame, label_col: str, id_col: str, sample_size: int = DEFAULT_BALANCED_SAMPLE,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """The first k = max(sample_size // 2, 1) rows of each class by id,
    with their seeded hash order (column ``shuffle_key``)."""
    k = max(sample_size // 2, 1)
    s = select_by_rank(df, [label_col], F.col(id_col).cast("bigint"), id_col, _at_most(k, label_col), "_s")
    return s.where("_s").drop("_s").withColumn("shuffle_key", hash_key(id_col, seed))


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """C4: ``(label, n, share)`` and the number of distinct classes."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("n_classes"))
    return attach(c, tot).select(
        label_col, F.col("n").cast("bigint").alias("n"), (F.col("n") / F.col("t")).alias("share"),
        F.col("n_classes").cast("bigint").alias("n_classes"))


def head_rows(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """A3: the first n rows in ``order_col`` order (top-k)."""
    return df.orderBy(order_col).limit(n)


def shuffled_write(df: DataFrame, path: str, id_col: str, partitions: int,
                   seed: int = DEFAULT_SEED) -> None:
    """Write all rows in one seeded hash order: file after file, row after
    row (range partitions of the hash, each sorted)."""
    out = df.withColumn("_h", hash_key(id_col, seed)).repartitionByRange(partitions, "_h", id_col)
    out.sortWithinPartitions("_h", id_col).drop("_h").write.mode("overwrite").parquet(path)


def split_quality_gate(split_df: DataFrame, text_col: str, label_col: str,
                       min_train: int = 100, min_test: int = 20) -> DataFrame:
    """Data-quality checks on a split table as ``(check, passed, detail)``;
    a missing column is an error."""
    missing = [c for c in ("split", text_col, label_col) if c not in split_df.columns]
    if missing:
        raise ValueError(f"the split table lacks {', '.join(missing)}")
    s = split_df.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train_rows"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_rows"),
        F.count(F.when(F.length(F.coalesce(F.col(text_col), F.lit(""))) == 0, 1)).alias("empty_texts"),
        F.countDistinct(F.when(F.col("split") == "train", F.col(label_col))).alias("train_classes"))
    checks = s.select(F.explode(F.array(
        F.struct(F.lit("train_rows").alias("check"), (F.col("train_rows") > min_train).alias("passed"),
                 F.col("train_rows").cast("string").alias("detail")),
        F.struct(F.lit("test_rows").alias("check"), (F.col("test_rows") > min_test).alias("passed"),
                 F.col("test_rows").cast("string").alias("detail")),
        F.struct(F.lit("no_empty_text").alias("check"), (F.col("empty_texts") == 0).alias("passed"),
                 F.col("empty_texts").cast("string").alias("detail")),
        F.struct(F.lit("two_classes").alias("check"), (F.col("train_classes") >= 2).alias("passed"),
                 F.col("train_classes").cast("string").alias("detail")))).alias("c"))
    return checks.select("c.*")
