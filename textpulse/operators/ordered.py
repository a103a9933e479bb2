"""Order-dependent helpers that stay exact without sending a whole group to
one task.

Spark has no row order, and a window ``partitionBy(g).orderBy(v)`` runs each
group ``g`` in a single task. Here groups can be hot (a third of all rows in
one label or one feature), so ordered work is cut by position instead:

* running_total: exact prefix sums. Rows are range-partitioned by (group,
  value), so a large group spreads over many partitions however its values are
  distributed; each partition sums locally, the totals of partitions and groups
  (few rows) give the offsets.
* order_statistics: values at given 0-based ranks of a value-count table.
* rank_threshold: the key at a given rank of each group, by radix selection
  over key prefixes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textpulse.operators.scalars import attach
from textpulse.session import materialize

LEVEL_BITS = 16  # key bits that one radix level settles
FEW = 100_000  # rows of a group that one task may order


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of the columns of two frames."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_o_{c}"]) for c in columns])


def running_total(df: DataFrame, group_cols: Sequence[str], order_col: str,
                  weight_cols: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Add ``<w><suffix>``: inclusive running sum of each weight column per
    group in ascending ``order_col`` (unique within the group)."""
    g, ws = list(group_cols), list(weight_cols)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: range borders are sampled, so the partition of a row must be kept
    cut = materialize(df.repartitionByRange(n, *g, order_col).withColumn("_part", F.spark_partition_id()))
    keys = [*g, "_part"]
    totals = cut.groupBy(*keys).agg(*[F.sum(w).alias(f"_t_{w}") for w in ws])
    before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_o_{c}") for c in keys], *[
        F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in ws])
    here = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select("*", *[F.sum(w).over(here).alias(f"_loc_{w}") for w in ws])
    out = local.join(offsets, _same(local, offsets, keys))
    return out.select(*df.columns, *[(F.col(f"_loc_{w}") + F.col(f"_off_{w}")).alias(f"{w}{suffix}") for w in ws])


def order_statistics(value_counts: DataFrame, group_cols: Sequence[str], value_col: str,
                     count_col: str, targets: DataFrame, rank_col: str = "rank") -> DataFrame:
    """For each ``targets`` row (group cols + 0-based ``rank_col`` + any extra
    columns) return it with ``value``: the value at that rank of the multiset
    described by ``value_counts`` (group cols, value, count)."""
    g = list(group_cols)
    cum = running_total(value_counts, g, value_col, [count_col])
    cum = cum.select(*g, F.col(value_col).alias("_val"),
                     (F.col(f"{count_col}_cum") - F.col(count_col)).alias("_before"),
                     F.col(f"{count_col}_cum").alias("_upto"))
    # rename the target side so a shared lineage cannot make columns ambiguous
    t = targets.select(*[F.col(c).alias(f"_o_{c}") for c in targets.columns])
    within = (F.col(f"_o_{rank_col}") >= F.col("_before")) & (F.col(f"_o_{rank_col}") < F.col("_upto"))
    joined = cum.join(t, (_same(cum, t, g) & within) if g else within)
    return joined.select(*[F.col(f"_o_{c}").alias(c) for c in targets.columns], F.col("_val").alias("value"))


def rank_threshold(rows: DataFrame, group_cols: Sequence[str], key_col: str, id_col: str,
                   quotas: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per group with a quota ``(group cols, quota)``, given or made from the
    group sizes ``(group cols, _rows)``: ``(group cols, cut_key, cut_id, cut_rows,
    cut_take)`` such that ``quota`` rows (all, if there are fewer) are those with a
    smaller (key, id) and ``cut_take`` of the ``cut_rows`` that have this one;
    nothing for a quota of 0. Keys are bigints; null ids come first.

    Radix selection: group sizes and the bits that vary in a group's keys take one
    read; a count by the next ``LEVEL_BITS`` varying bits finds the bucket of the
    rank, every count being a combined aggregate of at most 2^LEVEL_BITS rows a
    group; further levels follow while a bucket has more than ``FEW`` rows. The
    bucket's distinct (key, id) are then ordered: three reads for keys that spread.
    ``rows`` is read once a step: pass a saved table of narrow rows."""
    g = list(group_cols)
    outer = [f"_o_{c}" for c in g]
    narrow = rows.select(*g, F.col(key_col).alias("_key"),
                         F.col(key_col).bitwiseXOR(F.lit(-1 << 63)).alias("_bits"), F.col(id_col).alias("_id"))
    size = materialize(narrow.groupBy(*g).agg(F.count(F.lit(1)).alias("_rows"), F.bit_and("_bits").alias("_all"),
                                              F.bit_or("_bits").alias("_any")))  # one row a group
    q = quotas(size.select(*g, "_rows")) if callable(quotas) else quotas
    q = q.select(*[F.col(c).alias(f"_o_{c}") for c in g], F.col("quota").cast("bigint").alias("_q"))
    sized = size.join(q, _same(size, q, g)) if g else attach(size, q)
    varying = F.col("_all").bitwiseXOR(F.col("_any"))
    bits = F.when(varying == 0, 0).when(varying < 0, 64).otherwise(F.length(F.bin(varying)))
    state = sized.where("_q > 0 AND _rows > 0").select(
        *[F.col(c).alias(f"_o_{c}") for c in g], F.least("_q", "_rows").alias("_need"),
        F.lit(None).cast("bigint").alias("_prefix"), F.lit(0).alias("_from"),
        F.greatest(F.lit(0), bits - LEVEL_BITS).cast("int").alias("_low"))

    def live() -> DataFrame:
        """The rows of the buckets found so far. Order-preserving bits: unsigned
        shifts of the key with its sign bit turned."""
        inside = F.col("_prefix").isNull() | (F.expr("shiftrightunsigned(_bits, _from)") == F.col("_prefix"))
        return narrow.join(state, _same(narrow, state, g) & inside) if g else attach(narrow, state).where(inside)

    while True:
        counts = live().groupBy(*outer, "_need", "_low", F.expr("shiftrightunsigned(_bits, _low)").alias("_next")).agg(
            F.count(F.lit(1)).alias("_n"))
        cum = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*outer).orderBy("_next")))
        seen = Observation()
        state = materialize(cum.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
                            .select(*outer, (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_need"),
                                    F.col("_next").alias("_prefix"), F.col("_low").alias("_from"),
                                    F.greatest(F.lit(0), F.col("_low") - LEVEL_BITS).alias("_low"), "_n")
                            .observe(seen, F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.max("_from").alias("open")))
        most = seen.get
        if most["n"] <= FEW or not most["open"]:
            break
    tied = live().groupBy(*outer, "_need", F.struct("_key", "_id").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    if most["n"] <= FEW:
        tied = tied.withColumn("_n_cum", F.sum("_n").over(Window.partitionBy(*outer).orderBy("_at")))
    else:
        tied = running_total(tied, outer, "_at", ["_n"])
    cut = tied.where((F.col("_n_cum") >= F.col("_need")) & (F.col("_n_cum") - F.col("_n") < F.col("_need")))
    return cut.select(*[F.col(f"_o_{c}").alias(c) for c in g], F.col("_at._key").alias("cut_key"),
                      F.col("_at._id").alias("cut_id"), F.col("_n").alias("cut_rows"),
                      (F.col("_need") - (F.col("_n_cum") - F.col("_n"))).alias("cut_take"))
