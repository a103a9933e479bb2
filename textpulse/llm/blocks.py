"""Sparse products of rows with a table of keys that no task holds whole.

A task deals its rows into blocks. A row is a sparse vector (key, weight); its
block numbers the distinct keys of its rows and sums what the keys need. A block
is closed when it has ``MAX_KEYS`` keys, so a task's memory is bounded whatever
its input, and a key travels once a block however many rows hold it. The block's
keys are joined with the values that all blocks together give them, meet the
block's vectors again, and every row gets its sums of weight * value. Vectors are
shuffled once, by block; nothing is broadcast, and no key has more rows than
there are blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import partitions

MAX_KEYS = 400_000


class Block:
    """Keys (64-bit numbers) of a block, numbered by first use, with ``sums``
    totals each."""

    def __init__(self, sums: int, serial: int = 0):
        self.id = (TaskContext.get().partitionId() << 32) + serial
        self.serial, self.numbers = serial, {}
        self.sums = [[] for _ in range(sums)]

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of distinct keys."""
        known, get = self.numbers, self.numbers.get
        out = [get(k, -1) for k in keys.tolist()]
        for at, n in enumerate(out):
            if n < 0:
                out[at] = known.setdefault(int(keys[at]), len(known))
        return np.array(out, np.int64)

    def add(self, sum_: int, numbers: np.ndarray, amounts: np.ndarray) -> None:
        self.sums[sum_].append((numbers, amounts))

    def full(self) -> bool:
        return len(self.numbers) >= MAX_KEYS

    def keys(self) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(self.numbers)
        totals = []
        for parts in self.sums:
            total = np.zeros(n, np.int64)
            for numbers, amounts in parts:
                np.add.at(total, numbers, amounts)
            totals.append(total)
        return np.fromiter(self.numbers, np.int64, n), totals


def vectors(owner: np.ndarray, number: np.ndarray, weight: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, number, summed weight) of the distinct pairs, sorted."""
    if not len(owner):
        return owner, number, np.zeros(0, np.int64)
    width = int(number.max()) + 1
    joint = owner * width + number
    if weight is None:
        joint, sums = np.unique(joint, return_counts=True)
    else:
        order = np.argsort(joint, kind="stable")
        joint = joint[order]
        head = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1])))
        joint, sums = joint[head], np.add.reduceat(weight[order], head)
    return joint // width, joint % width, sums


def pack(number: np.ndarray, weight: np.ndarray) -> bytes:
    """A sparse vector: sorted key numbers as steps, then the weights."""
    return np.concatenate((np.diff(number, prepend=0), weight)).astype("<u4").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _sums(carried: int, kinds: list[str], names: list[str]):
    types = [np.int64 if k == "bigint" else np.float64 for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, values = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            is_row = batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            keep, found = [], [[] for _ in types]
            for a, b in zip(edges[:-1], edges[1:]):
                if blocks[a] != block:
                    block, parts, values = blocks[a], [], None
                part = batch.slice(a, b - a)
                if not is_row[a]:
                    parts.append([part.column(3 + carried + 1 + k).to_numpy(zero_copy_only=False).astype(t)
                                  for k, t in enumerate(types)])
                    continue
                if values is None:
                    values = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
                              for k, t in enumerate(types)]
                keep.append(part)
                for raw in part.column(3 + carried).to_pylist():
                    number, weight = unpack(raw or b"")
                    for k, v in enumerate(values):
                        found[k].append((v[number] * weight).sum() if len(number) else 0)
            if keep:
                rows = pa.Table.from_batches(keep)
                out = [rows.column(3 + k).combine_chunks() for k in range(carried)]
                out = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out]
                out += [pa.array(np.array(f, t)) for f, t in zip(found, types)]
                yield pa.RecordBatch.from_arrays(out, names)
    return run


def products(rows: DataFrame, keys: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` (block, items, any other columns) and ``keys`` (block, idx,
    ``values``: long or double) with every key of a block once. Returns the other
    columns of ``rows`` and, under the names of the values, each row's sum of
    weight * value."""
    spark = rows.sparkSession
    carried = [c for c in rows.columns if c not in ("block", "items")]
    kind = dict(keys.dtypes)
    left = rows.select("block", F.lit(True).alias("is_row"), F.lit(None).cast("int").alias("idx"), *carried, "items",
                       *[F.lit(None).cast(kind[v]).alias(v) for v in values])
    types = dict(rows.dtypes)
    right = keys.select("block", F.lit(False).alias("is_row"), "idx",
                        *[F.lit(None).cast(types[c]).alias(c) for c in carried],
                        F.lit(None).cast("binary").alias("items"), *values)
    dealt = (left.unionByName(right).repartition(partitions(spark), "block")
             .sortWithinPartitions("block", "is_row", "idx"))
    schema = ", ".join([f"`{c}` {types[c]}" for c in carried] + [f"`{v}` {kind[v]}" for v in values])
    return dealt.mapInArrow(_sums(len(carried), [kind[v] for v in values], [*carried, *values]), schema)
