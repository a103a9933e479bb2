"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to ``8 * BLOCKS`` numbers in each of
``TABLES`` tables, shifted at random, and each eight are decoded to the nearest
point of the E8 lattice; the points of a table, hashed, are a vector's home
cell. A vector also goes to the ``PROBES`` neighbouring cells (one block moved
to one of the 240 nearest lattice points) that are next closest to it. Vectors
that meet in a cell are compared by cosine in double precision, so no pair
below the threshold is linked; pairs may be missed with small probability
(recall measured in the tests).

Equal vectors are one class with a size before anything is replicated. Cells
with many members are split (``split_hot``). A pair counts only in the first
cell that the two share, so links are counted without writing pairs: a cell
gives sums per class and a spanning forest of its links.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers, and rows with a null vec_id, link with nothing (a null vec_id has no
component and isn't kept); vectors of different lengths never link; rows with
the same vec_id are different vectors; an empty table gives an empty table;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import components, partitions, save, split_hot
from textpulse.llm.windows import mix

TABLES, BLOCKS, PROBES = 4, 2, 6
SCALE = 0.375  # spread of a unit vector's projections, in lattice units
CELL = 2048  # classes that are compared in one cell
ROWS_AT_ONCE = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i)
             for a, b in product((1, -1), repeat=2)]
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.round(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8 or of D8 moved by a half in each coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _hash(points: np.ndarray, table: int) -> np.ndarray:
    """32-bit hash of lattice points (twice their coordinates are whole)."""
    out = np.full(len(points), table + 1, np.uint64)
    for c in np.round(points * 2).astype(np.int64).view(np.uint64).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return (out >> np.uint64(32)).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Cell hashes of unit vectors, shaped (vectors, TABLES, 1 + PROBES)."""
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    for table in range(TABLES):
        rng = np.random.default_rng((seed, table, x.shape[1]))
        u = x @ (rng.standard_normal((x.shape[1], 8 * BLOCKS)) * SCALE) + rng.random(8 * BLOCKS) * 2
        home = np.concatenate([nearest_e8(u[:, 8 * b:8 * b + 8]) for b in range(BLOCKS)], axis=1)
        out[:, table, 0] = _hash(home, table)
        # how much farther each neighbour is than home
        rest = u - home
        more = np.concatenate([1 - rest[:, 8 * b:8 * b + 8] @ ROOTS.T for b in range(BLOCKS)], axis=1)
        best = np.argpartition(more, PROBES, axis=1)[:, :PROBES]
        for k in range(PROBES):
            moved = home.copy()
            at = (best[:, k] // 240 * 8)[:, None] + np.arange(8)
            np.put_along_axis(moved, at, np.take_along_axis(moved, at, 1) + ROOTS[best[:, k] % 240], 1)
            out[:, table, 1 + k] = _hash(moved, table)
    return out


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, size, embedding, dim) to a row for each cell, by length of vector."""
    for batch in batches:
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, ROWS_AT_ONCE):
                rows = part.slice(at, ROWS_AT_ONCE)
                found = cells(unit(_vectors(rows.column(2), rows.num_rows)))
                flat = found + (np.arange(TABLES, dtype=np.int64) << 32)[:, None] + (int(dim) << 40)
                flat = flat.reshape(rows.num_rows, -1)
                each = flat.shape[1]
                take = pa.array(np.repeat(np.arange(rows.num_rows), each))
                # 32 bits of each travel along: a key's table is told by its place
                small = pa.array(found.astype(np.uint32).view(np.int32).ravel())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * each), small)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.ravel()), rows.column(0).take(take), rows.column(1).take(take),
                     rows.column(2).take(take), keys.take(take)], ["cell", "class_id", "size", "embedding", "keys"])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that each pair shares: of the first table, the smallest; with
    its table above its 32 bits, as in a cell."""
    a, b = (k.reshape(len(k), TABLES, -1) for k in (a, b))
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    table = same.any(axis=2).argmax(axis=1)
    rows = np.arange(len(a))
    low = np.where(same[rows, table], a[rows, table].view(np.uint32).astype(np.int64), np.iinfo(np.int64).max).min(axis=1)
    return table.astype(np.int64) << 32 | low


def _links_of(cell: tuple, ids, sizes, blocks, x, keys, least: float):
    """Of one cell: per class the sizes of the classes linked with it that count
    here, and links that connect all that are linked."""
    # a class may be in a cell once only
    ids, first = np.unique(ids, return_index=True)
    sizes, blocks, x, keys = sizes[first], blocks[first], unit(x[first]), keys[first]
    total, parent, tree = np.zeros(len(ids), np.int64), list(range(len(ids))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    for at in range(0, len(ids), ROWS_AT_ONCE):
        linked = x[at:at + ROWS_AT_ONCE] @ x[at:].T >= least
        i, j = np.nonzero(np.triu(linked, 1))
        i, j = i + at, j + at
        if cell[1] != cell[2]:
            i, j = (v[blocks[i] != blocks[j]] for v in (i, j))
        for k in range(0, len(i), 1 << 16):
            a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            here = _first_shared(keys[a], keys[b]) == cell[0] & ((1 << 40) - 1)
            np.add.at(total, a[here], sizes[b[here]])
            np.add.at(total, b[here], sizes[a[here]])
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                tree.append((a, b))
    some = np.flatnonzero(total)
    tree = np.array(tree, np.int64).reshape(-1, 2)
    return ids[some], total[some], ids[tree[:, 0]], ids[tree[:, 1]]


def _compare(least: float):
    """Rows sorted by cell to (a, b, links): sums have a null b, links a zero sum."""
    def close(key: tuple, held: list) -> pa.RecordBatch | None:
        if sum(len(h[0]) for h in held) < 2:
            return None
        ids, total, a, b = _links_of(key, *(np.concatenate([h[i] for h in held]) for i in range(5)), least)
        if not len(ids) and not len(a):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids, a))), pa.array([None] * len(ids) + b.tolist(), pa.int64()),
             pa.array(np.concatenate((total, np.zeros(len(a), np.int64))))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            by = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cut = np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                now = tuple(by[:, s].tolist())
                if now != key:
                    if (out := close(key, held)) is not None:
                        yield out
                    key, held = now, []
                rows = batch.slice(s, e - s)
                held.append((rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy(),
                             _vectors(rows.column(6), e - s),
                             rows.column(7).flatten().to_numpy().reshape(e - s, -1)))
        if (out := close(key, held)) is not None:
            yield out
    return run


def embedding_links(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    spark = vectors.sparkSession
    good = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("embedding", lambda v: v != 0))
    rows = save(vectors.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good")))
    kind = rows.schema["embedding"].dataType.simpleString()  # travels as it is; compared in double precision
    classes = save(rows.where("good").groupBy("embedding")
                   .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"))
                   .withColumn("class_id", F.monotonically_increasing_id()))
    spread = classes.select("class_id", "size", "embedding", F.size("embedding").alias("dim")).mapInArrow(
        _replicate, f"cell long, class_id long, size long, embedding {kind}, keys array<int>")
    dealt = split_hot(spread, "cell", "class_id", CELL).select(
        "cell", "cell_i", "cell_j", "class_id", "size", "block", "embedding", "keys")
    found = save(dealt.repartition(partitions(spark), "cell", "cell_i", "cell_j")
                 .sortWithinPartitions("cell", "cell_i", "cell_j")
                 .mapInArrow(_compare(least), "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    named = (classes.join(links, classes["class_id"] == links["a"], "left")
             .join(parts, classes["class_id"] == parts["node"], "left")
             .select("embedding", "low", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "class_id").alias("component")))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(names, "component").select("embedding", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"))
    out = rows.where("good").join(named, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
