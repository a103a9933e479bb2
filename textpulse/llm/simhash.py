"""SimHash near-dedup by anchor points of a covering code.

A text's fingerprint has 64 bits. Two fingerprints that differ in at most
``max_bits`` bits differ in at most floor(max_bits / 2) <= 2 bits in one of
their two 32-bit halves. The anchors of a half are the words of a covering
code: a perfect [31, 26] Hamming code on 31 bits (covering radius 1) and one
free bit. Some word lies between the two halves, within one bit of each (half
the threshold for either side), and an anchor lies within the covering radius 1
of that word. So both fingerprints are replicated to every anchor within
covering radius + share of the threshold = 2 bits (16.5 anchors a half on
average, of 2^27), and they meet at a common anchor: no link is lost. Per
anchor, fingerprints are compared in full.

Equal fingerprints are one vertex before any replication, so groups of exact
copies of any size cost one row. Anchors with many fingerprints are split into
cells (``split_hot``); per cell links are given as a spanning forest, never as
all pairs.

Defined results: a null or blank text has fingerprint zero and links like any
other; rows with the same doc_id keep one row each; a null doc_id is never a
component's name (a component of only such rows has a null component_id); an
empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import ASCII_LOWER, components, partitions, save, split_hot

BITS_AT_ONCE = 200_000  # shingles whose bits are counted together
CELL = 4096  # fingerprints of an anchor that are compared in one cell


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text: its lower-cased (A-Z) words between ASCII white
    space, shingles of ``shingle`` words with repeats, each hashed by XXH64
    (seed 42); a bit is 1 if it is set in over half of the hashes."""
    import xxhash
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), BITS_AT_ONCE):
        raw = b"".join([digest(joined[a:b], 42) for a, b in
                        zip(first[at:at + BITS_AT_ONCE], last[at:at + BITS_AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _syndromes(half: np.ndarray) -> np.ndarray:
    """The five parity checks of the low 31 bits of each half."""
    out = np.zeros(len(half), np.int64)
    for check in range(5):
        mask = sum(1 << i for i in range(31) if (i + 1) >> check & 1)
        out |= (np.bitwise_count(half & np.uint64(mask)).astype(np.int64) & 1) << check
    return out


def _flips() -> list[np.ndarray]:
    """By syndrome: the sets of at most two bits whose change gives an anchor."""
    sets = [0, *(1 << i for i in range(32)), *(1 << i | 1 << j for i, j in combinations(range(32), 2))]
    masks = np.array(sets, np.uint64)
    of = _syndromes(masks)
    return [masks[of == s] for s in range(32)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, fingerprint) of the given fingerprints; the anchor of the
    upper half has bit 32 set."""
    flips, keys, owners = _flips(), [], []
    for half in (0, 1):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        of = _syndromes(part)
        for s in range(32):
            here = of == s
            near = part[here][:, None] ^ flips[s][None, :]
            keys.append((near | np.uint64(half << 32)).ravel())
            owners.append(np.repeat(fps[here], len(flips[s])))
    return np.concatenate(keys), np.concatenate(owners)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, fps = anchors(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["anchor", "fp"])


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked in one cell: breadth-first, each
    fingerprint compared only with those not reached yet."""
    rest, found = np.unique(fps), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                new = rest[near]
                found.append((np.full(len(new), at), new))
                front.extend(new)
                rest = rest[~near]
    return found


def _compare(max_bits: int, pairwise: int = 16):
    """Compare the fingerprints of each cell; rows come sorted by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the cell that may go on in the next batch
        key = None

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            return _forest(np.concatenate(held), max_bits) if sum(map(len, held)) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                              for i in range(3)])
            fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fps)]))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            if key != tuple(cells[:, 0]):
                links += close()
                held = []
            # the first and the last cell may reach into other batches
            held.append(fps[:ends[0]])
            key = tuple(cells[:, 0])
            if len(starts) > 1:
                links += close()
                held, key = [fps[starts[-1]:]], tuple(cells[:, -1])
                inner_s, inner_e = starts[1:-1], ends[1:-1]
                size = inner_e - inner_s
                for a, b in zip(inner_s[size > pairwise], inner_e[size > pairwise]):
                    links += _forest(fps[a:b], max_bits)
                group = np.repeat(np.where(size > pairwise, -1, np.arange(len(size))), size)
                if len(group):
                    own = fps[inner_s[0]:inner_e[-1]]
                    for step in range(1, pairwise):
                        near = ((group[step:] == group[:-step]) & (group[step:] >= 0)
                                & (np.bitwise_count(own[step:] ^ own[:-step]) <= max_bits))
                        if near.any():
                            links.append((own[:-step][near], own[step:][near]))
            if links:
                yield _edges(links)
        if links := close():
            yield _edges(links)
    return run


def _edges(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[i] for x in links]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that connect all
    fingerprints at most ``max_bits`` apart (a may be found more than once)."""
    if not 0 <= max_bits <= 5:
        raise ValueError("the anchors cover 0 to 5 differing bits")
    spark = fps.sparkSession
    at = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    cells = split_hot(at, "anchor", "fp", CELL).select("anchor", "cell_i", "cell_j", "fp")
    cells = (cells.repartition(partitions(spark), "anchor", "cell_i", "cell_j")
             .sortWithinPartitions("anchor", "cell_i", "cell_j"))
    return cells.mapInArrow(_compare(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    found = save(fingerprints(docs, shingle))
    distinct = save(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = components(links(distinct, max_bits))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left") \
        .select("fp", "low", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(names, "component").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
