"""Spelling variants by an index of variable-length grams.

Words are letter runs of the texts. Two words are near if one edit (one code
point inserted, deleted or replaced) turns one into the other.

Dictionary: grams of two to four letters, with a mark for the word's start and
end, that occur more than ``SHORT_LIST`` times in the vocabulary; what isn't in
it is rare. A word is decomposed by reading grams from any place, forwards or
backwards, extended letter by letter while the dictionary has them (to at most
five), so that a frequent gram never stands alone where a longer one can.

An edit at one place affects the grams that touch the place. All others are left
as they are, so a near word is in the lists of all of them: for one edit the
bound on affected grams is taken for each place instead of the worst place. Lists
are merged outwards from the place, gram by gram to either side, until one of
the merged lists is short (a rare gram, in at most ``SHORT_LIST`` words) or the
word ends. The merge is an intersection, so it is kept as one key: a hash of the
merged grams, the place and the length. Every word enters the index under the
keys of its own letters (replaced or deleted) and of the gaps between them (a
letter inserted). Entries that meet are verified letter by letter; a pair is kept
under one place only, so pairs need no distinct. A key's entries are at most
``SHORT_LIST`` words, or words that differ in one letter only: no group grows
with the corpus.

The alphabet has 90 letters, so the dictionary is at most 91^2 + 91^3 + 91^4
bits (8.7 MB), whatever the corpus; it is the only thing that is sent to all
tasks. Words above ``CARRIED`` letters are in the index by number and fetched for
candidates, so that a run of any length costs rows in proportion.

Defined results: null texts have no words; a null doc_id counts as an empty id;
rows with the same doc_id are counted each; an empty table gives no rows; a word
without a near word has n_near 0 and is its own root; other columns may have any
name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import UPPER, partitions, save

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
MIN_LETTERS, MIN_COUNT, RATIO, ERRORS = 7, 2, 10, 31
SLICE = 1 << 20  # characters of a text that are read together
HELD = 200_000  # distinct words a task holds
SHORT_LIST = 64
BASE, MARK = 91, 0  # the mark, a-z, U+00C0 to U+00FF
LONGEST = 4  # of the dictionary's grams; a gram read from a word has one more at most
CARRIED = 64


def _slices(text: str) -> Iterator[str]:
    """Pieces that no run crosses."""
    at = 0
    while len(text) - at > SLICE:
        stop = at + SLICE
        end = RUN.match(text, stop)
        stop = end.end() if end else stop
        yield text[at:stop]
        at = stop
    yield text[at:]


def misspelt(run: str, crc: int) -> str:
    """The run without the letter that its hash names, if ``ERRORS`` divides it."""
    if crc % ERRORS:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1:]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): partial counts."""
    counts: Counter[str] = Counter()

    def emit() -> pa.RecordBatch:
        rows = [(w, n) for w, n in counts.items() if len(w) >= MIN_LETTERS and n]
        counts.clear()
        words, n = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    crc32 = zlib.crc32
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for part in _slices(text):
                runs = RUN.findall(part.translate(LOWER))
                runs = [r for r in runs if len(r) >= MIN_LETTERS]
                counts.update(runs)
                wrong = {r for r in set(runs) if crc32(r.encode(), prefix) % ERRORS == 0}
                if wrong:
                    for run, n in Counter(filter(wrong.__contains__, runs)).items():
                        counts[run] -= n
                        counts[misspelt(run, crc32(run.encode(), prefix))] += n
                if len(counts) > HELD:
                    yield emit()
    yield emit()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_read, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def letters(words: list[str]) -> np.ndarray:
    """Codes of words of one length, one row a word, with the marks."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.int64)
    out = np.full((len(words), size + 2), MARK, np.int64)
    out[:, 1:-1] = np.where(points < 0xC0, points - 96, points - 0xC0 + 27)
    return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places in ``words`` of the words of each length, a bounded number at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, 200_000 // int(n))
        for k in range(0, len(at), step):
            yield at[k:k + step]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, code, n): partial counts of the grams of two to four symbols."""
    held, total = {q: [] for q in range(2, LONGEST + 1)}, 0

    def emit() -> Iterator[pa.RecordBatch]:
        for q, parts in held.items():
            if parts:
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), q, np.int32)), pa.array(code), pa.array(n)], ["size", "code", "n"])

    for batch in batches:
        words = batch.column(0).to_pylist()
        for at in by_length(words):
            row = letters([words[k] for k in at])
            code = row
            for q in range(2, LONGEST + 1):
                code = code[:, :-1] * BASE + row[:, q - 1:]
                held[q].append(code.ravel())
            total += row.size
            if total > 2_000_000:
                yield from emit()
                total = 0
    yield from emit()


class Dictionary:
    """The frequent grams, as bits by code."""

    def __init__(self, bits: dict[int, np.ndarray]):
        self.bits = bits

    def has(self, size: int, code: np.ndarray) -> np.ndarray:
        return (self.bits[size][code >> 3] >> (code & 7).astype(np.uint8) & 1).astype(bool)


def dictionary(words: DataFrame) -> Dictionary:
    """Grams above ``SHORT_LIST`` occurrences. Tasks make the bits, 8 KB a row;
    the driver joins what is at most 8.7 MB."""
    counts = (words.select("word").mapInArrow(_grams, "size int, code long, n long")
              .groupBy("size", "code").agg(F.sum("n").alias("n")).where(F.col("n") > SHORT_LIST))
    chunk = 1 << 16
    parts = counts.groupBy("size", F.floor(F.col("code") / chunk).alias("part")).agg(
        F.collect_list((F.col("code") % chunk).cast("int")).alias("codes"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for codes in batch.column(2):
                on = np.zeros(chunk, np.uint8)
                on[codes.values.to_numpy()] = 1
                raw.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())],
                                             ["size", "part", "bits"])

    bits = {q: np.zeros(-(-BASE ** q // chunk) * chunk // 8, np.uint8) for q in range(2, LONGEST + 1)}
    for row in parts.mapInArrow(pack, "size int, part long, bits binary").toLocalIterator():
        a = row["part"] * chunk // 8
        bits[row["size"]][a:a + chunk // 8] = np.frombuffer(row["bits"], np.uint8)
    return Dictionary(bits)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def merged(row: np.ndarray, frequent: Dictionary) -> np.ndarray:
    """For words of one length with marks (``letters``): column p has the hash of
    the grams read forwards from symbol p until a rare one or the end mark."""
    m, size = row.shape
    out = np.zeros((m, size + 1), np.uint64)
    for p in range(size - 1, -1, -1):
        code, length = row[:, p].copy(), np.ones(m, np.int64)
        go, rare = np.ones(m, bool), np.zeros(m, bool)
        for q in range(2, LONGEST + 2):
            if p + q > size:
                break
            code = np.where(go, code * BASE + row[:, p + q - 1], code)
            length += go
            if q <= LONGEST:
                here = frequent.has(q, np.where(go, code, 0))
                rare |= go & ~here
                go &= here
        gram = _mix((code * 8 + length).astype(np.uint64))
        rest = np.where(rare, np.uint64(0), np.take_along_axis(out, (p + length)[:, None], 1)[:, 0])
        out[:, p] = _mix(gram * np.uint64(0x9E3779B97F4A7C15) + rest + np.uint64(1))
    return out


def keys(row: np.ndarray, frequent: Dictionary, backwards: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of words of one length n: [word, place] for an edit at each of
    its n letters, and for a letter inserted at each of its n + 1 gaps."""
    n = row.shape[1] - 2
    right = merged(row, frequent)  # from symbol p; letter i is symbol i + 1
    left = merged(row[:, ::-1], backwards)[:, ::-1]  # column p: up to symbol p - 1
    place = np.arange(n + 1, dtype=np.uint64)

    def key(of: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = place[:a.shape[1]] + np.uint64(of << 32)
        return _mix(_mix(_mix(at)[None, :] + a) ^ (b * np.uint64(0x9E3779B97F4A7C15)))

    own = key(n, left[:, 1:n + 1], right[:, 2:n + 2])
    gaps = key(n + 1, left[:, 1:n + 2], right[:, 1:n + 2])
    return own, gaps


def _index(sent, long: bool):
    """Index entries; of words by number (``long``) without the word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, backwards = sent.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in by_length(words):
                n = len(words[at[0]])
                own, gaps = keys(letters([words[k] for k in at]), frequent, backwards)
                for key, of, gap in ((own, n, False), (gaps, n + 1, True)):
                    if (of > CARRIED) != long:  # the length of the longer word of a pair decides
                        continue
                    m = key.shape[1]
                    where = pa.array(np.repeat(at, m))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(at))),
                         pa.array(np.full(len(where), gap)), batch.column(1).take(where)],
                        ["key", "place", "gap", "word"])
    return run


def _meet():
    """Pairs of entries with one key, the first being no gap; sorted by key."""
    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        key, place = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        gap, n = rows.column(2).to_numpy(), rows.num_rows
        left, right = [], []
        at, step = np.arange(n), 1
        while len(at):
            at = at[at < n - step]
            at = at[(key[at] == key[at + step]) & (place[at] == place[at + step]) & ~gap[at]]
            left.append(at)
            right.append(at + step)
            step += 1
        i, j = np.concatenate(left or [at]), np.concatenate(right or [at])
        if not len(i):
            return None
        word = rows.column(3).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [word.take(pa.array(i)), word.take(pa.array(j)), pa.array(place[i]), pa.array(gap[j])],
            ["a", "b", "place", "gap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the entries of the last key, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows]).combine_chunks()
            key = rows.column(0).to_numpy()
            stop = int(np.searchsorted(key, key[-1]))
            found = pairs(rows.slice(0, stop)) if stop else None
            if found is not None:
                yield found
            rest = rows.slice(stop)
        found = pairs(rest) if rest is not None else None
        if found is not None:
            yield found
    return run


def _reversed(frequent: Dictionary) -> Dictionary:
    """The same grams read backwards."""
    out = {}
    for q, raw in frequent.bits.items():
        code = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
        back, rest = np.zeros(len(code), np.int64), code
        for _ in range(q):
            back, rest = back * BASE + rest % BASE, rest // BASE
        on = np.zeros(len(raw) * 8, np.uint8)
        on[back] = 1
        out[q] = np.packbits(on, bitorder="little")
    return Dictionary(out)


def _one_edit() -> Column:
    """Whether ``a`` and ``b`` differ by an edit at ``place`` of ``a`` and no
    earlier one: a letter replaced, or deleted from ``a`` (``gap``)."""
    place = F.col("place")
    head = F.substring("a", F.lit(1), place) == F.substring("b", F.lit(1), place)
    tail = F.substring("a", place + 2, F.length("a"))
    replaced = (F.length("a") == F.length("b")) & (F.col("a") != F.col("b")) & (
        tail == F.substring("b", place + 2, F.length("b")))
    deleted = (F.length("a") == F.length("b") + 1) & (tail == F.substring("b", place + 1, F.length("b"))) & (
        (place == 0) | (F.substring("a", place, F.lit(1)) != F.substring("a", place + 1, F.lit(1))))
    return head & F.when(F.col("gap"), deleted).otherwise(replaced)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each pair of near words of ``words`` (word, n) once."""
    spark = words.sparkSession
    frequent = dictionary(words)
    sent = spark.sparkContext.broadcast((frequent, _reversed(frequent)))
    size = F.length("word")

    def met(rows: DataFrame, long: bool) -> DataFrame:
        kind = "long" if long else "string"
        entries = rows.mapInArrow(_index(sent, long), f"key long, place int, gap boolean, word {kind}")
        return (entries.repartition(partitions(spark), "key").sortWithinPartitions("key", "place", "gap")
                .mapInArrow(_meet(), f"a {kind}, b {kind}, place int, gap boolean"))

    short = met(words.where(size <= CARRIED).select("word", F.col("word").alias("id")), False)
    by_id = words.where(size >= CARRIED).select("word", F.xxhash64("word").alias("id"))
    long = met(by_id, True)
    for side in ("a", "b"):
        named = by_id.select(F.col("word").alias(f"{side}_word"), F.col("id").alias(side))
        long = long.join(named, side).drop(side).withColumnRenamed(f"{side}_word", side)
    return short.unionByName(long).where(_one_edit()).select("a", "b")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = save(vocabulary(docs))
    pairs = near_pairs(words)
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
                                           F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
                         .alias("link")).select("link.*")
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = (links.join(other, "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")))
    best_n, name = -F.col("best.less"), F.col("best.near")
    wins = best_n >= RATIO * F.col("n")
    formed = save(words.join(near, "word", "left").select(
        "word", F.when(wins, name).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, best_n).alias("form_n")))
    chains = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # counts grow by RATIO a step, so chains are short; every round doubles the steps taken
    steps = int(math.log(words.agg(F.max("n")).first()[0] or 1, RATIO)) + 1
    for _ in range(max(1, steps).bit_length()):
        chains = save(chains)
        further = chains.select(F.col("word").alias("of"), F.col("root").alias("further"))
        chains = chains.join(further, F.col("root") == F.col("of"), "left").select(
            "word", F.coalesce("further", "root").alias("root"))
    return (formed.join(chains, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
