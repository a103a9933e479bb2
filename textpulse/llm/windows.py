"""Windows that start in several documents, found by super-k-mers.

Both exact repeat finders (``substring``: words, ``suffixes``: bytes) work alike:

1. Each document's windows are cut into runs that share a minimiser (the
   smallest hashed k-gram inside the window, the leftmost if equal); a run's
   text is a super-k-mer. Equal windows have equal minimisers.
2. A sieve: only the minimisers' hashes travel first, a few bytes each, with how
   many different strings have them. Runs whose minimiser occurs in one document
   alone can't share a window; the others are named to their documents.
3. The named runs travel as packed strings to their minimiser's bucket. A bucket
   compares the windows of its distinct strings exactly and learns each window's
   first document. A minimiser that stands in more than ``HOT_STRINGS`` strings (a
   common phrase in ever other surroundings) is split: its runs travel window by
   window, dealt by a hash of the whole window, which equal windows share too.
4. Spans to remove go to their documents and are applied there.

In 2 and 3, what is equal in a batch is sent once, with its smallest and largest
document: a passage that a third of all documents share is one hash and one
string a batch. What is compared (part 0) and where it occurs (part 1) are
separate rows; a task reads a bucket's part 0 first, and the occurrences then
stream past, so memory holds distinct hashes and strings, never the members of
a group (a very common string's occurrences take their bucket's task more time). Buckets are dealt by size: about ``BUCKET_BYTES`` of text each at any
scale. Steps 3 and 4 join the same exchange of the texts, which Spark reuses:
texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import save

BUCKET_BYTES = 4 << 20
TASK_BUCKETS = 4
HOT_STRINGS = 1 << 16  # strings that may meet under one minimiser; a batch counts its own
HOT_STEP = 1 << 18  # windows of hot runs that are cut out together
BATCH_KEYS, BATCH_BYTES = 4 << 20, 48 << 20  # minimisers, and bytes of strings, packed together
ROWS = "bucket int, part int, origin long, data binary"


STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


class Runs(NamedTuple):
    """The super-k-mers of some texts. Windows and grams are numbered by the unit
    (word or byte) of all texts at which they begin."""
    text: bytes
    doc: np.ndarray  # index of each run's text
    first: np.ndarray  # first and last window of each run
    last: np.ndarray
    minimisers: np.ndarray
    starts: np.ndarray  # place of the first window in its document
    grams: np.ndarray  # hash of the gram at each unit
    gram: int  # units of a gram and of a window
    window: int
    spans: Callable  # bytes (begin, end) of the units of windows first to last

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the units of the windows ``first`` to ``last``, from grams that
        cover them without a gap."""
        end = last + self.window - self.gram
        out = mix(self.grams[first] + (end - first).astype(np.uint64))
        for step in range(self.gram, int((end - first).max(initial=0)) + self.gram, self.gram):
            more = mix(out * np.uint64(STEP) + self.grams[np.minimum(first + step, end)])
            out = np.where(first + step - self.gram < end, more, out)
        return out


def runs_of(keys: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of valid ``windows`` with the same minimiser
    (``keys`` hold its place too, so runs of two documents differ)."""
    if not len(windows):
        return windows, windows
    own = keys[windows]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    first = np.flatnonzero(new)
    return windows[first], windows[np.concatenate((first[1:], [len(windows)])) - 1]


def with_tag(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): rows that share a doc_id are told apart by a hash
    of their text; all others have tag 0. Rows without an id stay out."""
    docs = docs.select("doc_id", "text")
    repeated = save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("doc_id", F.lit(True).alias("again")))
    tag = F.when(F.col("again"), F.hash(F.coalesce("text", F.lit("")))).otherwise(0)
    return docs.join(repeated, "doc_id", "left").select("doc_id", "text", tag.alias("tag"))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, tag) with the text compressed, for its exchange;
    ``unpacked`` reads it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [press.compress(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)],
                                             ["doc_id", "text", "tag"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text binary, tag int")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor()
    return (press.decompress(t.as_py()) for t in column)


def bucket_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(TASK_BUCKETS, -(-total // BUCKET_BYTES))


def _pack(*parts) -> bytes:
    body = [np.ascontiguousarray(p).tobytes() if isinstance(p, np.ndarray) else p for p in parts]
    sizes = np.array([len(body), *map(len, body)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(body))


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(out), 64):
        cols = list(zip(*out[k:k + 64]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
             pa.array(cols[3], pa.binary())], ["bucket", "part", "origin", "data"])


def _task() -> int:
    """First number for the batches of this task."""
    context = TaskContext.get()
    return context.partitionId() << 32 if context else 0


def _low_bytes(hashes: np.ndarray) -> bytes:
    """Five bytes of each hash (the bucket holds others): a false match costs
    work, never a result."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


class Keybox:
    """Collects the minimisers of a batch and packs them by bucket."""

    def __init__(self, buckets: int, limit: int):
        self.buckets, self.limit, self.origin, self.held, self.size = buckets, limit, _task(), [], 0

    def add(self, runs: Runs, docs: np.ndarray, tags: np.ndarray, named: np.ndarray | None) -> None:
        self.held.append((runs.minimisers, docs, tags, runs.starts.astype(np.uint32),
                          runs.hashes(runs.first, runs.last)))
        self.size += len(docs)

    def full(self) -> bool:
        return self.size > self.limit

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        hashes, docs, tags, starts, strings = (np.concatenate([h[i] for h in self.held]) for i in range(5))
        self.held, self.size = [], 0
        to = (mix(hashes) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(self.buckets + 1))
        out = []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = order[cuts[b]:cuts[b + 1]]
            each, first, of = np.unique(hashes[own], return_index=True, return_inverse=True)
            rank = np.argsort(first)  # numbered as they come, which packs well
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            of, each, d = place[of], each[rank], docs[own]
            low, high = np.full(len(each), np.iinfo(np.int64).max), np.full(len(each), np.iinfo(np.int64).min)
            np.minimum.at(low, of, d)
            np.maximum.at(high, of, d)
            _, one = np.unique(strings[own], return_index=True)
            many = np.bincount(of[one], minlength=len(each)).astype(np.int32)
            out.append((b, 0, self.origin, _pack(_low_bytes(each), low, high - low, many)))
            out.append((b, 1, self.origin, _pack(np.diff(of, prepend=0).astype(np.int32), np.diff(d, prepend=0),
                                                 tags[own], starts[own])))
        self.origin += 1
        yield from _rows(out)


class Outbox:
    """Collects the super-k-mers of a batch and packs them by bucket."""

    def __init__(self, buckets: int, limit: int):
        self.buckets, self.limit, self.origin = buckets, limit, _task()
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.mins: list[np.ndarray] = []  # minimiser of each new string
        self.of: list[np.ndarray] = []
        self.where: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, runs: Runs, docs: np.ndarray, tags: np.ndarray, named: np.ndarray) -> None:
        """``named``: 1 for the runs to send, 2 for those to send window by window."""
        whole = np.flatnonzero(named == 1)
        self._put(runs.text, *runs.spans(runs.first[whole], runs.last[whole]), runs.minimisers[whole],
                  docs[whole], tags[whole], runs.starts[whole])
        hot = np.flatnonzero(named == 2)
        n = runs.last[hot] - runs.first[hot] + 1
        begin = np.cumsum(n) - n
        for at in range(0, int(n.sum()), HOT_STEP):
            nth = np.arange(at, min(at + HOT_STEP, int(n.sum())))
            of = np.searchsorted(begin, nth, "right") - 1
            nth, of = nth - begin[of], hot[of]
            window = runs.first[of] + nth
            self._put(runs.text, *runs.spans(window, window), runs.hashes(window, window),
                      docs[of], tags[of], runs.starts[of] + nth)

    def _put(self, text: bytes, begin: np.ndarray, end: np.ndarray, minimisers: np.ndarray,
             docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> None:
        strings = [text[i:j] for i, j in zip(begin.tolist(), end.tolist())]
        known = len(self.seen)
        put = self.seen.setdefault
        of = np.array([put(s, len(self.seen)) for s in strings], np.int64)
        mins = np.zeros(len(self.seen) - known, np.uint64)
        fresh = of >= known
        mins[of[fresh] - known] = minimisers[fresh]
        self.mins.append(mins)
        self.of.append(of)
        self.where.append((docs, tags, starts.astype(np.uint32)))
        self.size += int((end - begin).sum())

    def full(self) -> bool:
        return self.size > self.limit

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.seen:
            return
        strings, mins, of = list(self.seen), np.concatenate(self.mins), np.concatenate(self.of)
        docs, tags, starts = (np.concatenate([w[i] for w in self.where]) for i in range(3))
        low = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(low, of, docs)
        to = (mix(mins) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cuts = np.searchsorted(to[order], np.arange(self.buckets + 1))
        occ = np.argsort(to[of], kind="stable")
        occ_cuts = np.searchsorted(to[of][occ], np.arange(self.buckets + 1))
        out = []
        for b in np.unique(to).tolist():
            own = order[cuts[b]:cuts[b + 1]]
            text = [strings[i] for i in own.tolist()]
            out.append((b, 0, self.origin, _pack(np.fromiter(map(len, text), np.uint32, len(text)),
                                                 b"".join(text), mins[own], low[own])))
            at = occ[occ_cuts[b]:occ_cuts[b + 1]]
            out.append((b, 1, self.origin, _pack((place[of[at]] - cuts[b]).astype(np.uint32),
                                                 docs[at], tags[at], starts[at])))
        self.origin += 1
        self.clear()
        yield from _rows(out)


class Bucket:
    """The distinct strings of one bucket, and each window's first document."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.mins: dict[int, int] = {}
        self.low: list[int] = []
        self.maps: dict[int, np.ndarray] = {}
        self.solved = False

    def strings(self, origin: int, data: bytes) -> None:
        sizes, text, mins, low = _unpack(data)
        ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
        own, put = [], self.seen.setdefault
        for a, b, m, d in zip([0, *ends[:-1].tolist()], ends.tolist(),
                              np.frombuffer(mins, np.uint64).tolist(), np.frombuffer(low, np.int64).tolist()):
            k = put(text[a:b], len(self.seen))
            if k == len(self.low):
                self.low.append(d)
                self.mins[k] = m
            elif d < self.low[k]:
                self.low[k] = d
            own.append(k)
        self.maps[origin] = np.array(own, np.int64)

    def solve(self, count: Callable, group: Callable) -> None:
        """``count``: windows of each string; ``group``: equal windows."""
        texts, low = list(self.seen), np.array(self.low, np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n = count(texts, sizes)
        self.base = np.concatenate(([0], np.cumsum(self.n)))
        self.first = np.repeat(low, self.n)
        mins = np.array([self.mins[k] for k in range(len(texts))], np.uint64)
        _, inverse, many = np.unique(mins, return_inverse=True, return_counts=True)
        pick = np.flatnonzero(many[inverse] > 1)
        if len(pick):
            of, same = group([texts[k] for k in pick.tolist()], self.n[pick])
            # of: windows (numbered through the picked strings) with an equal one; same: their class
            slot = np.repeat(self.base[pick] - np.concatenate(([0], np.cumsum(self.n[pick])[:-1])),
                             self.n[pick])[of] + of
            least = np.full(int(same.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, self.first[slot])
            self.first[slot] = least[same]
        self.least = np.minimum.reduceat(self.first, self.base[:-1]) if len(texts) else low
        self.seen, self.mins, self.solved = {}, {}, True

    def spans(self, origin: int, data: bytes, width: int) -> tuple | None:
        """(doc, tag, start, end) of removed runs among one batch's occurrences."""
        at, docs, tags, starts = (np.frombuffer(x, t) for x, t in
                                  zip(_unpack(data), (np.uint32, np.int64, np.int32, np.uint32)))
        k = self.maps[origin][at]
        hit = self.least[k] < docs
        k, docs, tags, starts = k[hit], docs[hit], tags[hit], starts[hit].astype(np.int64)
        if not len(k):
            return None
        n = self.n[k]
        begin = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(begin, n)
        gone = self.first[np.repeat(self.base[k], n) + nth] < np.repeat(docs, n)
        edge = np.zeros(len(gone) + 1, bool)
        edge[begin] = True
        edge[-1] = True
        up = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
        down = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False]))))
        own = np.searchsorted(begin, up, "right") - 1
        return docs[own], tags[own], starts[own] + nth[up], starts[own] + nth[down] + width


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: Callable) -> Iterator[tuple]:
    """(bucket's state, part, origin, data), a new ``kind()`` for each bucket."""
    now, at = None, None
    for batch in batches:
        for b, part, origin, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now:
                now, at = b, kind()
            yield at, part, origin, data


class Sieve:
    """The distinct minimisers of one bucket, which of them occur in two documents
    (1) and which of those in more than ``most`` strings (2)."""

    def __init__(self, most: int):
        self.most = most
        self.held: list[tuple] = []
        self.shared: dict[int, np.ndarray] | None = None

    def keys(self, origin: int, data: bytes) -> None:
        raw, low, more, many = _unpack(data)
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        low = np.frombuffer(low, np.int64)
        self.held.append((origin, wide.view(np.uint64).ravel(), low, low + np.frombuffer(more, np.int64),
                          np.frombuffer(many, np.int32)))

    def solve(self) -> None:
        _, of = np.unique(np.concatenate([h[1] for h in self.held]), return_inverse=True)
        low, high = np.full(of.max() + 1, np.iinfo(np.int64).max), np.full(of.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, of, np.concatenate([h[2] for h in self.held]))
        np.maximum.at(high, of, np.concatenate([h[3] for h in self.held]))
        many = np.bincount(of, np.concatenate([h[4] for h in self.held]))
        kind = np.where(low < high, 1 + (many > self.most), 0).astype(np.int8)
        parts = np.split(kind[of], np.cumsum([len(h[1]) for h in self.held])[:-1])
        self.shared = {h[0]: p for h, p in zip(self.held, parts)}
        self.held = []

    def named(self, origin: int, data: bytes) -> tuple:
        of, docs, tags, starts = (np.frombuffer(x, t) for x, t in
                                  zip(_unpack(data), (np.int32, np.int64, np.int32, np.uint32)))
        kind = self.shared[origin][np.cumsum(of)]
        keep = kind > 0
        return np.cumsum(docs)[keep], tags[keep], starts[keep].astype(np.int64) << 1 | (kind[keep] > 1)


def _sift(most: int):
    """(doc_id, tag, start) of the runs to send, start << 1 with a last bit for
    those to send window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, part, origin, data in _by_bucket(batches, partial(Sieve, most)):
            if part == 0:
                at.keys(origin, data)
                continue
            if at.shared is None:
                at.solve()
            docs, tags, starts = at.named(origin, data)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(tags), pa.array(starts)],
                                                 ["doc_id", "tag", "start"])
    return run


SPAN_BITS = 20  # a span is start << SPAN_BITS | length; super-k-mers are far shorter


def _solve_buckets(count: Callable, group: Callable, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, part, origin, data in _by_bucket(batches, Bucket):
            if part == 0:
                at.strings(origin, data)
                continue
            if not at.solved:
                at.solve(count, group)
            if (found := at.spans(origin, data, width)) is not None:
                docs, tags, start, end = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(tags), pa.array(start << SPAN_BITS | (end - start))],
                    ["doc_id", "tag", "span"])
    return run


def _emit(runs: Callable, pieces: Callable, chunk: int, box_of: Callable):
    """Rows of a box from (doc_id, text, tag) or (doc_id, packed text, tag, named
    starts)."""
    def flush(box, held: list) -> None:
        ids, tags, named, at, texts = zip(*held)
        if found := runs(np.array(at, np.int64), texts):
            of, kind = found.doc, None
            if named[0] is not None:
                known = np.concatenate([np.asarray(s, np.int64) + (k << 40) for k, s in enumerate(named)])
                own = (found.starts << 1) + (of.astype(np.int64) << 40)
                kind = np.isin(own, known) + 2 * np.isin(own + 1, known)
            box.add(found, np.array(ids, np.int64)[of], np.array(tags, np.int32)[of], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, held, size = box_of(), [], 0
        for batch in batches:
            named = None
            if batch.num_columns > 3:  # rows without starts are passed over here, not by a filter
                batch = batch.filter(batch.column(3).is_valid())
                named = batch.column(3)
            texts = unpacked(batch.column(1)) if named is not None else \
                (t.as_py() or b"" for t in batch.column(1).cast(pa.binary()))
            for k, (d, t, g) in enumerate(zip(batch.column(0), texts, batch.column(2))):
                own = named[k].values.to_numpy(zero_copy_only=False) if named is not None else None
                for at, text in pieces(t):
                    held.append((d.as_py(), g.as_py(), own, at, text))
                    size += len(text)
                    if size >= chunk:
                        flush(box, held)
                        held, size = [], 0
                        if box.full():
                            yield from box.rows()
        if held:
            flush(box, held)
        yield from box.rows()
    return run


def repeated_spans(docs: DataFrame, runs: Callable, pieces: Callable, chunk: int, count: Callable,
                   group: Callable, width: int) -> DataFrame:
    """(doc_id, text, spans) for every row of ``docs``: the packed text and what
    windows that also start in a smaller document cover, packed spans in any
    order, null where there are none. Read by ``gone``."""
    docs = with_tag(docs)
    buckets = bucket_count(docs)
    tasks = max(1, buckets // TASK_BUCKETS)

    def dealt(rows: DataFrame) -> DataFrame:
        # a task reads every tasks-th bucket, one after the other, part 0 before part 1
        return rows.repartitionById(tasks, "bucket").sortWithinPartitions("bucket", "part")
    long_id = F.col("doc_id").cast("long").alias("doc_id")
    keys = docs.where("doc_id IS NOT NULL").select(long_id, "text", "tag").mapInArrow(
        _emit(runs, pieces, chunk, partial(Keybox, buckets, BATCH_KEYS)), ROWS)
    named = (dealt(keys).mapInArrow(_sift(HOT_STRINGS), "doc_id long, tag int, start long")
             .groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts")))
    texts = packed(docs)
    # a left join without a filter both times, so that both exchange the same texts
    strings = _join_tagged(texts, named, "starts").select(long_id, "text", "tag", "starts").mapInArrow(
        _emit(runs, pieces, chunk, partial(Outbox, buckets, BATCH_BYTES)), ROWS)
    spans = (dealt(strings).mapInArrow(_solve_buckets(count, group, width), "doc_id long, tag int, span long")
             .groupBy("doc_id", "tag").agg(F.collect_list("span").alias("spans")))
    return _join_tagged(texts, spans, "spans").select("doc_id", "text", "spans")


def _join_tagged(docs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``docs`` with a column of ``found`` for its document, or null."""
    found = found.select(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag"), column)
    return docs.join(found, (F.col("doc_id") == F.col("of_doc")) & (F.col("tag") == F.col("of_tag")),
                     "left").select("doc_id", "text", "tag", column)


def gone(n: int, spans) -> np.ndarray | None:
    """Which of ``n`` places the packed spans cover; None without spans."""
    if spans is None:
        return None
    spans = np.asarray(spans, np.int64)
    start = spans >> SPAN_BITS
    return covered(n, start, start + (spans & ((1 << SPAN_BITS) - 1)))


def covered(n: int, starts, ends) -> np.ndarray:
    """Which of ``n`` places the spans cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.asarray(ends, np.int64), -1)
    return np.cumsum(step[:-1]) > 0
