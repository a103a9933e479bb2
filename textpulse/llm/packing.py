"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue: its documents' token ids, each followed by the end
id, one after the other. A round earns each source its share of ``WINDOW``
tokens (the target mixture); a source serves whole cells of ``CELL`` tokens of
its queue while its deficit (earned less served) covers them, the rest is
carried to later rounds. What the rounds serve, in order, is cut every
``WINDOW`` tokens: windows are filled without a gap, and only the last one of
all can be short. A source that runs dry leaves its share to the others.

Deficit counters are sums, so no task has to wait for another: with the
cumulative weights known, the round of any cell and the place of its round
follow in closed form (``Schedule``). A document needs only the number of
tokens before it in its source's queue, which are prefix sums over the totals
of each task and source. So deficits and half-filled windows carry across
windows and partitions exactly. The plan: tokenise once and save the ids (one
row a document, with its offset inside its task); sum by task and source; join
the offsets; cut. Texts and ids are never shuffled for it unless the table of
offsets outgrows Spark's broadcast threshold.

Targets default to each source's share of all tokens; ``weights`` sets others.

Defined results: a null or empty text is the end id alone; null sources are one
queue; rows with the same doc_id are packed each; a null doc_id stays null; an
empty table gives no pieces; other columns may have any name.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.common import save

WINDOW, CELL, END = 2048, 128, 1
CACHE = 1 << 19  # words a worker remembers
MARKS = "!\"#$%&()*+,-./:;=?@[]_{|}~"  # ASCII marks but the apostrophe and what special tokens begin with
LATIN_END = "\u0250"  # below it no letter combines or changes when normalised


def _byte_chars() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where
    it prints, else one of the code points from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


BYTE_CHARS = _byte_chars()


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Ids of whole texts by way of their words: a map from each word (bytes) to
    its ids, filled as words come. Ids are little-endian numbers of ``width``
    bytes: two where the vocabulary allows it, else four.

    The tokenizer breaks at white space before anything else, so the ids of
    blank-separated words, joined, are the ids of the text. It also breaks between
    letters and marks: a word of Latin letters with ASCII marks at its end goes to
    the tokenizer's model lower-cased, byte by byte, as its normalizer and
    pre-tokenizer would pass it on; any other word goes through all of the
    tokenizer, and so does a text that holds the start of a special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__({b"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cores, self.tails = self.tokenizer.model, {"": b""}, {"": b""}
        self.code = "H" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "I"
        self.width = array(self.code).itemsize

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.cores = {"": b""}
            self[b""] = b""
        text = word.decode()
        core = text.rstrip(MARKS)
        tail, core = text[len(core):], core.lower()
        if core.isalpha() and (core.isascii() or max(core) < LATIN_END):
            ids = self.cores.get(core)
            if ids is None:
                spelt = core if core.isascii() else "".join([BYTE_CHARS[b] for b in core.encode()])
                self.cores[core] = ids = array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if tail not in self.tails:
                if len(self.tails) >= CACHE:
                    self.tails = {"": b""}
                self.tails[tail] = self._whole(tail)
            ids += self.tails[tail]
        else:
            ids = self._whole(text)
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, ``width`` bytes each."""
        if b"<|" in text:
            return self._whole(text.decode())
        words = text.split()  # ASCII white space, all of which the tokenizer breaks at
        return b"".join(itemgetter(*words)(self)) if len(words) > 1 else self[b"".join(words)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process: the words it knows serve its later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Schedule:
    """The rounds over queues with ``totals`` tokens at given ``weights``.

    Virtual time v: a live source has earned weight * v tokens. Time passes
    between the ends of the sources at a rate that gives WINDOW tokens a round."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(weights if weights is not None else totals, np.float64)
        if (self.weights[self.totals > 0] <= 0).any():
            raise ValueError("a source with documents needs a weight above zero")
        ends = np.where(self.totals > 0, self.totals / np.where(self.weights > 0, self.weights, 1), 0)
        self.v = np.concatenate(([0], np.unique(ends[ends > 0])))
        self.n = np.minimum(self.v[:, None] * self.weights, self.totals).sum(axis=1)  # tokens earned by then
        self.rounds = -(-int(self.totals.sum()) // WINDOW)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each source has served by the end of each round."""
        v = np.interp(rounds * float(WINDOW), self.n, self.v)
        cells = np.floor(v[:, None] * self.weights / CELL + 1e-9).astype(np.int64)
        out = np.minimum(cells * CELL, self.totals)
        return np.where((rounds >= self.rounds)[:, None] | (v[:, None] * self.weights >= self.totals - 1e-6),
                        self.totals, np.where(rounds[:, None] <= 0, 0, out))

    def round_of(self, source: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The round that serves a cell: the first by whose end it is served."""
        upto = np.minimum((cell + 1) * CELL, self.totals[source])
        guess = np.interp(upto / self.weights[source], self.v, self.n) / WINDOW
        low = np.maximum(np.ceil(guess).astype(np.int64) - 2, 0)
        out = low + 5
        need, back = np.unique(np.concatenate([low + k for k in range(5)]), return_inverse=True)
        table = self.served(need)
        for k in range(4, -1, -1):
            row = back[k * len(low):(k + 1) * len(low)]
            out = np.where(table[row, source] >= upto, low + k, out)
        return out

    def places(self, source: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Place of each cell's first token in all that is served."""
        rounds = self.round_of(source, cell)
        each, back = np.unique(rounds, return_inverse=True)
        before, after = self.served(each - 1), self.served(each)
        gain = after - before
        start = before.sum(axis=1)[:, None] + np.cumsum(gain, axis=1) - gain
        return start[back, source] + cell * CELL - before[back, source]


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = encoder(path), {}
        end, width = array(words.code, [END]).tobytes(), words.width
        part = TaskContext.get().partitionId()
        for batch in batches:
            starts, ids = [], []
            sources = batch.column(2).to_pylist()
            for text, source in zip(batch.column(1).cast(pa.binary()), sources):
                own = words.ids(text.as_py() or b"") + end
                starts.append(at.get(source, 0))
                at[source] = starts[-1] + len(own) // width
                ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array([len(i) // width for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "part", "start", "n", "ids"])
    return run


def _cut(names: list[str | None], schedule: Schedule):
    index = {s: k for k, s in enumerate(names)}

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(5).to_numpy().astype(np.int64)
        ids = [raw if len(raw) == 4 * k else np.frombuffer(raw, np.uint16).astype(np.uint32).tobytes()
               for raw, k in zip(batch.column(4).to_pylist(), n.tolist())]
        source = np.array([index[s] for s in batch.column(1).to_pylist()], np.int64)
        a = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        first, last = a // CELL, (a + n - 1) // CELL
        count = last - first + 1
        doc = np.repeat(np.arange(len(n)), count)
        cell = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        place = schedule.places(source[doc], cell) - cell * CELL  # to add to a place in the queue
        lo, hi = np.maximum(a[doc], cell * CELL), np.minimum((a + n)[doc], (cell + 1) * CELL)
        start, begin, end = lo - a[doc], lo + place, hi + place
        # a cell may reach over the end of a window, never of two
        over = begin // WINDOW != (end - 1) // WINDOW
        edge = (begin // WINDOW + 1) * WINDOW
        doc = np.concatenate((doc, doc[over]))
        start = np.concatenate((start, (start + edge - begin)[over]))
        begin, end = (np.concatenate((begin, edge[over])),
                      np.concatenate((np.where(over, edge, end), end[over])))
        order = np.lexsort((start, doc))
        doc, start, begin, end = doc[order], start[order], begin[order], end[order]
        # neighbours in the document that are neighbours in the window are one piece
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (begin[1:] != end[:-1]) | (begin[1:] % WINDOW == 0)))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(doc)])) - 1
        doc, start, begin, size = doc[head], start[head], begin[head], end[tail] - begin[head]
        crc = [zlib.crc32(memoryview(ids[d])[4 * s:4 * (s + k)]) for d, s, k in
               zip(doc.tolist(), start.tolist(), size.tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
             pa.array(n[doc]), pa.array(begin // WINDOW), pa.array(begin % WINDOW)],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield pieces(batch.slice(at, 1000))
    return run


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Saved (doc_id, source, part, start, n, ids): each document's ids (see
    ``Encoder``), how many, and the tokens before it in its task's part of its
    source's queue."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return save(rows.mapInArrow(_tokenise(path or tokenizer_path()),
                                f"doc_id {kind}, source string, part int, start long, n long, ids binary"))


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = token_table(docs, path)
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = save(parts.select("part", "source", "n", F.coalesce(before, F.lit(0)).alias("base")))
    totals = sorted(offsets.groupBy("source").agg(F.sum("n")).collect(),  # one row a source: the mixture
                    key=lambda r: (r[0] is not None, r[0]))
    names = [r[0] for r in totals]
    schedule = Schedule([r[1] for r in totals], [weights[s] for s in names] if weights else None)
    offsets = offsets.select(F.col("part").alias("of_part"), F.col("source").alias("of_source"), "base")
    rows = tokens.join(offsets, (F.col("part") == F.col("of_part"))
                       & F.col("source").eqNullSafe(F.col("of_source")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "source", "base", "start", "ids", tokens["n"]).mapInArrow(
        _cut(names, schedule), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                               "sequence_id long, offset long")
