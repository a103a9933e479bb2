"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers, A (byte-level) and B (pieces), encode space + text. Every token
points to its farthest-right overlapping token: the one of the other tokenizer
that covers its last byte, if that ends further right. A token of B that ends
where one of A ends points to itself. Doubling the pointers (successor =
successor of the successor, one vectorised gather a round) takes every token to
the terminal token of its component in logarithmically many rounds; terminals
label the groups. All A-B pairs of a group are links.

Both tokenizers break at the start of white space, and no token reaches over it:
A's rule breaks there, and B has no piece with a space mark or a line end behind
another character (both are checked when the files are loaded; other tokenizers
are refused). So texts are cut before every blank or line end that follows
another character, each distinct chunk is encoded and aligned once by a worker,
and a text's groups are those of its chunks, one after the other. A text of any
length is read in slices; what is held of it is its distinct id pairs.

Counts over the corpus (how many documents hold a pair of ids linked) are sums
over blocks of documents (see ``blocks``), joined back by pair and block.

Defined results: null and empty texts, and texts that a tokenizer does not keep
byte for byte (such as those with U+2581), have no tokens: zeros and an empty
string; rows with the same doc_id are aligned and counted each; a null doc_id
stays null; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.blocks import Block, pack, products, vectors
from textpulse.llm.common import save

SLICE = 1 << 20  # characters of one text that are worked on together
TOGETHER = 1 << 20  # characters of short texts that are worked on together
CACHE = 450_000  # chunks a worker remembers
CACHE_CHARS = 1 << 23
JOINED = 200  # chunks that A encodes in one call
CUT = re.compile(r"(?<=\S)(?=[ \n])")
MARK = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """The byte for each letter of byte-level vocabularies: printing letters
    stand for themselves, the other bytes follow from code point 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _bytes(chunk: str) -> int:
    return len(chunk) if chunk.isascii() else len(chunk.encode())


def _open_end(chunk: str) -> bool:
    return chunk[-1].isspace()


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group labels of the tokens of A and of B, given their ends in one run of
    bytes that both cover."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # B's token that covers the last byte of A's
    over_b = np.minimum(np.searchsorted(ends_a, ends_b), max(n - 1, 0))
    own = n + np.arange(len(ends_b))
    to = np.concatenate((n + over_a, np.where(ends_a[over_b] > ends_b, over_b, own) if n else own))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


class Chunks:
    """Distinct chunks with their ids, groups and linked pairs, kept in arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        import json
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        spec = json.loads(self.a.to_str())
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") \
                or not before.get("use_regex", True):
            raise ValueError(f"{path_a}: not a plain byte-level tokenizer")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        probe = " Ab  éﬁ\n x "
        if any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces) or \
                "".join(self.b.encode(probe, out_type=str)).replace("<0x0A>", "\n") != (" " + probe).replace(" ", MARK):
            raise ValueError(f"{path_b}: pieces may reach over white space, or texts are changed")
        letters = byte_of_letter()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.length_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.space = self.b.piece_to_id(MARK)
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []  # the groups as text
        self._counts = [np.zeros((0, 5), np.int64)]  # tokens of A, of B, groups, links, whole
        self._pairs, self._weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self._sizes = [np.zeros(0, np.int64)]

    def _one(self, parts: list[np.ndarray]) -> np.ndarray:
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0]

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' rows in the arrays, valid until the next call."""
        if len(self.at) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        new = list({c: None for c in chunks if c not in self.at})
        if new:
            self._learn(new)
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def encode_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, and how many each chunk has; chunks that end in white space
        come last. The others are encoded ``JOINED`` at a time, as A breaks
        where a chunk begins; their sizes follow from the tokens' bytes."""
        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

        closed = sum(not _open_end(c) for c in chunks)
        flat = np.fromiter(chain.from_iterable(encode(
            ["".join(chunks[k:min(k + JOINED, closed)]) for k in range(0, closed, JOINED)])), np.int64)
        ends = np.concatenate(([0], np.cumsum(self.length_a[flat])))
        stops = np.cumsum([0, *map(_bytes, chunks[:closed])])
        at = np.searchsorted(ends, stops)
        if at[-1] != len(flat) or not np.array_equal(ends[at], stops):
            return _flat(encode(chunks))  # not its bytes: each for itself
        rest, sizes = _flat(encode(chunks[closed:]))
        return np.concatenate((flat, rest)), np.concatenate((np.diff(at), sizes))

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """Ids of B for chunks of space + text: the tokenizer adds the space."""
        raw = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [(ids or [self.space]) if c[0] == " " else ids[1:] for c, ids in zip(chunks, raw)]

    def _learn(self, new: list[str]) -> None:
        base = len(self.at)
        new.sort(key=_open_end)
        flat_a, size_a = self.encode_a(new)
        flat_b, size_b = _flat(self.encode_b(new))
        whole = self._whole(new, flat_a, size_a, flat_b, size_b)
        if not whole.all():
            flat_a, flat_b = flat_a[np.repeat(whole, size_a)], flat_b[np.repeat(whole, size_b)]
            size_a, size_b = size_a * whole, size_b * whole
        label_a, label_b = labels(np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b]))
        terminal, first_a, in_a = np.unique(label_a, return_index=True, return_counts=True)
        _, first_b, in_b = np.unique(label_b, return_index=True, return_counts=True)
        # groups by chunk: a group lies in the chunk of its first token of A
        chunk_of = np.repeat(np.arange(len(new)), size_a)[first_a]
        groups = np.bincount(chunk_of, minlength=len(new))
        links = np.bincount(chunk_of, weights=in_a * in_b, minlength=len(new)).astype(np.int64)
        # all pairs of each group
        each = in_a * in_b
        group = np.repeat(np.arange(len(each)), each)
        step = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        a = flat_a[first_a[group] + step // in_b[group]] if len(group) else step
        b = flat_b[first_b[group] + step % in_b[group]] if len(group) else step
        values, inverse = np.unique((a << 32) | b, return_inverse=True)
        owner, which, weight = vectors(chunk_of[group], inverse.reshape(-1))
        # the groups as text
        names, fa, fb = self.names, flat_a.tolist(), flat_b.tolist()
        text = []
        for i, m, j, k in zip(first_a.tolist(), in_a.tolist(), first_b.tolist(), in_b.tolist()):
            text.append(f"{names[fa[i]]}|{names[fb[j]]}" if m == k == 1 else
                        ",".join([names[x] for x in fa[i:i + m]]) + "|" + ",".join([names[x] for x in fb[j:j + k]]))
        stop = 0
        for k in groups.tolist():
            self.shown.append(";".join(text[stop:stop + k]))
            stop += k
        self._counts.append(np.stack([size_a, size_b, groups, links, whole.astype(np.int64)], axis=1))
        self._pairs.append(values[which] if len(which) else which)
        self._weights.append(weight)
        self._sizes.append(np.bincount(owner, minlength=len(new)) if len(owner) else np.zeros(len(new), np.int64))
        self.at.update(zip(new, range(base, base + len(new))))
        self.chars += sum(map(len, new))

    def _whole(self, new: list[str], *tokens: np.ndarray) -> np.ndarray:
        """Which chunks both tokenizers keep byte for byte."""
        text = "".join(new).encode()
        sizes = np.fromiter(map(_bytes, new), np.int64, len(new))
        good = np.ones(len(new), bool)
        for flat, size, length, raw in ((*tokens[:2], self.length_a, self.bytes_a), (*tokens[2:], self.length_b, self.bytes_b)):
            parts = list(map(raw.__getitem__, flat.tolist()))
            ends = np.concatenate(([0], np.cumsum(length[flat])))[np.cumsum(size)]
            good &= np.diff(ends, prepend=0) == sizes
            if good.all() and b"".join(parts) == text:
                continue
            edges = [0, *np.cumsum(size).tolist()]
            good &= [b"".join(parts[a:b]) == c.encode() for a, b, c in zip(edges[:-1], edges[1:], new)]
        return good

    def counts(self) -> np.ndarray:
        return self._one(self._counts)

    def pairs_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, pair, weight) of the linked pairs of chunks."""
        pairs, weights, sizes = self._one(self._pairs), self._one(self._weights), self._one(self._sizes)
        ends = np.cumsum(sizes)
        size = sizes[rows]
        place = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + (ends - sizes)[rows][place]
        return place, pairs[at], weights[at]


_chunks: dict[tuple[str, str], Chunks] = {}


def chunk_table(paths: tuple[str, str]) -> Chunks:
    """One table a worker process."""
    if paths not in _chunks:
        _chunks[paths] = Chunks(*paths)
    return _chunks[paths]


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Space + text, cut at places where both tokenizers break."""
    text = " " + text
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _align(table: Chunks, texts: list[str]) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: (whole, [tokens of A, of B, groups, links], groups as text), and
    (text, pair, weight) of all texts."""
    chunks, ends = [], []
    for text in texts:
        chunks += CUT.split(text)
        ends.append(len(chunks))
    rows = table.numbers(chunks)
    counts = table.counts()[rows]
    begin = [0, *ends[:-1]]
    sums = np.add.reduceat(counts, begin, axis=0)
    shown, of = table.shown, rows.tolist()
    out = [(int(s[4]) == e - b, s[:4], ";".join([shown[i] for i in of[b:e]]))
           for s, b, e in zip(sums, begin, ends)]
    owner, row, times = vectors(np.repeat(np.arange(len(texts)), np.array(ends) - np.array(begin)), rows)
    place, pair, weight = table.pairs_of(row)
    values, inverse = np.unique(pair, return_inverse=True)
    owner, which, weight = vectors(owner[place], inverse.reshape(-1), weight * times[place])
    return out, (owner, values[which] if len(which) else which, weight)


def _encode(paths: tuple[str, str]):
    names = ["block", "idx", "pair", "docs", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block, kind = chunk_table(paths), Block(1), None
        rows: list[tuple] = []

        def vector(pairs: np.ndarray, weight: np.ndarray) -> bytes:
            number = block.number(pairs)
            block.add(0, number, np.ones(len(number), np.int64))
            order = np.argsort(number)
            return pack(number[order], weight[order])

        def short(held: list[tuple]) -> None:
            if not held:
                return
            done, (owner, pair, weight) = _align(table, [" " + t for _, t in held])
            good = np.array([d[0] for d in done])
            keep = good[owner]
            owner, pair, weight = owner[keep], pair[keep], weight[keep]
            values, inverse = np.unique(pair, return_inverse=True)
            number = block.number(values)[inverse.reshape(-1)] if len(values) else inverse.reshape(-1)
            block.add(0, number, np.ones(len(number), np.int64))
            order = np.lexsort((number, owner))
            owner, number, weight = owner[order], number[order], weight[order]
            edges = np.searchsorted(owner, np.arange(len(held) + 1))
            for k, (doc_id, _) in enumerate(held):
                if good[k]:
                    a, b = edges[k], edges[k + 1]
                    rows.append((doc_id, *done[k][1].tolist(), hashlib.sha256(done[k][2].encode()).hexdigest(),
                                 pack(number[a:b], weight[a:b])))
                else:
                    rows.append((doc_id, 0, 0, 0, 0, "", b""))

        def long(doc_id, text: str) -> None:
            digest, sums, pairs, weights = hashlib.sha256(), np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for k, part in enumerate(slices(text)):
                [(whole, own, shown)], (_, pair, weight) = _align(table, [part])
                if not whole:
                    rows.append((doc_id, 0, 0, 0, 0, "", b""))
                    return
                digest.update(b";" * (k > 0) + shown.encode())
                sums += own
                pairs, inverse = np.unique(np.concatenate((pairs, pair)), return_inverse=True)
                weights = np.bincount(inverse.reshape(-1), np.concatenate((weights, weight))).astype(np.int64)
            rows.append((doc_id, *sums.tolist(), digest.hexdigest(), vector(pairs, weights)))

        def flush(close: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block
            if rows:
                n, cols = len(rows), list(zip(*rows))
                rows.clear()
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.id] * n, pa.int64()), *empty, pa.array(cols[0], kind),
                     *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.string()),
                     pa.array(cols[6], pa.binary())], names)
            if close or block.full():
                pair, (docs,) = block.keys()
                for a in range(0, len(pair), 50_000):
                    part = slice(a, min(a + 50_000, len(pair)))
                    n = part.stop - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.id] * n, pa.int64()), pa.array(np.arange(a, part.stop, dtype=np.int32)),
                         pa.array(pair[part]), pa.array(docs[part]), pa.nulls(n, kind),
                         *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names)
                block = Block(1, block.serial + 1)

        for batch in batches:
            kind = batch.column(0).type
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    rows.append((doc_id, 0, 0, 0, 0, "", b""))
                elif len(text) > SLICE:
                    long(doc_id, text)
                    yield from flush(False)
                else:
                    held.append((doc_id, text))
                    size += len(text)
                if size >= TOGETHER or len(rows) >= 5_000:
                    short(held)
                    held, size = [], 0
                    yield from flush(False)
            short(held)
            yield from flush(False)
        if kind is not None:
            yield from flush(True)
    return run


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, and over its links count_sum (of the corpus-wide counts of
    documents) and n_best (links whose count is their A id's highest)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = save(docs.select("doc_id", "text").mapInArrow(
        _encode(paths or default_paths()),
        f"block long, idx int, pair long, docs long, doc_id {kind}, n_a long, n_b long, n_groups long, "
        "n_links long, groups_sha256 string, items binary"))
    keys = found.where("idx IS NOT NULL").select("block", "idx", "pair", "docs")
    counts = save(keys.groupBy("pair").agg(F.sum("docs").alias("count_sum")))
    id_a = F.shiftright("pair", 32).alias("id_a")
    best = counts.groupBy(id_a).agg(F.max("count_sum").alias("most"))  # at most one row an id of A
    values = (counts.select("*", id_a).join(best, "id_a")
              .select("pair", "count_sum", (F.col("count_sum") == F.col("most")).cast("long").alias("n_best")))
    rows = found.where("idx IS NULL").drop("idx", "pair", "docs")
    return products(rows, keys.drop("docs").join(values, "pair"), ["n_best", "count_sum"])
