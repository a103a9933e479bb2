"""Substring dedup: super-k-mer partitioning of word windows.

A window is ``WINDOW`` consecutive words of one document (words: runs without
ASCII white space, unchanged). Consecutive windows that share a minimiser of
``MINIMISER`` words travel as one packed string to its bucket (see
``windows``); there windows are sorted, exactly, and each learns the smallest
document it starts in. Every word covered by a window that also starts in a
smaller document goes.

A text above ``CHUNK`` bytes is split piece by piece. In a bucket, windows are first sorted by a 64-bit hash; those alone with their
hash are unique, the rest are sorted as the words themselves.

Defined results: a null text has no words; rows with the same doc_id are one
document but are judged each on its own text; a row with a null doc_id is no
document and keeps all its words; empty tables work; other columns may have
any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textpulse.llm import windows
from textpulse.llm.windows import Runs, mix, runs_of, sliding_min

WINDOW, MINIMISER = 13, 3
CHUNK = 4 << 20  # bytes of text whose windows are computed together
PLACE = 28  # low bits of a minimiser's key: its place
BASE = 0x9E3779B97F4A7C15
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = BLANK.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(first word, text): a long text goes in pieces that overlap by a window
    less one word."""
    at, tail = 0, b""
    for piece in _slices(text, CHUNK):
        piece = tail + piece
        yield at, piece
        parts = piece.rsplit(None, WINDOW - 1) if len(text) > CHUNK else []
        tail = piece
        if len(parts) == WINDOW:  # else all of it is the next one's overlap
            tail = b" ".join(parts[1:])
            at += len(parts[0].split())


def _runs(at: np.ndarray, texts: tuple[bytes, ...]) -> Runs | None:
    """The super-k-mers of some texts, which begin at word ``at`` of their documents."""
    split = [t.split() for t in texts]
    words = [w for t in split for w in t]
    if len(words) < WINDOW:
        return None
    n = np.array([len(t) for t in split], np.int64)
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    code = mix(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1))
    grams = np.zeros(len(words) - MINIMISER + 1, np.uint64)
    for k in range(MINIMISER):
        grams = grams * np.uint64(BASE) + code[k:len(code) - MINIMISER + 1 + k]
    grams = mix(grams)
    keys = grams >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
    keys = sliding_min(keys, WINDOW - MINIMISER + 1)
    a, b = runs_of(keys, np.flatnonzero(own[:len(keys)] == own[WINDOW - 1:]))
    if not len(a):
        return None
    gram = grams[(keys[a] & np.uint64((1 << PLACE) - 1)).astype(np.int64)]
    doc, end = own[a], begin + size
    return Runs(b" ".join(words), doc, a, b, gram, a - first[doc] + at[doc], grams, MINIMISER, WINDOW,
                lambda first, last: (begin[first], end[last + WINDOW - 1]))


def _count(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    return np.fromiter((t.count(b" ") for t in texts), np.int64, len(texts)) - WINDOW + 2


def _group(texts: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (numbered through the strings) that have an equal one, and their classes."""
    text = b" ".join(texts)
    data = np.frombuffer(text, np.uint8)
    blank = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], blank + 1))
    ends = np.concatenate((blank, [len(data)]))
    # the first n words of each string start a window
    words = n + WINDOW - 1
    at = np.repeat(np.cumsum(words) - words - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    a, b = starts[at], ends[at + WINDOW - 1]
    # hash of a window from prefix sums of a polynomial
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), BASE, np.uint64))))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    # scaled to a common power instead of divided
    hashes = mix((prefix[b] - prefix[a]) * up[len(data) - a])
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = np.concatenate(([False], sorted_[1:] == sorted_[:-1]))
    same |= np.concatenate((same[1:], [False]))
    of = np.sort(order[same])
    windows_ = [text[i:j] for i, j in zip(a[of].tolist(), b[of].tolist())]
    rank = sorted(range(len(of)), key=windows_.__getitem__)
    classes = np.zeros(len(of), np.int64)
    k = -1
    before = None
    for r in rank:
        if windows_[r] != before:
            k, before = k + 1, windows_[r]
        classes[r] = k
    return of, classes


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    """Number of words, how many go, and the others joined by one space. A long
    text is split slice by slice."""
    if len(text) <= CHUNK:
        slices = [text.split()]
        n = len(slices[0])
    else:
        slices = (part.split() for part in _slices(text, CHUNK))
        n = sum(len(part.split()) for part in _slices(text, CHUNK))
    lost = windows.gone(n, spans)
    out, at, removed = [], 0, 0
    for words in slices:
        at += len(words)
        if lost is not None:
            own = lost[at - len(words):at].tolist()
            removed += sum(own)
            words = [w for w, x in zip(words, own) if not x]
        if words:
            out.append(b" ".join(words))
    return n, removed, b" ".join(out)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_kept(t, spans) for t, spans in
                zip(windows.unpacked(batch.column(1)), batch.column(2).to_pylist())]
        total, removed, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _apply(batches):
        sha = [hashlib.sha256(k.as_py()).hexdigest() for k in b.column(3).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _run(docs: DataFrame, last, column: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = windows.repeated_spans(docs, _runs, _pieces, CHUNK, _count, _group, WINDOW)
    return found.mapInArrow(last, f"doc_id {kind}, n_words long, n_removed long, {column}")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of ``docs``; kept: the words
    that stay, joined by one space."""
    return _run(docs, _apply, "kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_words, n_removed, kept_sha256."""
    return _run(docs, _digests, "kept_sha256 string")


SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT w.doc_id, w.i FROM wins w JOIN firsts f ON w.win = f.win WHERE f.first_doc < w.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.p) AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
