"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes (the whole text, in
order). Each passage is encoded as a vector: shares of byte classes, of pairs of
classes, of words that repeat, and of hashed runs of ``GRAM`` bytes. A small
network maps each passage to a hidden vector h, scores it by gated attention
w . (tanh(V h) * sigmoid(U h)), and classifies the attention-weighted mean of
its document's passages by a logistic layer. All weights are learned together,
from document labels alone.

The network is fitted by Adam on every passage of a bounded sample of labelled
documents: those with the smallest hash of their id, until there are
``LEARN_DOCS`` of them or they have ``LEARN_BYTES`` bytes (the one that reaches
that number is the last). Scoring reads every passage of every text in one pass
without a shuffle. A text is read ``PIECE`` bytes at a time, and attention
keeps running sums from piece to piece, so memory doesn't grow with a text; a
word that lies across two pieces counts as one in each.

Defined results: a null or empty text is one blank passage and gets a score
like any other; without both labels to learn from, every score is the share of
label 1 (0.5 without labels); a null id is never learned from and not held out;
repeated rows get equal scores and are learned from once; several labels of one
document that differ each count; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.llm.common import learn_split, save

PASSAGE = 512
LEARN_DOCS = 6000
LEARN_BYTES = 24 << 20
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
GRAM, GRAM_BUCKETS = 4, 64
PIECE = 1 << 20  # bytes encoded together: whole passages

# Byte classes: lower, upper, digit, blank, newline, sentence marks, comma-like,
# exclamation, pipe, brackets and quotes, hyphen-like, other ASCII marks, control, non-ASCII
CLASSES = 14


def _classes() -> np.ndarray:
    out = np.full(256, 11, np.uint8)
    for k, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"),
                     (3, " \t"), (4, "\n\r"), (5, ".?:;"), (6, ","), (7, "!"), (8, "|"),
                     (9, "()[]{}<>\"'"), (10, "-_+/")):
        out[np.frombuffer(chars.encode(), np.uint8)] = k
    out[:32][out[:32] == 11] = 12
    out[128:] = 13
    return out


BYTE_CLASS = _classes()
FEATURES = CLASSES + CLASSES * CLASSES + 4 + GRAM_BUCKETS


def _gram_shares(data: np.ndarray, passage: np.ndarray, total: int) -> np.ndarray:
    """Shares of each passage's runs of ``GRAM`` bytes by bucket of their hash."""
    out = np.zeros((total, GRAM_BUCKETS), np.float32)
    if len(data) < GRAM:
        return out
    last = len(data) - GRAM + 1
    gram = np.zeros(last, np.uint32)
    for k in range(GRAM):
        gram = gram << np.uint32(8) | data[k:last + k]
    # by the upper half of a product, mixed: every byte has a say in it
    gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x9E3779B1)
    bucket = (gram >> np.uint32(16)) % np.uint32(GRAM_BUCKETS)
    inside = passage[GRAM - 1:] == passage[:last]
    at = passage[:last][inside]
    out += np.bincount(at * GRAM_BUCKETS + bucket[inside].astype(np.int64),
                       minlength=total * GRAM_BUCKETS).reshape(total, -1)
    return out / np.maximum(np.bincount(at, minlength=total), 1)[:, None].astype(np.float32)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of the texts in order, and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    own = np.repeat(np.arange(len(texts)), sizes)
    passage = first[own] + (np.arange(len(data)) - starts[own]) // PASSAGE
    total = int(n.sum())
    kind = BYTE_CLASS[data].astype(np.int64)
    length = np.maximum(np.bincount(passage, minlength=total), 1)[:, None]
    single = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / length
    follow = (kind[:-1] * CLASSES + kind[1:])[same] if (same := passage[1:] == passage[:-1]).any() else kind[:0]
    pairs = np.bincount((passage[1:][same] if len(follow) else passage[:0]) * CLASSES * CLASSES + follow,
                        minlength=total * CLASSES * CLASSES).reshape(total, -1) / length
    # words: runs without blanks; their hash is a polynomial of their bytes
    inside = (kind != 3) & (kind != 4)
    begin = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & (own[1:] == own[:-1])))) \
        if len(data) else np.zeros(0, np.int64)
    extra = np.zeros((total, 4))
    at = passage[begin]
    count = np.maximum(np.bincount(at, minlength=total), 1)
    if len(begin):
        powers = np.multiply.accumulate(np.full(len(data), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(data)) - begin[np.maximum(np.searchsorted(begin, np.arange(len(data)), "right") - 1, 0)]
        mixed = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[place], np.uint64(0))
        words = np.add.reduceat(mixed, begin)
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (at[1:] == at[:-1])))
        extra[:, 0] = np.bincount(at, again, minlength=total) / count
        order = np.lexsort((words, at))
        sw, sa = words[order], at[order]
        new = np.concatenate(([True], (sw[1:] != sw[:-1]) | (sa[1:] != sa[:-1])))
        extra[:, 1] = np.bincount(sa, new, minlength=total) / count
    extra[:, 2] = np.minimum(length[:, 0] / count / 20.0, 3.0)
    extra[:, 3] = (np.bincount(passage, minlength=total) / PASSAGE)
    grams = _gram_shares(data, passage, total)
    return np.concatenate([single * 4, pairs * 4, extra, grams * 4], axis=1).astype(np.float32), n


def pieces(text) -> Iterator[memoryview]:
    """A text's bytes, ``PIECE`` at a time; an empty text is one piece."""
    view = memoryview(text)
    for at in range(0, max(len(view), 1), PIECE):
        yield view[at:at + PIECE]


class AttentionMIL:
    """Gated attention over the passages of each document."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32),
                  "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE),
                  "c": draw(HIDDEN), "b": np.zeros(1, np.float32)}
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)

    def _attention(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hidden vectors of passages, both gates and the attention before softmax."""
        w = self.w
        h = np.maximum(x @ w["E"] + w["e"], 0)
        t, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        return h, t, u, (t * u) @ w["a"]

    def _forward(self, x: np.ndarray, n: np.ndarray) -> dict:
        w, starts = self.w, np.concatenate(([0], np.cumsum(n)[:-1]))
        h, t, u, s = self._attention(x)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
        a = s / np.repeat(np.add.reduceat(s, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "u": u, "a": a, "z": z, "starts": starts, "o": z @ w["c"] + w["b"][0]}

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        o = self._forward((x - self.mean) * self.scale, n)["o"]
        return 1 / (1 + np.exp(-np.clip(o.astype(np.float64), -30, 30)))

    def score_long(self, text) -> float:
        """The score of one text, read by pieces: its attention's greatest value,
        weights and weighted sum are carried along."""
        top, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for piece in pieces(text):
            h, _, _, s = self._attention((encode([piece])[0] - self.mean) * self.scale)
            now = max(top, float(s.max()))
            a = np.exp(s - now, dtype=np.float64)
            fade = np.exp(top - now)
            top, weight, total = now, weight * fade + a.sum(), total * fade + a @ h
        o = total / weight @ self.w["c"] + self.w["b"][0]
        return float(1 / (1 + np.exp(-np.clip(o, -30, 30))))

    def _gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
        w, f = self.w, self._forward(x, n)
        do = ((1 / (1 + np.exp(-np.clip(f["o"], -30, 30))) - y) / len(y)).astype(np.float32)
        dz = np.repeat(do[:, None] * w["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), n))
        dtu = ds[:, None] * w["a"]
        dt, du = dtu * f["u"] * (1 - f["t"] ** 2), dtu * f["t"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dt @ w["V"].T + du @ w["U"].T
        dh *= f["h"] > 0
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ du,
                "a": ((f["t"] * f["u"]) * ds[:, None]).sum(axis=0), "c": f["z"].T @ do, "b": do.sum()[None]}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64,
            rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> None:
        every = np.concatenate(bags)
        self.mean = every.mean(axis=0)
        self.scale = 1 / np.maximum(every.std(axis=0), 0.05).astype(np.float32)
        bags = [(b - self.mean) * self.scale for b in bags]
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        r = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                n = np.array([len(bags[i]) for i in pick])
                step += 1
                for k, g in self._gradients(np.concatenate([bags[i] for i in pick]), n, y[pick]).items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    r[k] = 0.999 * r[k] + 0.001 * g * g
                    lift = rate * (1 - epoch / epochs) / (1 - 0.9 ** step)
                    self.w[k] = (self.w[k] - lift * m[k] / (np.sqrt(r[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


class Constant:
    """What is left without two labels: the share of label 1."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(n), self.share)

    def score_long(self, text) -> float:
        return self.share


def _bytes(column: pa.Array) -> list:
    """The bytes of each text, not copied; none for null."""
    return [v.as_buffer() or b"" for v in column]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, vectors as bytes) for learning."""
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
            x = b"".join(encode([piece])[0].astype(np.float16).tobytes() for piece in pieces(text))
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([x])], ["label", "x"])


def _sample(docs: DataFrame, labels: DataFrame, learn_docs: int, learn_bytes: int) -> DataFrame:
    """(label, text) of the labelled documents to learn from."""
    order = ["h", "label", "text_hash"]
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & (learn_split(F.col("doc_id")) != 0)).distinct()
             .withColumn("h", F.xxhash64(F.lit("learn"), "doc_id"))
             .orderBy("h", "label").limit(learn_docs))
    text = F.coalesce("text", F.lit(""))
    rows = save(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
                .join(known, "doc_id").dropDuplicates(order).select(*order, "text"))
    sizes = rows.select(*order, F.octet_length("text").alias("size")).orderBy(*order).limit(learn_docs).collect()
    if not sizes:
        return rows.select("label", "text")
    before = np.concatenate(([0], np.cumsum([r["size"] for r in sizes])[:-1]))
    end = sizes[int((before < learn_bytes).sum()) - 1]
    upto = F.struct(*[F.lit(end[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    return rows.where(F.struct(*order) <= upto).select("label", "text")


def learn(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS, seed: int = 7,
          learn_bytes: int = LEARN_BYTES):
    """A model with ``scores`` and ``score_long``, fitted on the bounded sample."""
    rows = (_sample(docs, labels, learn_docs, learn_bytes)
            .mapInArrow(_passages, "label int, x binary").collect())  # vectors of about learn_bytes bytes of text
    rows.sort(key=lambda r: (r[0], bytes(r[1])))  # whatever order they came in
    y = np.array([r[0] for r in rows], np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(r[1], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in rows]
    model = AttentionMIL(seed)
    model.fit(bags, y, seed=seed)
    return model


def score_texts(model, texts: list) -> np.ndarray:
    """Scores of texts (bytes): short ones encoded together, long ones by pieces."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size += len(texts[end])
            end += 1
        if end == at:
            out[at] = model.score_long(texts[at])
            end += 1
        else:
            out[at:end] = model.scores(*encode(texts[at:end]))
        at = end
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS) -> DataFrame:
    """Rows of ``docs`` in a struct ``row``, with held_out, score and predicted."""
    model = learn(docs, labels, learn_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(0).field("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score_texts(model, texts))], ["row", "score"])
    out = docs.select(F.struct("*").alias("row")).mapInArrow(run, T.StructType(
        [T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())]))
    held_out = F.coalesce(learn_split(F.col("row.doc_id")) == 0, F.lit(False))
    return out.select("row", held_out.alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    return quality_scores(docs.select("doc_id", "text"), labels).select(
        "row.doc_id", "held_out", "score", "predicted")
