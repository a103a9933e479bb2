"""Language ID by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from its code point.
A trigram's vector binds (multiplies) the vectors of its letters, the first
permuted (rotated) twice and the second once; a blank stands before and after
each word. A document's vector bundles (adds) the vectors of its trigrams, a
language's prototype the unit vectors of its documents. A document is of the
language whose prototype has the largest cosine with its vector.

Prototypes are learned from a bounded sample (``LEARN_DOCS`` documents of each
language on average, chosen by a hash of the id; a parameter) of the rows with
a language, summed by task and language before anything moves: the driver gets
one vector a language and task. Scoring is one pass without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score
0; if nothing can be learned all are ``und``; a null id is never learned from
and not held out; equal rows get equal results; ties go to the first language
in alphabetical order; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import learn_split, save

DIM = 1024
LEARN_DOCS = 4000
TOGETHER = 1 << 20  # letters that are counted together
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """By code point: itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64)
    return _letters


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of ``DIM`` signs (+1, -1) for each code point."""
    lanes = np.arange(DIM // 64, dtype=np.uint64)
    seeds = _mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + lanes + np.uint64(1))
    bits = np.unpackbits(_mix(seeds).view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram code, as float32."""
    parts = [(codes >> s) & 0x1FFFFF for s in (42, 21, 0)]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = letter_vectors(letters)
    first, second, third = np.split(at, 3)
    return (np.roll(base, 2, axis=1)[first] * np.roll(base, 1, axis=1)[second]
            * base[third]).astype(np.float32)


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram codes of a text and their counts; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[points]
    if not letters.any():
        return None
    letters = np.concatenate(([0], letters, [0]))
    keep = np.concatenate(([True], (letters[1:] != 0) | (letters[:-1] != 0)))  # one blank between words
    letters = letters[keep]
    codes = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    codes = codes[letters[1:-1] != 0]
    return np.unique(codes, return_counts=True)


def bundles(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``texts``, their bundled vectors), some texts at a time;
    texts without a letter are left out."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for k, text in enumerate([*texts, None]):
        if text and (found := _trigrams(text)):
            held.append((k, *found))
            size += len(found[0])
        if held and (size > TOGETHER or k == len(texts)):
            codes, at = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            out, end = np.empty((len(held), DIM), np.float32), 0
            vectors = trigram_vectors(codes)
            for i, (_, own, counts) in enumerate(held):
                out[i] = counts.astype(np.float32) @ vectors[at[end:end + len(own)]]
                end += len(own)
            yield np.array([h[0] for h in held]), out
            held, size = [], 0


def prototypes(docs: DataFrame, learn_docs: int = LEARN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes as unit vectors."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (learn_split(F.col("doc_id")) != 0))
    shares = save(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(learn_docs)) / F.count(F.lit(1)))
                                            .alias("share")))  # one row a language, broadcast as a small file
    draw = F.pmod(F.xxhash64(F.lit("learn"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(shares, "lang").where(draw < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, vectors in bundles(texts):
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float64)
                for i, v in zip(at, unit):
                    sums[langs[i]] = sums.get(langs[i], 0.0) + v
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "v"])
    parts = chosen.mapInArrow(run, "lang string, v array<double>")
    # summed on the executors: one row a language reaches the driver
    total = (parts.select("lang", F.posexplode("v").alias("i", "x"))
             .groupBy("lang", "i").agg(F.sum("x").alias("x"))
             .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
             .select("lang", "v.x").collect())
    total.sort(key=lambda r: r[0])
    matrix = np.array([r[1] for r in total], np.float64).reshape(len(total), DIM)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r[0] for r in total], (matrix / np.where(norms > 0, norms, 1)).astype(np.float32)


def language_id(docs: DataFrame, learn_docs: int = LEARN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``; score is the
    cosine with the language's prototype, at least 0."""
    names, matrix = prototypes(docs, learn_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for at, vectors in bundles(texts) if names else ():
                norms = np.linalg.norm(vectors, axis=1)
                cos = (vectors @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                best = cos.argmax(axis=1)
                pred[at] = [names[b] for b in best]
                score[at] = np.clip(cos[np.arange(len(at)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(learn_split(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
