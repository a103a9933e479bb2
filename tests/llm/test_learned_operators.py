"""Operators that learn, search or tokenise: recall, held-out accuracy, exact
round trips, and defined results for odd rows."""

import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import llm_brute as brute
from textpulse.llm import embedding, language, packing, pii, quality
from textpulse.llm.common import table

SF = "/root/testdata/sf0.01"


# --- embeddings ---------------------------------------------------------------

def vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 24))
    for k in range(0, 200, 2):  # near pairs on either side of 0.9
        x[k + 1] = x[k] + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.45, 0.6])
    x[250:262] = x[250] + rng.standard_normal((12, 24)) * 0.02  # a dense group
    x[270:280] = x[270]  # copies
    rows = [(k * 3 % 997, [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] + [1.0] * 23),
           (5004, [float("inf")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (None, rows[0][1]),
           (rows[7][0], rows[9][1]), (5006, rows[0][1][:23]), (5007, [1e300 * v for v in rows[0][1]]), (5008, [2.0])]
    return rows + odd


def brute_links(rows):
    def unit(v):
        if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt(v @ v)
    units = [unit(v) if i is not None else None for i, v in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    part = brute.components(len(rows), pairs)
    out = []
    for k, (i, _) in enumerate(rows):
        name = min((r[0] for r, p in zip(rows, part) if p == part[k] and r[0] is not None), default=None)
        out.append((i, sum(k in p for p in pairs), name, i is not None and i == name))
    return out


def test_embedding_links_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS size")
    got = brute.collected(embedding.embedding_links(df), "vec_id", "n_links", "component_id", "kept")
    assert got == brute.expected(brute_links(rows))


def test_embedding_hot_cell_counts_once(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL", 5)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = brute.collected(embedding.embedding_links(df), "vec_id", "n_links", "component_id", "kept")
    assert got == brute.expected(brute_links(rows))


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = embedding.unit(rng.standard_normal((2000, 64)))
    e = rng.standard_normal(x.shape)
    e = embedding.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * e
    a, b = embedding.cells(x), embedding.cells(y)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


def test_embedding_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 8)) * 2
    home = embedding.nearest_e8(x)
    twice = np.round(home * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (home.sum(axis=1) % 2 == 0)).all()
    far = ((x - home) ** 2).sum(axis=1)
    assert len(embedding.ROOTS) == 240
    assert all((((x - home - r) ** 2).sum(axis=1) >= far - 1e-9).all() for r in embedding.ROOTS)


def test_embeddings_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding.embedding_links(df).count() == 0


# --- personal data ------------------------------------------------------------

def check_base(rows, got):
    want = []
    for d, t in rows:
        spans = brute.personal(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((d, *[sum(s[0] == k for s in spans) for k in range(4)], brute.sha(text)))
    assert got == brute.expected(want)


def test_pii_base_spans_match_the_patterns(spark):
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    check_base(brute.TEXTS, brute.collected(pii.digest(brute.frame(spark)), *columns))
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_base(rows, brute.collected(pii.digest(docs), *columns))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.%+-1290 (é", max_size=60))
def test_pii_base_spans_of_any_text(text):
    assert [tuple(s) for s in pii.base_spans(text)] == brute.personal(text)


def test_pii_adds_likely_spans_only(spark):
    good = "Mail: jane.doe [at] mail (dot) example.com or call (743) 555-3824 today"
    rows = [(k, f"contact bob{k}@site.org or call +1 743 555 {3000 + k}") for k in range(30)]
    rows += [(100, good), (101, "section 123 456 7890 of the index"), (102, "nothing here at all")]
    got = {r.doc_id: r.spans for r in pii.digest(brute.frame(spark, rows)).collect()}
    assert got[100] == f"email:6:{good.index(' or call')},phone:{good.index('(743)')}:{good.index(' today')}"
    assert got[101] == got[102] == ""


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000,
                                  "a@" * 50_000, "1 " * 50_000, "a[at]b[dot]" * 10_000, "(555)" * 30_000])
def test_pii_is_linear_in_long_texts(text):
    import time
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 5


# --- quality ------------------------------------------------------------------

def auc(good, bad):
    return (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (got[got.quality == q].score.to_numpy() for q in (1, 0))
    assert len(bad) > 5 and auc(good, bad) > 0.95
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    ids = got.doc_id.tolist()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_quality_odd_rows_and_labels(spark):
    docs = brute.frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 0), (9, 1, 0), (None, 1, 0), (999, 0, 0), (10, None, 1)],
                                   "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality.digest(docs, some).collect()
        assert len(got) == len(brute.TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.digest(docs, labels.limit(0)).collect()] == [0.5] * len(brute.TEXTS)
    assert quality.digest(docs.limit(0), labels).count() == 0
    kept = quality.quality_scores(docs, labels).select("row.*")
    assert kept.dtypes == docs.dtypes


def test_quality_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionMIL()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, n, y = rng.standard_normal((9, quality.FEATURES)), np.array([4, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        o = model._forward(x, n)["o"]
        return float(np.mean(np.log1p(np.exp(o)) - y * o))
    grads = model._gradients(x, n, y)
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in model.w[name].shape)
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        slope = (up - loss()) / 2e-5
        model.w[name][at] += 1e-5
        assert abs(slope - g[at]) < 1e-4, name


def plain_passage(data):
    """One passage's vector, counted byte by byte and word by word."""
    kinds = [int(quality.BYTE_CLASS[b]) for b in data]
    n, c = max(len(data), 1), quality.CLASSES
    single, pairs, grams = [0.0] * c, [0.0] * (c * c), [0.0] * quality.GRAM_BUCKETS
    for k in kinds:
        single[k] += 4 / n
    for a, b in zip(kinds, kinds[1:]):
        pairs[a * c + b] += 4 / n
    runs = [data[i:i + quality.GRAM] for i in range(len(data) - quality.GRAM + 1)]
    for run in runs:
        g = int.from_bytes(run, "big")
        g = (g ^ g >> 15) * 0x9E3779B1 % 2 ** 32
        grams[(g >> 16) % quality.GRAM_BUCKETS] += 4 / len(runs)
    return single, pairs, grams


def plain_words(data):
    """Of each passage of a text: shares of repeated and of distinct words, mean length."""
    begins = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\r]+", data)]
    out = []
    for at in range(0, max(len(data), 1), quality.PASSAGE):
        part = data[at:at + quality.PASSAGE]
        here = [w for b, w in begins if at <= b < at + quality.PASSAGE]
        if not here:
            out.append([0, 0, min(max(len(part), 1) / 20, 3), len(part) / quality.PASSAGE])
            continue
        again = sum(a == b for a, b in zip(here, here[1:]))
        out.append([again / len(here), len(set(here)) / len(here), min(max(len(part), 1) / len(here) / 20, 3),
                    len(part) / quality.PASSAGE])
    return out


def plain_score(model, text):
    bag = []
    for cut in range(0, max(len(text), 1), quality.PIECE):
        data = text[cut:cut + quality.PIECE]
        for k, extra in enumerate(plain_words(data)):
            single, pairs, grams = plain_passage(data[k * quality.PASSAGE:(k + 1) * quality.PASSAGE])
            bag.append((np.array(single + pairs + extra + grams) - model.mean) * model.scale)
    w, total, weight = model.w, np.zeros(quality.HIDDEN), 0.0
    for x in bag:
        h = np.maximum(x @ w["E"] + w["e"], 0)
        s = math.exp((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"])
        total, weight = total + s * h, weight + s
    return 1 / (1 + math.exp(-(total / weight @ w["c"] + w["b"][0])))


def test_quality_scores_match_a_plain_version(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [r[1].encode() if r[1] else b"" for r in brute.TEXTS] + [
        b"", b" ", b"x" * 5000, "żółć, straße! ".encode() * 300,
        b" ".join(bytes(rng.integers(97, 105, rng.integers(1, 9)).astype(np.uint8)) for _ in range(3000))]
    model = quality.AttentionMIL()
    model.w["e"] = rng.standard_normal(quality.HIDDEN).astype(np.float32)
    model.mean, model.scale = np.full(quality.FEATURES, 0.02), np.full(quality.FEATURES, 1.5)
    whole = quality.score_texts(model, texts)
    assert np.allclose(whole, [plain_score(model, t) for t in texts], atol=1e-5)
    assert whole.std() > 0.01
    monkeypatch.setattr(quality, "PIECE", 2 * quality.PASSAGE)
    cut = quality.score_texts(model, texts)
    assert np.allclose(cut, [plain_score(model, t) for t in texts], atol=1e-5)


def test_quality_learns_from_every_passage_of_its_sample(spark):
    docs = spark.createDataFrame([(k, "word " * (20 + 900 * (k % 3)), 1) for k in range(60)] * 2,
                                 "doc_id long, text string, label int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    learned = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    every = quality._sample(docs, labels, 6000, 1 << 24)
    assert every.count() == len(learned)
    bags = every.mapInArrow(quality._passages, "label int, x binary").collect()
    assert sorted(len(r.x) // 2 // quality.FEATURES for r in bags) == \
        sorted(-(-5 * (20 + 900 * (k % 3)) // quality.PASSAGE) for k in learned)
    sizes = [r.n for r in quality._sample(docs, labels, 6000, 30_000).selectExpr("length(text) AS n").collect()]
    assert sum(sizes) >= 30_000 > sum(sizes) - max(sizes)
    assert quality._sample(docs, labels, 5, 1 << 24).count() == 5


def test_quality_reads_a_very_long_text_by_pieces():
    model = quality.AttentionMIL()
    text = b"some words of a long text, " * 1_500_000  # 40 MB
    tracemalloc.start()
    try:
        score = quality.score_texts(model, [b"short", text])
        assert tracemalloc.get_traced_memory()[1] < 250e6
    finally:
        tracemalloc.stop()
    assert abs(score[1] - model.score_long(text[:quality.PIECE * 3])) < 1e-3


# --- language -----------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = [*brute.TEXTS, (30, "123 !!"), (31, "\U0001F600"), (32, "ß"), (33, "İ ǅ")]
    got = {r.doc_id: r for r in language.language_id(brute.frame(spark, rows)).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4, 30, 31, 21)] == ["und"] * 6
    assert {got[k].lang_pred for k in (1, 19, 32)} <= {"en", "de"}
    none = brute.frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(none).collect()} == {"und"}


# --- packing ------------------------------------------------------------------

def check_packing(pieces, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], np.uint32).tobytes() for t in texts)
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(want)
    lengths = sorted(len(w) // 4 for w in want)
    assert sorted(sum(p.length for p in ps) for ps in by_doc.values()) == lengths
    ids = {len(w): [] for w in want}
    for w in want:
        ids[len(w)].append(w)
    for ps in by_doc.values():
        ps.sort(key=lambda p: p.start)
        n = ps[0].doc_tokens
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert any(all(zlib.crc32(w[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32 for p in ps)
                   for w in ids[4 * n])
    for ps in by_window.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
    sizes = [sum(p.length for p in by_window[k]) for k in sorted(by_window)]
    assert sorted(by_window) == list(range(len(sizes))) and all(s == packing.WINDOW for s in sizes[:-1])
    assert 0 < sizes[-1] <= packing.WINDOW


def test_packing_round_trip(spark):
    rows = [(k, t) for k, (_, t) in enumerate([*brute.TEXTS, (0, "<|endoftext|> a <|b"), (0, "x y z é Σς")])]
    check_packing(packing.pack(brute.frame(spark, rows)).collect(), [t for _, t in rows])
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check_packing(packing.pack(docs).collect(), [r.text for r in docs.collect()])


def test_packing_repeated_and_null_ids(spark):
    got = packing.pack(brute.frame(spark)).collect()
    assert sum(p.doc_id is None for p in got) >= 2
    places = {}
    for p in got:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_packing_keeps_the_mixture(spark):
    docs = table(spark, SF, "documents")
    source = docs.select("doc_id", "source")
    got = packing.pack(docs).join(source, "doc_id").groupBy("sequence_id", "source").agg(F.sum("length").alias("n"))
    share = got.toPandas().pivot_table(index="sequence_id", columns="source", values="n", fill_value=0) / packing.WINDOW
    # never more than two cells away from its target, window by window and in sum
    drift = (share - share.mean()).iloc[:-1]
    assert drift.abs().max().max() <= 2 * packing.CELL / packing.WINDOW
    assert drift.cumsum().abs().max().max() <= 3 * packing.CELL / packing.WINDOW


def test_packing_with_other_weights(spark):
    rows = [(k, "word " * 400) for k in range(60)]
    df = brute.frame(spark, rows)
    pieces = packing.pack(df, weights={"web": 6.0, "book": 3.0, None: 1.0}).collect()
    check_packing(pieces, [t for _, t in rows])
    of = {r.doc_id: r.source for r in df.collect()}
    early = [p for p in pieces if p.sequence_id < 3]
    web = sum(p.length for p in early if of[p.doc_id] == "web") / sum(p.length for p in early)
    assert abs(web - 0.6) < 0.07


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40_000), min_size=1, max_size=6), st.integers(0, 10_000))
def test_schedule_places_every_cell_once(totals, seed):
    if not sum(totals):
        return
    weights = np.random.default_rng(seed).random(len(totals)) + 0.05
    plan = packing.Schedule(totals, weights.tolist() if seed % 2 else None)
    spans = []
    for s, total in enumerate(totals):
        cells = np.arange(-(-total // packing.CELL))
        if len(cells):
            start = plan.places(np.full(len(cells), s), cells)
            size = np.minimum((cells + 1) * packing.CELL, total) - cells * packing.CELL
            spans += list(zip(start.tolist(), size.tolist()))
    spans.sort()
    at = 0
    for a, n in spans:
        assert a == at
        at += n
    assert at == sum(totals)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbz é́\t\n\r\x0b 'sre<|>19!.Σ日\x1c\x85", max_size=40))
def test_encoder_equals_the_tokenizer(text):
    path = packing.tokenizer_path()
    assert _encoder(path).width == 2
    got = np.frombuffer(_encoder(path).ids(text.encode()), np.uint16).tolist()
    assert got == _whole(path).encode(text, add_special_tokens=False).ids


_made = {}


def _encoder(path):
    return _made.setdefault("encoder", packing.Encoder(path))


def _whole(path):
    from tokenizers import Tokenizer
    if "whole" not in _made:
        _made["whole"] = Tokenizer.from_file(path)
    return _made["whole"]
