"""Tokenizer alignment, URL filter and spelling variants against plain Python."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

import llm_brute as brute
from textpulse.llm import alignment, blocks, spelling, url_filter
from textpulse.llm.common import table

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# ---- tokenizer alignment ----

ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
AWKWARD = [(40, "a  b\n\nc \n d\x00e\ufeff f\u00a0g"), (41, " leading and trailing "), (42, "has \u2581 mark"),
           (43, "<s> <|endoftext|> </s> <unk> <0x41>"), (44, "\n"), (45, " "), (46, "'s don't I'll\t\ttabs \r\n x"),
           (47, "\U0001f600\U0001f468\u200d\U0001f469 emoji 漢字かな混じり文 ünï"), (48, "\x1c\x1d \x1f x"), (49, "e\u0301 \u0301")]


def plain_alignment(rows):
    from tokenizers import Tokenizer
    import sentencepiece
    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = alignment.byte_of_letter()
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            goal = (" " + text).encode()
            one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                    b.id_to_piece(i).replace("\u2581", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in one) == goal == b"".join(x for _, x in two):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (one, two)]
                cuts = sorted(ends[0] & ends[1])
                for side, tokens in enumerate((one, two)):
                    at = group = 0
                    for i, raw in tokens:
                        at += len(raw)
                        if side == 0 and len(groups) <= group:
                            groups.append(([], []))
                        groups[group][side].append(i)
                        group += at == cuts[group]
        docs.append((doc_id, groups))
    counts = Counter(p for _, groups in docs for p in {(i, j) for g in groups for i in g[0] for j in g[1]})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, groups in docs:
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    brute.sha(shown) if groups else ""))
    return in_order(out)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_brute_force(spark, monkeypatch, small):
    if small:  # many slices, blocks and cache resets
        for module, name, value in ((alignment, "SLICE", 50), (alignment, "TOGETHER", 200), (alignment, "CACHE", 60),
                                    (blocks, "MAX_KEYS", 40)):
            monkeypatch.setattr(module, name, value)
        rows = [(i, t) for i, t in brute.TEXTS if len(t or "") < 4000] + AWKWARD
        context = mock.Mock(partitionId=lambda: 3)  # in this process: the limits don't reach the workers
        with mock.patch.object(blocks.TaskContext, "get", lambda: context):
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                                "text": [r[1] for r in rows]})
            encode = alignment._encode(alignment.default_paths())
            found = pa.Table.from_batches(list(encode(iter([batch])))).to_pylist()
        keys = {(r["block"], r["idx"]): (r["pair"], r["docs"]) for r in found if r["idx"] is not None}
        assert len({k[0] for k in keys}) > 2
        counts = Counter()
        for pair, n in keys.values():
            counts[pair] += n
        best = defaultdict(int)
        for pair, n in counts.items():
            best[pair >> 32] = max(best[pair >> 32], n)
        got = []
        for r in (r for r in found if r["idx"] is None):
            number, weight = blocks.unpack(r["items"])
            pairs = [keys[r["block"], k][0] for k in number.tolist()]
            got.append((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"],
                        sum(w for p, w in zip(pairs, weight.tolist()) if counts[p] == best[p >> 32]),
                        sum(counts[p] * w for p, w in zip(pairs, weight.tolist())), r["groups_sha256"]))
        assert in_order(got) == plain_alignment(rows)
        return
    rows = brute.TEXTS + AWKWARD
    assert rows_of(alignment.alignment(brute.frame(spark, rows)), *ALIGNED) == plain_alignment(rows)


def test_alignment_of_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.alignment(docs), *ALIGNED) == plain_alignment(rows)
    assert alignment.alignment(docs.where("false")).count() == 0


def test_pointer_jumping_on_a_long_chain():
    # tokens of two bytes, one side shifted by one byte: one chain through all
    n = 10_000
    ends_a = np.arange(1, n + 1) * 2
    ends_b = np.concatenate((np.arange(n) * 2 + 1, [2 * n]))
    a, b = alignment.labels(ends_a, ends_b)
    assert set(a.tolist()) == set(b.tolist()) == {n}
    a, b = alignment.labels(ends_a, ends_a)
    assert a.tolist() == b.tolist() == list(range(n))


def test_chunks_are_encoded_as_in_the_whole_text():
    chunks = alignment.Chunks(*alignment.default_paths())
    rnd = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "é", "漢", "\U0001f600", "'s", "123", "<s>", "\u3000",
             "\x1c", "\x00", "_", "\r\n", "\u0301", "\u200b", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 10)))
        cut = alignment.CUT.split(" " + text)
        assert [i for e in chunks.a.encode_batch(cut, add_special_tokens=False) for i in e.ids] == \
            chunks.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in chunks.encode_b(cut) for i in ids] == chunks.b.encode(text)


def test_alignment_refuses_other_tokenizers():
    import public_tokenizers
    with pytest.raises(ValueError):
        alignment.Chunks(public_tokenizers.path("word_bpe_49k.json"), alignment.default_paths()[1])


# ---- URL filter ----

URLS = ["https://a.example.net/en/1", "http://net/", "http://net", "http://NET/x", "http://evilnet/", "http://a.net?x=/",
        "http://a.b.org/fr/9?q=1#t", "http://a.org/de/9", "https://example.com/de/", "https://xexample.com/de/", None, "",
        "no scheme net/", "://", "a://b://c/d", "http://example.net/en", "https://m.example.net/EN/2", "http://x.org/fr/",
        "http://ünï.org/fr/ü?ü", "http://\n.org/fr/\n", "http://w.example.com/en/" + "x" * 3000, "http://org/fr/\x00",
        "http://a.net#/", "http://user@b.net:80/"]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3:]
    stop = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = brute.lower(rest[:stop]), rest[stop:]
    path = re.split("[?#]", tail)[0]
    fits = [(len(d + p), d + p, v) for v, d, p in url_filter.RULES
            if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def plain_filter(rows):
    facts, texts = [plain_url(u) for _, u in rows], []
    for _, url in rows:
        rest = "" if url is None else url[url.index("://") + 3:] if "://" in url else url
        stop = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        texts.append((brute.lower(rest[:stop]) + rest[stop:]).encode())
    label = [{"allow": 1, "block": -1}.get(f[3], 0) for f in facts]
    held = [zlib.crc32((u or "").encode()) % 5 == 0 for _, u in rows]
    order = url_filter.ORDER

    def events(raw):
        symbols = [0] * order + [x + 1 for x in raw] + [url_filter.END]
        return [tuple(symbols[k - order:k + 1]) for k in range(order, len(symbols))]

    counts = {1: Counter(), -1: Counter()}
    for raw, y, out in zip(texts, label, held):
        if y and not out:
            for e in events(raw):
                for k in range(order + 1):
                    counts[y][e[order - k:]] += 1
    after = {y: defaultdict(list) for y in counts}
    for y in counts:
        for gram, n in counts[y].items():
            after[y][gram[:-1]].append(n)

    def p(y, gram):
        low = p(y, gram[1:]) if len(gram) > 1 else 1 / url_filter.END
        n = after[y].get(gram[:-1])
        return (counts[y][gram] + len(n) * low) / (sum(n) + len(n)) if n else low

    scores = [sum(math.log(p(1, e)) - math.log(p(-1, e)) for e in events(raw)) / (len(raw) + 1) if raw else 0.0
              for raw in texts]
    cut = float("-inf")
    if 1 in label and -1 in label:
        bins = defaultdict(lambda: [0, 0])
        for s, y, out in zip(scores, label, held):
            if y and out:
                bins[math.floor(s * url_filter.BINS)][y < 0] += 1
        cut = url_filter.threshold([(k, *v) for k, v in bins.items()])
    return [(i, *f[:3], f[3] or ("allow" if s >= cut else "block")) for (i, _), f, s in zip(rows, facts, scores)], scores


def pages_of(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (3, urls[-1])], "page_id long, url string")
    rows = [tuple(r) for r in df.collect()]
    return df.select("*", *[brute.F.lit(1).alias(c) for c in ("host", "path", "rule", "text", "block", "gram", "label")]), rows


def test_url_filter_matches_brute_force(spark):
    cases = [pages_of(spark, URLS)]
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    cases.append((pages, [(r[0], r[1]) for r in pages.select("page_id", "url").collect()]))
    for df, rows in cases:
        got = [tuple(r) for r in url_filter.judged(df).collect()]
        want, scores = plain_filter(rows)
        assert in_order(r[:5] for r in got) == in_order(want)
        assert np.allclose(sorted(r[5] for r in got), sorted(scores), atol=1e-9)
        assert url_filter.url_filter(df).count() == sum(r[4] == "allow" for r in want)


def test_url_filter_without_evidence(spark):
    df, _ = pages_of(spark, ["http://q.com/en/", "http://a.net/x", None])
    assert {r["verdict"] for r in url_filter.judged(df).where("rule IS NULL").collect()} == {"allow"}
    assert url_filter.judged(df.where("false")).count() == 0


def test_url_models_tell_unseen_urls_apart(spark):
    rnd = random.Random(2)
    good = [f"http://{rnd.choice(['blog', 'news'])}{rnd.randrange(99)}.org/fr/{rnd.choice(['story', 'essay'])}-{rnd.randrange(999)}"
            for _ in range(300)]
    bad = [f"http://{rnd.choice(['pills', 'bets'])}{rnd.randrange(99)}.net/win-{rnd.choice(['cash', 'now'])}-{rnd.randrange(999)}"
           for _ in range(300)]
    new = [u.replace(".org/fr/", ".info/") for u in good[:50]] + [u.replace(".net/", ".info/") for u in bad[:50]]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    verdicts = [r["verdict"] for r in url_filter.judged(df).where("rule IS NULL").orderBy("page_id").collect()]
    assert verdicts == ["allow"] * 50 + ["block"] * 50


def test_threshold_is_the_best_cut():
    rnd = random.Random(3)
    for _ in range(200):
        bins = [(k, rnd.randrange(4), rnd.randrange(4)) for k in rnd.sample(range(-9, 9), rnd.randint(1, 8))]
        yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
        cut = url_filter.threshold(bins) * url_filter.BINS
        if yes and no:
            value = lambda c: sum(b[1] for b in bins if b[0] >= c) / yes + sum(b[2] for b in bins if b[0] < c) / no
            assert math.isclose(value(cut), max(value(c) for c in range(-10, 11)))


def test_long_urls_are_counted_in_slices(monkeypatch):
    text = bytes(random.Random(5).randrange(97, 100) for _ in range(5000))
    monkeypatch.setattr(url_filter, "AT_ONCE", 64)
    _, gram, times = url_filter._long(text)
    _, all_grams = url_filter.grams([text])
    values, counts = np.unique(all_grams, return_counts=True)
    assert gram.tolist() == values.tolist() and times.tolist() == counts.tolist()


# ---- spelling variants ----

SPELT = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    meet = defaultdict(set)
    for w in words:
        meet[w].add(w)
        for k in range(len(w)):
            meet[w[:k] + w[k + 1:]].add(w)
            meet[w[:k] + "\0" + w[k + 1:]].add(w)
    near = defaultdict(set)
    for key, group in meet.items():
        for a in group:
            for b in group:
                # a shared deletion alone may be two edits apart
                if a != b and ("\0" in key or key in words and key in (a, b)):
                    near[a].add(b)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return in_order(out)


def spelt_rows(seed=7, docs=400):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(6, 11))) for _ in range(60)]
    base += ["nation" + x for x in ("alising", "alizing", "alizingg", "aliz\u00dfng")] + ["aaaaaaa", "aaaaaaaa", "abababab", "aaaaaaab"]
    base += ["x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 30 + "x" * 34, "y" * 30 + "z" + "x" * 34, "q" * 200, "q" * 100 + "Qr" + "q" * 99]
    weight = [3 ** rnd.randint(0, 6) for _ in base]
    rows = []
    for d in range(docs):
        words = rnd.choices(base, weight, k=40)
        for k in range(len(words)):
            if rnd.random() < 0.05:
                at = rnd.randrange(len(words[k]))
                words[k] = words[k][:at] + rnd.choice(["", "e", "zé"]) + words[k][at + 1:]
        rows.append((d, rnd.choice([" ", ", ", "1", "\n"]).join(w.title() if rnd.random() < .2 else w for w in words)))
    return rows + [(None, "nothing nothing Nothing"), (None, None), (1, ""), (2, "ÀÉÎÕÜ×÷ÿÿ ÀÉÎÕÜ×÷ÿÿ àÉÎÕÜ×÷ÿÿ àÉÎÕÜ×÷ÿÿ")]


@pytest.mark.parametrize("short_list", [64, 3])
def test_variants_match_brute_force(spark, monkeypatch, short_list):
    monkeypatch.setattr(spelling, "SHORT_LIST", short_list)
    for rows in (spelt_rows(), brute.TEXTS):
        got = rows_of(spelling.variants(brute.frame(spark, rows)), *SPELT)
        assert got == plain_variants(rows)
    assert any(r[1] for r in plain_variants(spelt_rows()))


def test_variants_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(spelling.variants(docs), *SPELT) == plain_variants(rows)
    assert spelling.variants(docs.where("false")).count() == 0


def test_runs_are_read_whole_across_slices(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 10)
    text = "abc defghijklmnopqrstuvw xyz, " * 20 + "a" * 100
    parts = list(spelling._slices(text))
    assert "".join(parts) == text and [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_keys_meet_for_every_edit_and_groups_are_bounded():
    """All near pairs share a key; a key's entries are few even where every
    gram is frequent."""
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(9, 11))) for _ in range(3000)})
    bits = {q: np.full(-(-spelling.BASE ** q // 65536) * 8192, 255, np.uint8) for q in (2, 3, 4)}
    held = defaultdict(set)
    for at in spelling.by_length(words):
        own, gaps = spelling.keys(spelling.letters([words[k] for k in at]), spelling.Dictionary(bits), spelling.Dictionary(bits))
        for k, row in zip(at.tolist(), own.tolist()):
            for i, key in enumerate(row):
                held[key].add((words[k], i, False))
        for k, row in zip(at.tolist(), gaps.tolist()):
            for i, key in enumerate(row):
                held[key].add((words[k], i, True))
    assert max(map(len, held.values())) <= 3  # two letters and a gap
    where = {}
    for key, entries in held.items():
        for w, i, gap in entries:
            where[w, i, gap] = key
    known = set(words)
    for w in words[:300]:
        for i in range(len(w)):
            other = w[:i] + ("b" if w[i] == "a" else "a") + w[i + 1:]
            if other in known:
                assert where[w, i, False] == where[other, i, False]
            if w[:i] + w[i + 1:] in known:
                assert where[w, i, False] == where[w[:i] + w[i + 1:], i, True]


# ---- very long texts ----

LONG = """
import resource, sys
sys.path.insert(0, {root!r})
from unittest import mock
import pyarrow as pa
from textpulse.llm import alignment, blocks, spelling, url_filter
text = "".join(f"wording{{chr(97 + i % 26)}}{{chr(97 + i // 26 % 26)}} and others line\\n"[:26] for i in range(850_000))
assert len(text) > 20_000_000
batch = pa.RecordBatch.from_pydict({{"doc_id": [1], "text": [text]}})
context = mock.Mock(partitionId=lambda: 0)
with mock.patch.object(blocks.TaskContext, "get", lambda: context):
    run = {{"align": lambda: alignment._encode(alignment.default_paths()), "spell": lambda: spelling._read}}[{what!r}]()
    base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(b.num_rows for b in run(iter([batch])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("what", ["align", "spell"])
def test_very_long_texts_take_bounded_memory(what):
    root = brute.__file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", LONG.format(root=root, what=what)], capture_output=True, text=True, check=True)
    rows, grown_mb = map(int, out.stdout.split())
    assert rows > 0 and grown_mb < 300, out.stdout
