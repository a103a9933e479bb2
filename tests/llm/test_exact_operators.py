"""Operators with exact contracts against plain Python, on a table with nulls,
empty and long texts, ties, repeated rows and clashing columns; SQL on sf0.001."""

import random
import re
import subprocess
import sys

import duckdb
import pytest

import llm_brute as brute
from textpulse.llm import decontaminate, line_dedup, registry, simhash, substring, suffixes
from textpulse.llm.common import components, split_hot

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark).cache()


def near_copies(n=60, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for d in range(n):
        w = list(base) if d % 3 else [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append((rng.randrange(10_000), " ".join(w)))
    return out


def test_simhash_matches_brute_force(spark, docs):
    for df, rows in ((docs, brute.TEXTS), (brute.frame(spark, near_copies()), near_copies())):
        got = brute.collected(simhash.simhash_groups(df), "doc_id", "fingerprint", "component_id")
        assert got == brute.expected(brute.simhash(rows))


def test_simhash_anchors_meet_for_every_close_pair():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(5):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(b)
        keys = [set(simhash.anchors(np.array([a]))[0].tolist()) for a in x]
        others = [set(simhash.anchors(np.array([b]))[0].tolist()) for b in y]
        assert all(a & b for a, b in zip(keys, others))


def test_simhash_hot_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rows = near_copies(90, 5)
    got = brute.collected(simhash.simhash_groups(brute.frame(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == brute.expected(brute.simhash(rows))


def test_split_hot_lets_every_pair_meet(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(50)], "key long, member long")
    cells = {}
    for r in split_hot(df, "key", "member", 7).collect():
        cells.setdefault((r.key, r.cell_i, r.cell_j), set()).add(r.member)
    met = {(a, b) for c in cells.values() for a in c for b in c}
    assert all((a, b) in met for a in range(50) for b in range(50) if a % 2 == b % 2)
    assert max(map(len, cells.values())) < 25


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (500, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 500: 0, **{100 + k: 100 for k in range(60)}}


def test_line_dedup_matches_brute_force(docs):
    got = line_dedup.line_dedup(docs)
    got = brute.collected(got.selectExpr("row.doc_id", "n_lines", "n_dropped", "kept"),
                          "doc_id", "n_lines", "n_dropped", "kept")
    assert got == brute.expected(brute.line_dedup(brute.TEXTS))


def test_decontamination_matches_brute_force(spark, docs):
    items = [(1, brute.PASSAGE), (2, "ONE Two three"), (3, None), (4, ""), (5, "straße é"), (5, "the"), (6, "!!"),
             (None, "rest of"), (7, brute.PASSAGE + " the"), (7, brute.PASSAGE + " the"), (8, "the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS w", "2 AS seq", "3 AS k")
    got = brute.collected(decontaminate.digest(docs, bench),
                          "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.expected(brute.contamination(brute.TEXTS, items))
    for none in ([], [(1, None)]):
        empty = spark.createDataFrame(none, "item_id long, text string")
        got = brute.collected(decontaminate.digest(docs, empty),
                              "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == brute.expected(brute.contamination(brute.TEXTS, none))


def test_decontamination_shuffles_no_words(spark, docs, monkeypatch):
    items = [(1, brute.PASSAGE), (2, "ONE Two three"), (5, "the"), (7, brute.PASSAGE + " the"), (8, "the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plans, save = [], decontaminate.save

    def noted(df):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return save(df)
    monkeypatch.setattr(decontaminate, "save", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = brute.collected(decontaminate.digest(docs, bench),
                              "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute.expected(brute.contamination(brute.TEXTS, items))
    places = [p for p in plans if re.search(r"Exchange\nInput \[\d+\]: \[.*pos#", p)]
    assert places and not any(re.search(r"Exchange\nInput \[\d+\]: \[.*\bw#", p) for p in plans)


def test_substring_dedup_matches_brute_force(spark, docs):
    for df, rows in ((docs, brute.TEXTS), (brute.frame(spark, near_copies()), near_copies())):
        got = brute.collected(substring.digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == brute.expected(brute.substrings(rows))


def test_suffix_dedup_matches_brute_force(spark, docs):
    for df, rows in ((docs, brute.TEXTS), (brute.frame(spark, near_copies(30)), near_copies(30))):
        got = brute.collected(suffixes.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.expected(brute.suffixes(rows))


def test_long_texts_in_pieces_and_small_buckets(spark, monkeypatch):
    """Chunk borders inside documents, many buckets and several batches change nothing."""
    from textpulse.llm import windows
    rows = [(d, t * 3) for d, t in near_copies(12)]
    words = brute.expected(brute.substrings(rows))
    data = brute.expected(brute.suffixes(rows))
    monkeypatch.setattr(windows, "BUCKET_BYTES", 500)
    for module in (substring, suffixes):
        monkeypatch.setattr(module, "CHUNK", 300)
    monkeypatch.setattr(windows, "BATCH_BYTES", 2000)
    monkeypatch.setattr(windows, "BATCH_KEYS", 200)
    df = brute.frame(spark, rows)
    assert brute.collected(substring.digest(df), "doc_id", "n_words", "n_removed", "kept_sha256") == words
    assert brute.collected(suffixes.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == data


@pytest.mark.parametrize("most", [0, 3])
def test_minimisers_of_many_strings_go_window_by_window(spark, monkeypatch, most):
    from textpulse.llm import windows
    monkeypatch.setattr(windows, "HOT_STRINGS", most)
    monkeypatch.setattr(windows, "HOT_STEP", 50)
    rows = near_copies(40, 8) + brute.TEXTS
    df = brute.frame(spark, rows)
    got = brute.collected(substring.digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.expected(brute.substrings(rows))
    got = brute.collected(suffixes.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.expected(brute.suffixes(rows))


@pytest.mark.parametrize("module", [substring, suffixes])
def test_no_bucket_holds_all_strings_of_a_common_phrase(module):
    """A phrase that stands in every document in other surroundings is one
    minimiser of many strings; split, its windows spread over the buckets."""
    import numpy as np
    import pyarrow as pa
    from textpulse.llm import windows
    rng = random.Random(11)
    docs = [" ".join([f"q{rng.randrange(10**9)}" for _ in range(12)] + ["of all that is known"]
                     + [f"q{rng.randrange(10**9)}" for _ in range(12)]).encode() for _ in range(400)]
    box_runs = module._runs(np.zeros(len(docs), np.int64), tuple(docs))
    ids, tags = np.arange(400, dtype=np.int64)[box_runs.doc], np.zeros(len(box_runs.doc), np.int32)
    keys = windows.Keybox(1, 1 << 20)
    keys.add(box_runs, ids, tags, None)
    batches = list(keys.rows())
    most = {}
    for limit in (1 << 16, 20):
        starts = pa.Table.from_batches(windows._sift(limit)(iter(batches))).to_pydict()
        known = {(d, s >> 1): 1 + (s & 1) for d, s in zip(starts["doc_id"], starts["start"])}
        named = np.array([known.get(x, 0) for x in zip(ids.tolist(), box_runs.starts.tolist())])
        out = windows.Outbox(1, 1 << 30)
        out.add(box_runs, ids, tags, named)
        minimisers = np.concatenate(out.mins)
        most[limit] = int(np.unique(minimisers, return_counts=True)[1].max())
    assert most[1 << 16] >= 100 and most[20] <= 20, most


def test_string_hashes_follow_the_content():
    import numpy as np
    rng = random.Random(12)
    texts = tuple(" ".join(rng.choice("ab") for _ in range(rng.randrange(60))).encode() for _ in range(300))
    for module in (substring, suffixes):
        runs = module._runs(np.zeros(len(texts), np.int64), texts)
        begin, end = runs.spans(runs.first, runs.last)
        strings = [runs.text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        pairs = set(zip(strings, runs.hashes(runs.first, runs.last).tolist()))
        assert len(pairs) == len(set(strings)) == len({h for _, h in pairs})


def test_word_pieces_hold_every_window_once(monkeypatch):
    rng = random.Random(13)
    for size in (5, 40, 200, 10_000):
        monkeypatch.setattr(substring, "CHUNK", size)
        text = "".join(rng.choice(["a", "bc", "d" * 30]) + rng.choice([" ", "  ", "\n\t"]) for _ in range(300)).encode()
        for t in (text, b" " + text, text.strip(), b"x" * 100, b"", b" "):
            words, got = t.split(), []
            for at, piece in substring._pieces(t):
                own = piece.split()
                got += [(at + k, tuple(own[k:k + 13])) for k in range(len(own) - 12)]
            assert sorted(got) == [(k, tuple(words[k:k + 13])) for k in range(len(words) - 12)]
            half = len(words) // 2
            spans = [3 << 20 | 4, half << 20 | 1] if half > 10 else None
            gone = {3, 4, 5, 6, half} if spans else set()
            assert substring._kept(t, spans) == (
                len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone))


def test_long_text_of_words_takes_bounded_memory():
    root = brute.__file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", LONG.format(root=root)], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500, out.stdout


LONG = """
import random, resource, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from functools import partial
from textpulse.llm import substring, windows
rng = random.Random(1)
text = " ".join(f"word{{rng.randrange(10**6)}}" for _ in range(2_200_000))
assert len(text) > 20_000_000
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([0], pa.int32())], ["doc_id", "text", "tag"])
data = text.encode()
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
emit = windows._emit(substring._runs, substring._pieces, substring.CHUNK, partial(windows.Keybox, 16, 1 << 20))
assert sum(b.num_rows for b in emit(iter([batch])))
assert substring._kept(data, [0 << 20 | 13])[:2] == (2_200_000, 13)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


def test_general_outputs_hold_the_texts(spark):
    rows = near_copies(9)
    got = {r.doc_id: r.kept for r in substring.substring_dedup(brute.frame(spark, rows)).collect()}
    assert {d: brute.sha(k) for d, k in got.items()} == {d: s for d, _, _, s in brute.substrings(rows)}
    got = {r.doc_id: bytes(r.kept) for r in suffixes.suffix_dedup(brute.frame(spark, rows)).collect()}
    assert {d: brute.sha(k) for d, k in got.items()} == {d: s for d, _, _, _, s in brute.suffixes(rows)}


def test_deep_shallow_orders_like_sorting():
    import numpy as np
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(60)).encode() * 6 + bytes(rng.randrange(97, 100) for _ in range(4000))
    at = np.arange(len(text) - suffixes.WINDOW + 1)
    live, classes = suffixes.deep_shallow(text, at)
    seen = {}
    for k in at.tolist():
        seen.setdefault(text[k:k + suffixes.WINDOW], []).append(k)
    shared = {tuple(v) for v in seen.values() if len(v) > 1}
    found = {}
    for k, c in zip(live.tolist(), classes.tolist()):
        found.setdefault(c, []).append(k)
    assert {tuple(sorted(v)) for v in found.values() if len(v) > 1} == shared


def test_multikey_quicksort_keeps_ties_in_order():
    import numpy as np
    rng = random.Random(5)
    for letters, n in (("ab", 3000), ("a", 200), ("abcdefgh", 2000), ("ab", 51)):
        text = "".join(rng.choice(letters) for _ in range(n)).encode() * 2
        at = np.array(rng.sample(range(len(text) - suffixes.WINDOW + 1), min(n, len(text) - suffixes.WINDOW)))
        live, tie = suffixes.multikey_ties(text, at)
        keys = [text[p:p + suffixes.SHALLOW] for p in at.tolist()]
        own = [keys[k] for k in live.tolist()]
        assert own == sorted(k for k in keys if keys.count(k) > 1)
        assert [a == b for a, b in zip(own, own[1:])] == (tie[1:] == tie[:-1]).tolist()
    assert len(suffixes.multikey_ties(text, at[:0])[0]) == 0


def test_blind_trie_orders_and_groups():
    rng = random.Random(6)
    tails = ["".join(rng.choice("ab\x00\xff") for _ in range(6)).encode("latin-1") for _ in range(300)]
    classes = suffixes.blind_trie(tails)
    rank = {t: k for k, t in enumerate(sorted(set(tails)))}
    assert classes == [rank[t] for t in tails]


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op9", "op10", "op3", "op7", "op8"])
def test_empty_tables(spark, tmp_path, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    query = next(q for k, q in registry.QUERIES.items() if k.startswith(name + "_"))
    assert query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    answer = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert brute.expected(tuple(r) for r in answer.fetchall()) == brute.collected(df, *columns)
