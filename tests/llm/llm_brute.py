"""Plain-Python versions of the contracts, for small inputs, and a nasty table."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

CLASHING = ("row", "lines", "line", "pos", "gone", "key", "w", "fp", "part", "start", "block", "cell", "tag",
            "spans", "score", "kept", "items", "text_hash", "n_words", "component", "node", "a", "b", "u", "v",
            "word", "token", "window_id", "seq", "h1", "label", "held_out", "n_dropped", "low", "members")

PASSAGE = " ".join(f"passage{i:02d}" for i in range(30))
LINE = "This very line is found in many of the documents, " + "x" * 10

TEXTS = [
    (1, PASSAGE + " tail one\n" + LINE + "\nend"),
    (2, None), (3, ""), (4, " \t\n\x0b "), (5, "one two three"), (6, "ONE two\tTHREE"),
    (7, "pre " + PASSAGE + " more words here\n" + LINE.upper() + " "),
    (8, PASSAGE + " tail one\n" + LINE + "\nend"), (8, PASSAGE + " tail one\n" + LINE + "\nend"),
    (9, LINE + "\n" + LINE + "\nünïcödé ÄÖÜ straße é" * 3),
    (10, "\n".join([LINE] * 4)), (11, LINE), (12, "  " + LINE + "\t\nrest of it"),
    (13, "the " * 3000 + PASSAGE[:200] + " the" * 3000), (14, "the " * 60), (15, "the " * 61),
    (16, "a@b.co, +49 (30) 1234-5678 and 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111; x@y"),
    (17, "z" * 5000), (18, "z" * 4999 + "y"), (19, "日本語 " * 40), (20, "日本語 " * 41),
    (None, PASSAGE + "\n" + LINE), (None, None),
    (-3, PASSAGE.replace("passage05", "PASSAGE05")), (21, "\n\n\n"), (22, "|".join("ab" * 30 for _ in range(20))),
]


def frame(spark, rows=TEXTS):
    """Documents with every clashing column beside the usual ones."""
    data = [(i, t, ("en", "de", None)[k % 3], ("web", "book", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fingerprint(text, size=4):
    w = words(lower(text))
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """Class of each of n things; ``linked`` yields pairs."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    part = components(len(rows), ((i, j) for i in range(len(rows)) for j in range(i)
                                  if (fps[i] ^ fps[j]).bit_count() <= bits))
    out = []
    for (d, _), f, p in zip(rows, fps, part):
        ids = [x for (x, _), q in zip(rows, part) if q == p and x is not None]
        out.append((d, f"{f:016x}", min(ids, default=None)))
    return out


def line_dedup(rows, least=40, docs=5):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for d, lines in split:
        for line in lines if d is not None else ():
            if len(key(line)) >= least:
                found.setdefault(key(line), set()).add(d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if d is None or len(found.get(key(x), ())) < docs or max(found[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(rows, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = set()
    for i, t in items:
        w = cut(t)
        if w:
            wins |= {(i, tuple(w[k:k + size])) for k in range(max(1, len(w) - size + 1))}
    out = []
    for d, t in rows:
        w, hit, names = cut(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def _covered(rows, size):
    """Per row: which places windows that start in a smaller document cover."""
    first = {}
    for d, s in rows:
        for k in range(len(s) - size + 1 if d is not None else 0):
            w = s[k:k + size] if isinstance(s, bytes) else tuple(s[k:k + size])
            first[w] = min(first.get(w, d), d)
    for d, s in rows:
        gone = [False] * len(s)
        for k in range(len(s) - size + 1 if d is not None else 0):
            w = s[k:k + size] if isinstance(s, bytes) else tuple(s[k:k + size])
            if first[w] < d:
                gone[k:k + size] = [True] * size
        yield gone


def substrings(rows, size=13):
    split = [(d, words(t)) for d, t in rows]
    return [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y)))
            for (d, w), g in zip(split, _covered(split, size))]


def suffixes(rows, size=50):
    raw = [(d, (t or "").encode()) for d, t in rows]
    return [(d, len(b), sum(g), sum(y and not x for x, y in zip([False, *g], g)),
             sha(bytes(c for c, y in zip(b, g) if not y))) for (d, b), g in zip(raw, _covered(raw, size))]


def personal(text):
    """(kind, start, end) by the plain patterns."""
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                                 r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                                 r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))
                    or k == 2 and (not 13 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in double) % 10)
                    or k == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def collected(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def expected(rows):
    return sorted(map(repr, rows))
