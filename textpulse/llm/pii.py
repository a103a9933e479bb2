"""Personal data by weak supervision.

Spans of four kinds (email, ip, card, phone) are found in two sets. Base spans
match fixed patterns and always stay. Candidates are looser (obfuscated
addresses, defanged or version 6 IPs, cards with other separators, national
phone numbers). On both, labelers vote yes, no or nothing: regular expressions,
gazetteers (top-level domains, calling codes, issuer prefixes, address ranges)
and context (words and characters around). Expectation-maximisation estimates
each labeler's reliability per kind and with it the probability that a span is
personal data; on these probabilities a logistic span classifier is trained,
which decides which candidates are added.

One pass reads the texts and saves spans alone. EM and the classifier need only
how often each pattern of votes and features occurs, counted over all documents
by Spark; patterns are bounded by the labelers (3 ** 6 votes, 2 ** 4 features, 4
kinds), whatever the corpus. Every search is linear in the text.

Defined results: a null text is empty; offsets are code points, end exclusive;
an added span never overlaps a base span of its kind or another added one;
counts and base_sha256 cover base spans, ``spans`` all of them; repeated rows
and null ids give a row each; an empty table gives an empty table; other columns
may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import save

KINDS = ("email", "ip", "card", "phone")
LABELERS, BITS = 6, 4
CONTEXT = 32  # characters before a span that context labelers read

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = re.compile(r"\x20?(?:[\[({]\x20?at\x20?[\])}]|\x20@\x20?|@\x20|＠)\x20?", re.IGNORECASE)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63})+",
                          re.IGNORECASE)
DOT = re.compile(r"\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?", re.IGNORECASE)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])"
                      r"|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-]|\.[0-9])")
BRACKET_AT = re.compile(r"[\[({]\x20?[Aa][Tt]\x20?[\])}]")
DIGIT = re.compile(r"[0-9]")

# Gazetteers (fixed values)
TOP_DOMAINS = frozenset("com org net edu gov info biz io dev app co uk de fr es it nl eu us ca au jp test example".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
                 "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81",
                 "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "370", "380", "420", "421")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "2")
CUES = {"email": "mail email e-mail contact write reach correo courriel".split(),
        "ip": "ip host server address addr from login adresse".split(),
        "card": "card visa mastercard amex payment credit debit karte carte tarjeta".split(),
        "phone": "phone tel call mobile cell fax telefon telefono ring whatsapp".split()}
OTHERS = frozenset("version v isbn order invoice id ref section release build doi part".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards: the pattern's matches, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        size = len(before) - len(before.rstrip(LOCAL))
        match = DOMAIN.match(text, at + 1) if size else None
        if match:
            out.append((at - size, match.end()))
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _loose(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, normal form) of the candidates."""
    out, done = [], 0
    some = "@ " in text or " @" in text or "＠" in text or BRACKET_AT.search(text)
    for m in AT.finditer(text) if some else ():
        before = text[max(done, m.start() - 64):m.start()]
        size = len(before) - len(before.rstrip(LOCAL))
        domain = LOOSE_DOMAIN.match(text, m.end()) if size else None
        if domain:
            name = before[len(before) - size:] + "@" + DOT.sub(".", domain[0])
            out.append((0, m.start() - size, domain.end(), name))
            done = domain.end()
    if DIGIT.search(text):
        for m in LOOSE_IP.finditer(text):
            out.append((1, m.start(), m.end(), re.sub(r"\[\.\]|\(\.\)|\[dot\]", ".", m[0])))
        for m in LOOSE_CARD.finditer(text):
            out.append((2, m.start(), m.end(), re.sub(r"[._/]", "", m[0])))
        for m in LOOSE_PHONE.finditer(text):
            if not any(c in "0123456789+" for c in text[max(0, m.start() - 2):m.start()]):
                out.append((3, m.start(), m.end(), m[0]))
    return out


def _votes(text: str, kind: int, a: int, b: int, form: str, base: bool) -> str:
    """A digit for each labeler (0 nothing, 1 no, 2 yes), then the features' bits."""
    digits = "".join(c for c in form if c in "0123456789")
    if kind == 0:
        name, _, host = form.rpartition("@")
        end = host.rsplit(".", 1)[-1].lower()
        shape, listed, odd = end.isalpha() and 2 <= len(end) <= 10, end in TOP_DOMAINS, len(name) < 2
    elif kind == 1 and ":" in form:
        shape, listed, odd = True, form[0] in "23fF", len(set(form)) < 4
    elif kind == 1:
        parts = form.split(".")
        shape = all(_small(p) and (p == "0" or p[0] != "0") for p in parts)
        listed, odd = parts[0] not in ("0", "255"), all(len(p) == 1 for p in parts)
    elif kind == 2:
        shape, listed, odd = luhn(digits), digits.startswith(ISSUERS), len(set(digits)) < 3
    else:
        national = not form.startswith("+")
        shape = len(digits) == 10 and digits[0] > "1" and digits[3] > "1" if national else True
        listed = digits[0] > "1" if national else digits.startswith(CALLING_CODES)
        odd = len(set(digits)) < 3
    words = [w.lower() for w in WORD.findall(text[max(0, a - CONTEXT):a])[-3:]]
    cue = 2 if any(w in CUES[KINDS[kind]] for w in words) else 1 if any(w in OTHERS for w in words) else 0
    edge = not (a > 0 and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    yes = lambda x: "2" if x else "1"
    votes = yes(shape) + yes(listed) + str(cue) + yes(edge) + yes(not odd) + ("2" if base else "0")
    bits = (form == text[a:b], len(digits) >= 8, cue == 2, any(c in " ()[]{}" for c in text[a:b]))
    return votes + "".join("1" if x else "0" for x in bits)


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """All (kind, start, end, base, pattern) of a text."""
    base = base_spans(text)
    out = [(k, a, b, True, _votes(text, k, a, b, text[a:b], True)) for k, a, b in base]
    taken = {k: sorted((a, b) for x, a, b in base if x == k) for k in range(4)}
    for k, a, b, form in _loose(text):
        at = bisect_right(taken[k], (a, b))
        if (at and taken[k][at - 1][1] > a) or (at < len(taken[k]) and taken[k][at][0] < b):
            continue
        taken[k].insert(at, (a, b))
        out.append((k, a, b, False, _votes(text, k, a, b, form, False)))
    return out


SPAN = "struct<kind: int, start: int, end: int, base: boolean, pattern: string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                               ("base", pa.bool_()), ("pattern", pa.string())]))
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "base", "pattern"), s)) for s in find(t.as_py() or "")]
                 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """EM: probability that each vote pattern is a true span. Starts from the
    majority; a labeler's rates of yes given true and given false are smoothed
    towards 0.8 and 0.2."""
    said = votes > 0
    yes = votes == 2
    p = (yes.sum(axis=1) + 1) / (said.sum(axis=1) + 2)
    for _ in range(rounds):
        rates = []
        for w, prior in ((p, 0.8), (1 - p, 0.2)):
            w = (w * counts)[:, None]
            rates.append(((w * yes).sum(axis=0) + 4 * prior) / ((w * said).sum(axis=0) + 4))
        share = ((p * counts).sum() + 1) / (counts.sum() + 2)
        odds = np.log(share / (1 - share)) + np.where(
            yes, np.log(rates[0] / rates[1]), np.where(said, np.log((1 - rates[0]) / (1 - rates[1])), 0)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def span_classifier(patterns: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """Per (kind, pattern): the trained classifier's probability. ``patterns``:
    (kind, pattern, count) over the corpus."""
    out: dict[tuple[int, str], float] = {}
    for kind in range(len(KINDS)):
        own = sorted((p, n) for k, p, n in patterns if k == kind)
        if not own:
            continue
        votes = np.array([[int(c) for c in p[:LABELERS]] for p, _ in own])
        counts = np.array([n for _, n in own], np.float64)
        target = reliabilities(votes, counts)
        # what the classifier sees: the span's own features and the labelers, but
        # not whether the fixed pattern matched
        x = np.concatenate([np.ones((len(own), 1)), votes[:, :-1] == 2, votes[:, :-1] == 1,
                            np.array([[c == "1" for c in p[LABELERS:]] for p, _ in own])], axis=1).astype(float)
        weight, w = counts / counts.sum(), np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps, ridge 0.001
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (q - target)) + 1e-3 * w
            curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w - np.linalg.solve(curve, slope)
        for (p, _), q in zip(own, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))):
            out[kind, p] = float(q)
    return out


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) per row of ``docs``: an array of (kind, start, end, base),
    base spans and added ones, by kind, then start."""
    found = save(docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>"))
    counts = (found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.pattern")
              .agg(F.count(F.lit(1)).alias("n")).collect())  # bounded by the labelers and features
    chosen = {f"{k}{p}" for (k, p), q in span_classifier([tuple(r) for r in counts]).items() if q >= threshold}
    table = F.array(*[F.lit(c) for c in sorted(chosen)]).cast("array<string>")
    keep = F.filter("spans", lambda s: s["base"] | F.array_contains(table, F.concat(s["kind"].cast("string"), s["pattern"])))
    return found.select("doc_id", F.sort_array(F.transform(
        keep, lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"]))).alias("spans"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    out = pii_spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"),
                      _text(F.col("spans")).alias("spans"))
