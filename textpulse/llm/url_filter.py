"""URL filter by a character language-model ratio.

Rules (host, path) judge the URLs that they fit. What they accept and reject is
the training text of two variable-order Markov models over bytes: after up to
``ORDER`` bytes of context the next byte has the probability of the longest
context seen, smoothed by interpolation with the shorter ones (Witten and Bell:
a context with n followers of t kinds leaves t / (n + t) to its suffix), down to
an even spread. A URL's score is the difference of its log-likelihoods under the
two models, divided by its length. The threshold is calibrated on every fifth
labelled URL (crc32), which the models don't see: the cut with the best balanced
accuracy, in the middle of the best range. Other URLs are allowed from the
threshold on.

Models are counted over all labelled rows, none sampled: a task counts the byte
grams of its blocks of URLs (see ``blocks``), sums by gram make the counts,
shorter contexts are sums of longer ones, and probabilities follow order by
order on distinct grams. Each gram's log ratio goes back to the blocks that hold
it. Nothing about the models passes the driver; it sees the calibration
histogram (``BINS`` a unit, scores cut at +-``RANGE``).

Defined results: host and path of a null url, or one without ``://``, are empty,
no rule fits, and the models judge the text there is (none: score 0); if no URL
is accepted, or none rejected, by a rule, there is nothing to compare and the
threshold is minus infinity (allow); without calibration rows of both kinds it is
0; rows are judged each, repeated or not; an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.llm.blocks import Block, pack, products, vectors
from textpulse.llm.common import UPPER, save

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, BITS, END = 5, 9, 257  # symbols: 0 before the start, byte + 1, END
AT_ONCE = 1 << 19  # bytes of URLs worked on together
BINS, RANGE = 512, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host lower-cased (A-Z), the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()),
            F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits a host
    or one of its parents and the start of a path; null without one."""
    name = action = None
    for verdict, domain, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, domain + prefix) if name is None else name.when(fits, domain + prefix)
        action = F.when(fits, verdict) if action is None else action.when(fits, verdict)
    return name, action


def model_text(url: Column) -> Column:
    """What the models read: the URL after its scheme, the host lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.concat(F.translate(host, UPPER, UPPER.lower()),
                               F.substring(rest, F.length(host) + F.lit(1), F.length(rest))), F.lit(""))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) for every byte of the texts and the end of each: the byte
    after its ``ORDER`` symbols of context, packed."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER + 1
    last = np.cumsum(size)
    symbols = np.zeros(int(last[-1]) if len(size) else 0, np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(symbols)) - np.repeat(last - size, size)
    inner = (at >= ORDER) & (at < np.repeat(size, size) - 1)
    symbols[inner] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    symbols[last - 1] = END
    gram = symbols.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= symbols[:-k] << (BITS * k)
    keep = at >= ORDER
    return owner[keep], gram[keep] & ((1 << BITS * (ORDER + 1)) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (idx null) with their grams, and the grams of each block with their
    numbers in accepted and in rejected URLs of the learning rows."""
    block, names, kinds = Block(2), None, None

    def close() -> Iterator[pa.RecordBatch]:
        gram, (accepted, rejected) = block.keys()
        for a in range(0, len(gram), 50_000):
            part = slice(a, min(a + 50_000, len(gram)))
            n = part.stop - a
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(n, k) for k in kinds], pa.array([block.id] * n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.binary()), pa.array(np.arange(a, part.stop, dtype=np.int32)), pa.array(gram[part]),
                 pa.array(accepted[part]), pa.array(rejected[part])], names)

    for batch in batches:
        kinds = [c.type for c in batch.columns[1:]]
        names = [*batch.schema.names[1:], "block", "length", "items", "idx", "gram", "accepted", "rejected"]
        learned = batch.column(1).to_pylist()  # 1: accepted, -1: rejected, 0: not for learning
        held: list[tuple[int, list[bytes]]] = []
        texts = batch.column(0).cast(pa.binary())
        sizes = np.zeros(batch.num_rows, np.int64)
        begin = 0
        while begin < batch.num_rows:
            stop, total = begin, 0
            while stop < batch.num_rows and (stop == begin or total < AT_ONCE):
                sizes[stop] = len(texts[stop].as_py())
                total += sizes[stop]
                stop += 1
            held = [texts[k].as_py() for k in range(begin, stop)]
            if len(held) == 1 and len(held[0]) > AT_ONCE:
                owner, gram, times = _long(held[0])
            else:
                owner, gram = grams(held)
                values, inverse = np.unique(gram, return_inverse=True)
                owner, which, times = vectors(owner, inverse.reshape(-1))
                gram = values[which]
            values, inverse = np.unique(gram, return_inverse=True)
            number = block.number(values)[inverse.reshape(-1)]
            label = np.array(learned[begin:stop])[owner]
            for sum_, sign in enumerate((1, -1)):
                block.add(sum_, number[label == sign], times[label == sign])
            order = np.lexsort((number, owner))
            owner, number, times = owner[order], number[order], times[order]
            edges = np.searchsorted(owner, np.arange(len(held) + 1))
            items = [pack(number[a:b], times[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            n = stop - begin
            part = batch.slice(begin, n)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([block.id] * n, pa.int64()), pa.array(sizes[begin:stop] + 1),
                 pa.array(items, pa.binary()), *[pa.nulls(n, t) for t in (pa.int32(), *[pa.int64()] * 3)]], names)
            if block.full():
                yield from close()
                block = Block(2, block.serial + 1)
            begin = stop
    if names is not None:
        yield from close()


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of one long text and how often each occurs, read in
    slices that begin with the context of the one before."""
    seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(text), AT_ONCE):
        before = text[max(0, a - ORDER):a]
        _, gram = grams([before + text[a:a + AT_ONCE]])
        gram = gram[len(before):len(gram) - (a + AT_ONCE < len(text))]  # the end is the last slice's
        seen, inverse = np.unique(np.concatenate((seen, gram)), return_inverse=True)
        times = np.bincount(inverse.reshape(-1), np.concatenate((times, np.ones(len(gram))))).astype(np.int64)
    return np.zeros(len(seen), np.int64), seen, times


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): the difference of the log-probabilities of each gram's last
    symbol under the two models, from (gram, accepted, rejected)."""
    both = ("accepted", "rejected")
    levels = [counts]
    for k in range(ORDER - 1, -1, -1):
        mask = (1 << BITS * (k + 1)) - 1
        levels.append(save(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"))
                           .agg(*[F.sum(c).alias(c) for c in both])))
    shorter = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.shiftright("gram", BITS))  # at most END followers
        level = level.select("gram", *both, *[f(c).over(context).alias(f"{name}_{c}") for c in both for name, f in (
            ("all", F.sum), ("kinds", lambda x: F.sum((F.col(x) > 0).cast("long"))))])
        if shorter is None:
            level = level.select("*", *[F.lit(1 / END).alias(f"low_{c}") for c in both])
        else:
            mask = (1 << BITS * k) - 1
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(shorter, "suffix")
        p = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"low_{c}"))
                       / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"low_{c}")) for c in both}
        shorter = level.select(F.col("gram").alias("suffix"), *[p[c].alias(f"low_{c}") for c in both])
    return shorter.select(F.col("suffix").alias("gram"),
                          (F.log("low_accepted") - F.log("low_rejected")).alias("ratio"))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The cut with the best balanced accuracy over (bin, accepted, rejected)
    counts, where bins from the cut on are accepted; the middle of the range if
    several cuts are as good (the first such range)."""
    bins = sorted(bins)
    accepted, rejected = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not accepted or not rejected:
        return 0.0
    best, cut, above, below = -1.0, 0.0, accepted, 0
    for k in range(len(bins) + 1):
        value = above / accepted + below / rejected
        if value > best + 1e-12:
            low = bins[k - 1][0] + 1 if k else bins[0][0]
            high = bins[k][0] if k < len(bins) else bins[-1][0] + 1
            best, cut = value, (low + high) / 2 / BINS
        if k < len(bins):
            above -= bins[k][1]
            below += bins[k][2]
    return cut


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every row's page_id, host, path, rule, verdict and score."""
    host, path = host_and_path(F.col("url"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.select(model_text(F.col("url")).alias("text"), F.crc32(F.coalesce("url", F.lit("")).cast("binary"))
                       .alias("crc"), "page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    label = F.when(F.col("action") == "allow", 1).when(F.col("action") == "block", -1).otherwise(0)
    learned = F.when(F.col("crc") % 5 == 0, 0).otherwise(label)
    rows = rows.select("text", learned.alias("learned"), label.alias("label"),
                       "page_id", "host", "path", "rule", "action")
    kind = pages.schema["page_id"].dataType.simpleString()
    found = save(rows.mapInArrow(_count, f"learned int, label int, page_id {kind}, host string, path string, rule string, "
                                 "action string, block long, length long, items binary, idx int, gram long, "
                                 "accepted long, rejected long"))
    keys = found.where("idx IS NOT NULL").select("block", "idx", "gram", "accepted", "rejected")
    counts = save(keys.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    values = keys.select("block", "idx", "gram").join(log_ratios(counts), "gram")
    rows = found.where("idx IS NULL").drop("idx", "gram", "accepted", "rejected")
    scored = save(products(rows, values, ["ratio"]).withColumn(
        "score", F.when(F.col("length") > 1, F.col("ratio") / F.col("length")).otherwise(0.0)))
    held_out = scored.where("label <> 0 AND learned = 0")
    at = F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) * BINS).cast("long")
    bins = [tuple(r) for r in held_out.groupBy(at.alias("at")).agg(
        F.sum((F.col("label") > 0).cast("long")), F.sum((F.col("label") < 0).cast("long"))).collect()]
    sides = scored.agg(F.max("label"), F.min("label")).first()
    cut = threshold(bins) if tuple(sides) == (1, -1) else float("-inf")
    model = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("action", model).alias("verdict"), "score")


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """The allowed rows' page_id and score."""
    return judged(pages, rules).where("verdict = 'allow'").select("page_id", "score")
