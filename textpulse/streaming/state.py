"""Keyed state in the state store.

Both operators work alike: a micro-batch is reduced inside its tasks, before the
shuffle, to what can still matter (the newest rows of a key, the counts of a
day's buckets), so that a hot key costs a few rows an Arrow batch; then a stateful
processor merges it with the state of the keys that the batch has, and only
those. The work of a batch depends on its own keys, not on the keys or the
batches seen before. State lies in RocksDB beside the query's checkpoint: a
restarted query goes on where it was, a retried batch starts from the state
before it. With ``idle``, event time bounds the state: rows that are older than
``idle`` before the newest row seen come too late to count, and keys that have no
newer ones lose their state (a timer in event time; the sinks keep their rows).

The processors run in ``update`` mode: every batch gives one row for each key it
touched (see ``runner.run_updates`` and ``runner.latest``).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textpulse.operators.drift import PSI_EPSILON

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Expiring(StatefulProcessor):
    """A key's state goes when the watermark passes its newest row: one timer a
    key, moved with it."""

    def __init__(self, expires: bool):
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def keep_until(self, at: int) -> None:
        if not self.expires:
            return
        due = list(self.handle.listTimers())
        if not due or max(due) < at:
            for old in due:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.drop()
        return iter(())

    def close(self) -> None:
        pass


def _processed(rows: DataFrame, key: str, ts: str, idle: str | None, make, schema: str) -> DataFrame:
    if idle:
        rows = rows.withWatermark(ts, idle)
    return rows.groupBy(key).transformWithState(make(bool(idle)), schema, "Update", "EventTime" if idle else "None")


def _newest_of(n: int):
    """The newest ``n`` rows by (ts, id) of each key in an Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(pa.Table.from_batches([batch]), [
                ("key", "ascending"), ("ts", "descending"), ("id", "descending")])
            rows = batch.take(order)
            key = rows.column("key").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
            rank = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
            yield rows.filter(pa.array(rank < n))
    return run


class NewestRecords(_Expiring):
    """State: the newest ``n`` labelled records of a key, as a list."""

    def __init__(self, n: int, expires: bool):
        super().__init__(expires)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getListState("newest", "at bigint, id bigint, ok boolean")

    def drop(self) -> None:
        self.newest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = heapq.nlargest(self.n, chain(
            ((r[0], r[1], r[2]) for r in self.newest.get()), ((r["at"], r["id"], r["ok"]) for r in rows)),
            key=lambda r: r[:2])
        self.newest.put(kept)
        self.keep_until(kept[0][0] // 1000)
        yield Row(key=key[0], total_samples=len(kept), correct=sum(ok for _, _, ok in kept))


def rolling_last_n(pred: DataFrame, n: int, idle: str | None = None) -> DataFrame:
    """I4: ``(key, total_samples, correct, accuracy)`` over the newest ``n``
    labelled records of each key that a batch has, in whatever order they
    arrive. ``pred`` has no watermark of its own."""
    labelled = pred.where(F.col("true_label").isNotNull()).select(
        "key", "ts", F.unix_micros("ts").alias("at"), "id", (F.col("prediction") == F.col("true_label")).alias("ok"))
    kind = dict(labelled.dtypes)["key"]
    few = labelled.mapInArrow(_newest_of(n), f"key {kind}, ts timestamp, at bigint, id bigint, ok boolean")
    out = _processed(few, "key", "ts", idle, lambda expires: NewestRecords(n, expires),
                     f"key {kind}, total_samples bigint, correct bigint")
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("total_samples"), 3))


def _bucket_counts(edges: list[float]):
    """(ts, at, day, bucket, cnt) of an Arrow batch of (ts, at, day, value): the
    number of edges at or below a value is its bucket; ts and at (the same in
    microseconds) are the newest of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = np.array(sorted(edges), np.float64)
        for batch in batches:
            value = batch.column(3).to_numpy(zero_copy_only=False)
            rows = pa.table({"ts": batch.column(0), "at": batch.column(1), "day": batch.column(2), "bucket": pa.array(
                np.searchsorted(inner, value, side="right").astype(np.int32))})
            counts = rows.group_by(["day", "bucket"]).aggregate([("ts", "max"), ("at", "max"), ([], "count_all")])
            counts = counts.select(["ts_max", "at_max", "day", "bucket", "count_all"])
            yield from counts.rename_columns(["ts", "at", "day", "bucket", "cnt"]).to_batches()
    return run


class DayCounts(_Expiring):
    """State: a day's count of each bucket, as a map; the result is the day's
    PSI against the baseline shares."""

    def __init__(self, shares: list[float], expires: bool):
        super().__init__(expires)
        self.shares = shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "bucket int", "cnt bigint")

    def drop(self) -> None:
        self.counts.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changed: dict[int, int] = {}
        until = 0
        for r in rows:
            changed[r["bucket"]] = changed.get(r["bucket"], 0) + r["cnt"]
            until = max(until, r["at"] // 1000)
        self.keep_until(until)
        own = {k[0]: v[0] for k, v in self.counts.iterator()}
        for bucket, n in changed.items():
            own[bucket] = own.get(bucket, 0) + n
            self.counts.updateValue((bucket,), (own[bucket],))
        total = sum(own.values())
        a = np.array([own.get(b, 0) / total for b in range(len(self.shares))])
        a, e = (np.where(x == 0, PSI_EPSILON, x) for x in (a, np.array(self.shares)))
        yield Row(day=key[0], psi_raw=float(((a - e) * np.log(a / e)).sum()), production_rows=total)


def daily_psi(pred: DataFrame, value_col: str, edges: list[float], shares: list[float],
              idle: str | None = None) -> DataFrame:
    """``(day, psi_raw, production_rows)`` of each day that a batch has:
    its bucket counts so far against the baseline ``shares`` of the buckets
    between the interior ``edges`` (one share more than edges). ``pred`` has no
    watermark of its own."""
    rows = pred.where(F.col(value_col).isNotNull()).select(
        "ts", F.unix_micros("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col(value_col).cast("double").alias("value"))
    counts = rows.mapInArrow(_bucket_counts(edges), "ts timestamp, at bigint, day string, bucket int, cnt bigint")
    return _processed(counts, "day", "ts", idle, lambda expires: DayCounts(shares, expires),
                      "day string, psi_raw double, production_rows bigint")
