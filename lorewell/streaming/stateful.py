"""Keyed state: request-anchored rate windows and the document status machine.

State is a few numbers per key. A key's rows of one batch arrive as chunks and
are reduced to counts per millisecond (or per change) before they are folded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lorewell.operators.maintenance import NEXT_STATUS

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A settled document is remembered this long, so that what still comes for it is judged against its end.
KEEP_HOURS = 24 * 7


def anchored_limits(requests: DataFrame, key: str, ts: Column | str, limit: int, window_ms: int = 60_000) -> DataFrame:
    """Requests over the limit, per (key, window): how many are refused in this batch.

    The window opens with the first request after the previous one ended and is
    remembered across batches, like a counter that expires.
    """
    stamp = F.col(ts) if isinstance(ts, str) else ts
    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(F.col(key).alias("key"), F.unix_millis(stamp.cast("timestamp")).alias("ms"))

    def count(group, frames, state):
        tally: Counter = Counter()
        for frame in frames:
            tally.update(frame["ms"].tolist())
        start, used = state.get if state.exists else (None, 0)
        refused: Counter = Counter()
        for ms in sorted(tally):
            if start is None or ms >= start + window_ms:
                start, used = ms, 0
            over = max(used + tally[ms] - limit, 0) - max(used - limit, 0)
            used += tally[ms]
            if over:
                refused[start] += over
        state.update((start, used))
        yield pd.DataFrame([(group[0], s, n) for s, n in refused.items()], columns=["key", "window_start_ms", "n_refused"])

    out = timed.groupBy("key").applyInPandasWithState(
        count, f"key {kind}, window_start_ms long, n_refused long", "start long, used long", "append", "NoTimeout")
    return out.withColumnRenamed("key", key)


SETTLED = tuple(a for a, following in NEXT_STATUS.items() if not following)
_ALLOWED = {(a, b) for a, following in NEXT_STATUS.items() for b in following}
_ALLOWED |= {(a, "failed") for a in NEXT_STATUS if a not in SETTLED} | {(None, "pending")}


def status_changes(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every status change with the state before it and whether the step is allowed.

    Remembers every document for ever, for logs of a bounded set of documents; see ``status_machine``.
    """
    kind = log.schema[key].dataType.simpleString()
    rows = log.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "status")

    def step(group, frames, state):
        changes = sorted((at, seq, status) for f in frames for at, seq, status in zip(f["at"], f["seq"], f["status"]))
        previous = state.get[0] if state.exists else None
        out = []
        for _, seq, status in changes:
            out.append((group[0], seq, previous, status, (previous, status) in _ALLOWED))
            previous = status
        state.update((previous,))
        yield pd.DataFrame(out, columns=["key", "seq", "previous", "status", "allowed"])

    out = rows.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, seq long, previous string, status string, allowed boolean", "status string", "append", "NoTimeout")
    return out.withColumnRenamed("key", key)


class _StatusMachine(StatefulProcessor):
    """Last status and its time per document; a settled document is forgotten ``keep`` microseconds later."""

    def __init__(self, keep: int) -> None:
        self._keep = keep

    def init(self, handle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "status string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes = sorted((r.at, r.seq, r.status) for r in rows)
        known = self._last.exists()
        previous, since = self._last.get() if known else (None, None)
        settled = known and previous in SETTLED
        for at, seq, status in changes:
            # by the times of the log, not of the batches: where batches end changes no row
            if previous in SETTLED and at - since >= self._keep:
                previous = None
            yield Row(key=key[0], seq=seq, previous=previous, status=status, allowed=(previous, status) in _ALLOWED)
            previous, since = status, at
        self._last.update((previous, since))
        if settled:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
        if previous in SETTLED:
            self._handle.registerTimer(max(-(-(since + self._keep) // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


def status_machine(log: DataFrame, key: str = "doc_id", keep_hours: int = KEEP_HOURS, late: str = "1 hour") -> DataFrame:
    """``status_changes`` with a state that empties: ``key, seq, previous, status, allowed`` for ``log(key, ts, seq, status)``.

    A document that completed or failed is forgotten once ``keep_hours`` have passed in the log's own
    time; a change that comes after that starts it anew, so it must be ``pending``. Until then every further
    change is judged against the end. Open documents are never forgotten. Rows that are more than ``late`` behind
    the newest of earlier batches are dropped, as are rows without a time or a status. Start it by ``start_status_machine``,
    or in a session whose state store is RocksDB.
    """
    kind = log.schema[key].dataType.simpleString()
    rows = log.where(F.col("ts").isNotNull() & F.col("status").isNotNull()).select(
        F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("seq").cast("long").alias("seq"), "status")
    out = rows.withWatermark("ts", late).groupBy("key").transformWithState(
        _StatusMachine(keep_hours * 3_600_000_000), f"key {kind}, seq long, previous string, status string, allowed boolean", "append", "EventTime")
    return out.withColumnRenamed("key", key)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own choice returns afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start_status_machine(log: DataFrame, path: str, checkpoint: str, key: str = "doc_id", keep_hours: int = KEEP_HOURS, late: str = "1 hour") -> StreamingQuery:
    """Append the judged changes to ``path`` for everything that is available, then stop."""
    with rocks_state(log.sparkSession):
        judged = status_machine(log, key, keep_hours, late)
        return judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
