"""A sliding rate limit as state: each event judged by how many of its key's events lie in the window that ends with it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_SECOND = "_second"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class SlidingLimit(StatefulProcessor):
    """Holds back a key's events until the watermark passes them, then judges them second by second.

    State of a key: the events that wait, and counts of the seconds of its last window (so at most one entry a second). A timer
    wakes at the earliest event that waits; one at the window's end clears what is left of a key that fell silent.
    """

    def __init__(self, seconds: int, limit: int, waiting: StructType) -> None:
        self.seconds, self.limit, self.schema = seconds, limit, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.counts = handle.getMapState("counts", "second bigint", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        rows = [tuple(r) for r in rows]
        self.waiting.appendList(rows)
        self._wake_at(min(r[-1] for r in rows) * 1000)
        return iter(())

    def _wake_at(self, moment: int, over: int | None = None) -> None:
        """One timer at the earliest moment asked for; the one that is just `over` doesn't count."""
        held = [t for t in self.handle.listTimers() if t != over]
        if not any(t <= moment for t in held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(moment)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = [r for r in waiting if r[-1] <= passed], [r for r in waiting if r[-1] > passed]
        counts = {k[0]: v[0] for k, v in self.counts.iterator()} if self.counts.exists() else {}
        fresh = Counter(r[-1] for r in due)
        for second, n in fresh.items():
            counts[second] = counts.get(second, 0) + n
        judged, ordered, left, within = {}, sorted(counts), 0, 0
        for second in ordered:  # the window slides, so each second enters and leaves it once
            within += counts[second]
            while ordered[left] <= second - self.seconds:
                within -= counts[ordered[left]]
                left += 1
            if second in fresh:
                judged[second] = within
        kept = {s: n for s, n in counts.items() if s > passed - self.seconds}
        self.counts.clear()
        for second, n in kept.items():
            self.counts.updateValue((second,), (n,))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if later or kept:
            self._wake_at(min([r[-1] for r in later] + [max(kept) + self.seconds for _ in kept][:1]) * 1000, expiredTimerInfo.getExpiryTimeInMs())
        told = Row(*self.schema.names[:-1], "in_window", "allowed")
        for r in due:
            yield told(*r[:-1], judged[r[-1]], judged[r[-1]] <= self.limit)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with lists, maps and timers needs the RocksDB store; the session's own choice is put back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int, delay: str = "1 hour") -> DataFrame:
    """A stream's events with in_window and allowed, given out as the watermark passes them; later ones are dropped.

    The same rule as `freshness.within_window` for tables. Rows without a moment are dropped. Start the query under `keyed_state`.
    """
    timed = events.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn(_SECOND, F.unix_timestamp(ts))
    output = StructType([*events.schema.fields, StructField("in_window", LongType()), StructField("allowed", BooleanType())])
    return timed.groupBy(key).transformWithState(SlidingLimit(seconds, limit, timed.schema), output, "append", "eventTime")

