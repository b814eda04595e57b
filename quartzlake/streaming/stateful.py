"""Streams with a small typed state for each key: alerts, states of stocks, expiries. State that is not needed goes.

The state of a key whose time to live has passed since its last change is dropped by the state store, so keys that fall
silent cost nothing in the end; an expiry drops its state when its timer fires. Both need the RocksDB state store, which
`stored_in_rocksdb` sets for a session. With a time to live a query goes on planning batches, so it is stopped from outside.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sources of a scan in their order; without the first, a stock has failed.
WAVES = ("price", "kap", "news", "actions", "restrictions")
ALERT = "source_id long, alert_at timestamp, event_id long"
STEP = "stock_id long, state string, missing string"
EXPIRED = "seq long, expired_at timestamp"


def stored_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Alerts(StatefulProcessor):
    """The errors in a row of a source, as of its last event."""

    def __init__(self, limit: int, live_ms: int | None):
        self.limit, self.live_ms = limit, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n int", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.streak.get()[0] if self.streak.exists() else 0
        for ts, event_id, ok in sorted((r.ts, r.event_id, r.ok) for r in rows):
            n = 0 if ok else n + 1
            if n == self.limit:
                yield Row(source_id=key[0], alert_at=ts, event_id=event_id)
        self.streak.update((n,))

    def close(self) -> None:
        pass


class StockStates(StatefulProcessor):
    """What each source of a stock has said last."""

    def __init__(self, live_ms: int | None):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "source string", "ok boolean", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.seen.updateValue((r.source,), (r.ok,))
        seen = {source[0]: ok[0] for source, ok in self.seen.iterator()}
        bad = [s for s in WAVES if seen.get(s) is False]
        name = "WAITING" if set(seen) < set(WAVES) else "FAILED" if WAVES[0] in bad else "PARTIAL_DATA" if bad else "READY"
        yield Row(stock_id=key[0], state=name, missing=",".join(bad))

    def close(self) -> None:
        pass


class Expiries(StatefulProcessor):
    """The latest known end of a restriction, and a timer at it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ends = handle, handle.getValueState("ends", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = [r.ends_at for r in rows if r.ends_at is not None]
        if self.ends.exists():
            known.append(self.ends.get()[0])
        if known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.ends.update((max(known),))
            self.handle.registerTimer(max(_millis(max(known)), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = self.ends.get()[0]
        self.ends.clear()
        yield Row(seq=key[0], expired_at=at)

    def close(self) -> None:
        pass


def _millis(at: dt.datetime) -> int:
    return int(at.timestamp() * 1000)


def alerts(stream: DataFrame, limit: int = 3, live_ms: int | None = None) -> DataFrame:
    """source_id, alert_at, event_id when a source's errors in a row reach the limit; once for each row of errors.

    The events of a source in one batch are put in order in its task: the stream's rate option bounds them. A source that is silent for
    live_ms starts anew."""
    stored_in_rocksdb(stream.sparkSession)
    return stream.groupBy("source_id").transformWithState(Alerts(limit, live_ms), ALERT, "Append", "ProcessingTime" if live_ms else "None")


def stock_states(stream: DataFrame, live_ms: int | None = None) -> DataFrame:
    """stock_id, state, missing after each batch of source outcomes (stock_id, source, ok): WAITING until all sources have
    reported, then READY, PARTIAL_DATA, or FAILED without a price. A report older than live_ms counts no more."""
    stored_in_rocksdb(stream.sparkSession)
    return stream.groupBy("stock_id").transformWithState(StockStates(live_ms), STEP, "Update", "ProcessingTime" if live_ms else "None")


def expiries(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """seq, expired_at for restrictions (seq, ts, ends_at): each once, when the stream's clock passes its end; an open end never."""
    stored_in_rocksdb(stream.sparkSession)
    return stream.withWatermark("ts", delay).groupBy("seq").transformWithState(Expiries(), EXPIRED, "Append", "EventTime")
