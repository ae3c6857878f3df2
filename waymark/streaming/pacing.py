"""Paced releases as a stream with state and timers of its own.

The session needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pacer(StatefulProcessor):
    """Queues the items of a key and releases each when it has arrived and gap_ms have passed since the key's latest release.

    State: the latest release, and the queue by (arrival, item), which holds what is waiting and, until the watermark has passed
    them, what has just gone. A timer stands where the next release is due, so a key is only woken then. As
    decisions wait for the watermark, the order of arrival within and across batches doesn't matter."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long")
        self.queue = handle.getMapState("queue", "arrival long, item long", "released boolean")

    def _due(self, arrival: int) -> int:
        return max(arrival, self.latest.get()[0] + self.gap) if self.latest.exists() else arrival

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _waiting(self) -> list[tuple]:
        return sorted(k for k, (released,) in ((tuple(k), tuple(v)) for k, v in self.queue.iterator()) if not released)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            at = (row["arrival"], row["item"])
            if row["arrival"] >= now and not self.queue.containsKey(at):  # neither late nor repeated
                self.queue.updateValue(at, (False,))
        waiting = self._waiting()
        if waiting:
            self._wake(max(self._due(waiting[0][0]), now + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, at = self._waiting(), 0
        while at < len(waiting) and (due := self._due(waiting[at][0])) <= now:
            arrival, item = waiting[at]
            self.latest.update((due,))
            self.queue.updateValue((arrival, item), (True,))
            yield Row(host=key[0], item=item, arrival=arrival, released=due)
            at += 1
        gone = [tuple(k) for k, v in self.queue.iterator() if tuple(v)[0] and tuple(k)[0] < now]
        for k in gone:  # a repetition of these would be late
            self.queue.removeKey(k)
        if at < len(waiting):
            self._wake(max(self._due(waiting[at][0]), now + 1))

    def close(self) -> None:
        pass


def releases(items: DataFrame, gap_ms: int, lateness: str = "2 hours") -> DataFrame:
    """(host, item, arrival, released) of a stream (host, item, ts), times in milliseconds: an item goes when it has arrived and gap_ms have
    passed since the latest release of its host; of one time the smaller item goes first.

    Defined results: a release is emitted when the watermark has reached it, so the end of a stream leaves items waiting in the
    state; items behind the watermark are dropped; an item repeated with its time counts once; rows without host, item or
    time are dropped."""
    usable = items.filter("host is not null and item is not null and ts is not null").withWatermark("ts", lateness)
    keyed = usable.select("host", F.col("item").cast("long").alias("item"), "ts", F.unix_millis("ts").alias("arrival"))
    return keyed.groupBy("host").transformWithState(Pacer(gap_ms), "host string, item long, arrival long, released long", "append", "eventTime")
