"""Limiters and bounded deduplication as keyed stream state (transformWithState).

T15 and T23 judge calls in the order of their time, as their batch forms do: a call waits in its key's state until the watermark
has passed it, a timer wakes the key, and calls up to the watermark are then judged in order of time and id. So micro-batches
give the rows of the batch form, whatever order calls come in within the delay. A call behind the watermark is late: it is
dropped by Spark before it gets here and has no row. A second timer clears a key's state when nothing of it can count any more.

T8's second form keeps the ids of a key in order of arrival, ``most`` at most: an id that comes again while it is held is a repeat; one
that was evicted counts as new. Calls of a null key share one state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from scholia_spark.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs; ships this package to the workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _InOrder(StatefulProcessor):
    """Calls (call_id, t in seconds, at as a timestamp) in order of time; ``judge`` decides with the key's numbers."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, call_id long")
        self.numbers = handle.getListState("numbers", "x double")

    def judge(self, numbers: list[float], t: float) -> tuple[list[float], bool]:
        raise NotImplementedError

    def until(self, numbers: list[float]) -> float:
        """When the numbers stop to count."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [Row(t=r.t, call_id=r.call_id) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r.t for r in new))
        return iter([])

    def _wake(self, t: float) -> None:
        self.handle.registerTimer(int(-(-t * 1000 // 1)))  # the first whole millisecond at or behind t

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        held = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        numbers = [r[0] for r in self.numbers.get()] if self.numbers.exists() else []
        due, later = [c for c in held if c[0] <= mark], [c for c in held if c[0] > mark]
        out = []
        for t, call in due:
            numbers, allowed = self.judge(numbers, t)
            out.append(Row(key=key[0], call_id=call, allowed=allowed))
        if later:
            self.waiting.put([Row(t=t, call_id=c) for t, c in later])
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if numbers and (later or self.until(numbers) > mark):
            self.numbers.put([Row(x=x) for x in numbers])
            if not later:
                self._wake(self.until(numbers))
        else:
            self.numbers.clear()
        return iter(out)

    def close(self) -> None:
        pass


class SlidingLimit(_InOrder):
    """Fewer than ``limit`` calls passed in the last ``seconds``; the state is the times of those, ``limit`` at most."""

    def __init__(self, limit: int, seconds: float):
        super().__init__(seconds)
        self.limit = limit

    def judge(self, numbers, t):
        numbers = [x for x in numbers if t - x < self.seconds]
        return (numbers + [t], True) if len(numbers) < self.limit else (numbers, False)

    def until(self, numbers):
        return numbers[-1] + self.seconds


class FixedLimit(_InOrder):
    """Windows begin at a key's first call; the state is the window's end and its calls so far."""

    def __init__(self, limit: int, seconds: float):
        super().__init__(seconds)
        self.limit = limit

    def judge(self, numbers, t):
        reset, n = numbers if numbers and t < numbers[0] else (t + self.seconds, 0.0)
        return [reset, n + 1], n + 1 <= self.limit

    def until(self, numbers):
        return numbers[0]


def limited(calls: DataFrame, limiter: _InOrder, delay: str = "1 minute") -> DataFrame:
    """key, call_id, allowed of a stream of calls (key, call_id, t in seconds since 1970); ``limiter``: SlidingLimit or FixedLimit."""
    use_state(calls.sparkSession)
    timed = calls.select("key", "call_id", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at")).withWatermark("at", delay)
    return timed.groupBy("key").transformWithState(limiter, "key long, call_id long, allowed boolean", "Append", "EventTime")


class BoundedSeen(StatefulProcessor):
    """Ids held in order of arrival; beyond ``most`` the oldest goes. A repeat doesn't move an id."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.places = handle.getMapState("places", "id string", "place long")
        self.order = handle.getMapState("order", "place long", "id string")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, next_ = self.ends.get() if self.ends.exists() else (0, 0)
        out = []
        for r in sorted(rows, key=lambda r: r.arrival):
            if not self.places.containsKey((r.id,)):
                self.places.updateValue((r.id,), (next_,))
                self.order.updateValue((next_,), (r.id,))
                next_ += 1
                if next_ - first > self.most:
                    self.places.removeKey((self.order.getValue((first,))[0],))
                    self.order.removeKey((first,))
                    first += 1
                out.append(Row(key=key[0], id=r.id, arrival=r.arrival))
        self.ends.update((first, next_))
        return iter(out)

    def close(self) -> None:
        pass


def first_deliveries(signals: DataFrame, most: int = 100_000) -> DataFrame:
    """T8, evicting form: of a stream of signals (key, id, arrival) those whose id is not among the last ``most`` new ids of its key.

    ``deduplicated`` is the form by watermark: it forgets by time and not by number, so both differ after an eviction.
    """
    use_state(signals.sparkSession)
    rows = signals.where("id IS NOT NULL").select("key", F.col("id").cast("string").alias("id"), "arrival")
    return rows.groupBy("key").transformWithState(BoundedSeen(most), "key long, id string, arrival long", "Append", "None")
