"""A bounded request queue as keyed state: requests wait across triggers until their batch is full or its oldest has waited long enough.

Each lane is a queue of its own, which one scorer serves. Arrivals beyond its capacity are refused. A batch leaves when it is full, or
``wait_ms`` after its oldest request arrived; a request whose deadline passes before it leaves is refused, by a timer if nothing else
happens. The waiting requests are in the state store, so a restart from the checkpoint goes on with them; its timers count from its first arrival on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FULL, LATE = "queue is full", "queue wait expired"
#: What waits, and what leaves: batch is null for refused requests, waited_ms is the time between arrival and leaving. request_id has the type of the requests'.
WAITING = "request_id {kind}, body string, arrived long"
LEAVING = "lane int, batch long, request_id {kind}, body string, arrived long, waited_ms long, status int, detail string"


def check_options(capacity: int, timeout_ms: float, most: int, wait_ms: float = 0) -> None:
    """Capacities must be positive whole numbers, the timeout a finite number above zero, the batch's wait one from zero on."""
    for name, value in (("capacity", capacity), ("most", most)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive whole number")
    if isinstance(timeout_ms, bool) or not isinstance(timeout_ms, (int, float)) or not 0 < timeout_ms < float("inf"):
        raise ValueError("timeout_ms must be a finite number above zero")
    if isinstance(wait_ms, bool) or not isinstance(wait_ms, (int, float)) or not 0 <= wait_ms < float("inf"):
        raise ValueError("wait_ms must be a finite number from zero on")


@dataclass
class Lane:
    """What waits, in order of arrival: (request_id, body, arrived in ms). Times come from the caller."""

    capacity: int
    most: int
    wait_ms: float
    timeout_ms: float
    waiting: list[tuple] = field(default_factory=list)

    def arrive(self, requests: list[tuple]) -> list[tuple]:
        """Takes what there is room for; returns the rest."""
        room = max(0, self.capacity - len(self.waiting))
        self.waiting += requests[:room]
        return requests[room:]

    def expire(self, now: int) -> list[tuple]:
        """Removes and returns what has waited for too long."""
        late = [r for r in self.waiting if now - r[2] >= self.timeout_ms]
        self.waiting = [r for r in self.waiting if now - r[2] < self.timeout_ms]
        return late

    def leave(self, now: int) -> Iterator[list[tuple]]:
        """Batches that are full, and one that isn't if its oldest has waited long enough."""
        while len(self.waiting) >= self.most or self.waiting and now - self.waiting[0][2] >= self.wait_ms:
            yield self.waiting[: self.most]
            self.waiting = self.waiting[self.most :]

    def wake(self) -> int | None:
        """When something happens next if nothing arrives."""
        if not self.waiting:
            return None
        oldest = min(r[2] for r in self.waiting)
        return int(min(self.waiting[0][2] + self.wait_ms, oldest + self.timeout_ms))


class RequestQueue(StatefulProcessor):
    """One lane's state and timer."""

    def __init__(self, capacity: int, most: int, wait_ms: float, timeout_ms: float, kind: str = "string"):
        self.options, self.kind = (capacity, most, wait_ms, timeout_ms), kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING.format(kind=self.kind))
        self.batches = handle.getValueState("batches", "number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        arrivals = sorted((now if r["arrived"] is None else r["arrived"], r["request_id"], r["body"]) for r in rows)
        yield from self._turn(key, now, [(request_id, body, arrived) for arrived, request_id, body in arrivals])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._turn(key, timerValues.getCurrentProcessingTimeInMs(), [])

    def close(self) -> None:
        pass

    def _turn(self, key, now: int, arrivals: list[tuple]) -> Iterator[Row]:
        lane = Lane(*self.options, [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [])
        number = self.batches.get()[0] if self.batches.exists() else 0

        def rows(requests, batch, status, detail):
            # refused requests need no body
            return [Row(lane=key[0], batch=batch, request_id=i, body=body if status is None else None, arrived=arrived, waited_ms=now - arrived, status=status, detail=detail) for i, body, arrived in requests]

        found = rows(lane.expire(now), None, 503, LATE)
        found += rows(lane.arrive(arrivals), None, 503, FULL)
        # what arrives after its deadline doesn't wait for a timer
        found += rows(lane.expire(now), None, 503, LATE)
        for batch in lane.leave(now):
            number += 1
            found += rows(batch, number, None, None)
        self.batches.update((number,))
        if lane.waiting:
            self.waiting.put(lane.waiting)
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lane.wake() is not None:
            self.handle.registerTimer(max(now + 1, lane.wake()))
        yield from found


def queued(requests: DataFrame, capacity: int = 1024, most: int = 64, wait_ms: float = 0, timeout_ms: float = 30_000, lanes: int = 1) -> DataFrame:
    """LEAVING of a stream of (request_id, body, arrived): batches to score, and refused requests with status and detail.

    ``arrived`` is when a request came in (null: when a trigger first sees it). Requests go to ``lanes`` by a hash of their id; capacity and
    batches are a lane's. The session has to be prepared (prepare_session()).
    """
    check_options(capacity, timeout_ms, most, wait_ms)
    kind = requests.schema["request_id"].dataType.simpleString()
    dealt = requests.select(F.pmod(F.xxhash64("request_id"), F.lit(lanes)).cast("int").alias("lane"), "request_id", "body", F.unix_millis("arrived").alias("arrived"))
    left = dealt.groupBy("lane").transformWithState(RequestQueue(capacity, most, wait_ms, timeout_ms, kind), LEAVING.format(kind=kind), "Append", "ProcessingTime")
    return left.withColumn("arrived", F.timestamp_millis("arrived"))


def prepare_session(spark, drains: bool) -> None:
    """What a session needs before such a stream starts: keyed state of several kinds and timers are RocksDB's; a stream that drains its
    input and stops must not go on for timers alone, which any other stream wakes for without input.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not drains).lower())
