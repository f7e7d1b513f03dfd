"""The request queue: rules by a clock of the test's own, then as a stream that is stopped and goes on."""

import json
import os
import time
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbitra.streaming import queue, serve


class Kept:
    """A list or value state in memory."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def put(self, value):
        self.held = list(value)

    update = put

    def clear(self):
        self.held = None


class Engine:
    """What Spark does for one key: keeps states, calls the processor for arrivals and for timers that are due."""

    def __init__(self, **options):
        self.states, self.timers, self.now = {}, set(), 0
        self.processor = queue.RequestQueue(**options)
        self.start()

    def start(self):
        """Also a restart: the processor is new, states and timers are as they were."""
        options = self.processor.options
        self.processor = queue.RequestQueue(*options)
        state = lambda name, _: self.states.setdefault(name, Kept())
        self.processor.init(SimpleNamespace(getListState=state, getValueState=state, listTimers=lambda: iter(sorted(self.timers)), deleteTimer=self.timers.discard, registerTimer=self.timers.add))

    def trigger(self, now, requests=()):
        self.now, out = now, []
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        if requests:
            out += self.processor.handleInputRows((0,), iter([{"request_id": i, "body": f"b{i}", "arrived": at} for i, at in requests]), clock)
        for due in sorted(t for t in self.timers if t <= now):
            if due in self.timers:
                self.timers.discard(due)
                out += self.processor.handleExpiredTimer((0,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: due))  # noqa: B023
        return out


def test_batches_leave_full_or_after_the_oldest_has_waited():
    engine = Engine(capacity=10, most=3, wait_ms=100, timeout_ms=10_000)
    assert engine.trigger(1000, [("a", 1000), ("b", 1000)]) == [] and engine.timers == {1100}
    got = engine.trigger(1050, [("c", 1050), ("d", 1050)])
    assert [(r.request_id, r.batch, r.waited_ms) for r in got] == [("a", 1, 50), ("b", 1, 50), ("c", 1, 0)] and engine.timers == {1150}
    assert engine.trigger(1149) == []
    assert [(r.request_id, r.batch) for r in engine.trigger(1150)] == [("d", 2)] and not engine.timers
    assert engine.trigger(5000) == []


def test_deadlines_fire_by_timer_and_capacity_holds_across_triggers():
    engine = Engine(capacity=3, most=10, wait_ms=5000, timeout_ms=200)
    assert engine.trigger(0, [("a", 0), ("b", 0)]) == []
    assert [(r.request_id, r.status, r.detail, r.body) for r in engine.trigger(100, [("c", 90), ("d", 95)])] == [("d", 503, queue.FULL, None)]
    engine.start()
    assert [(r.request_id, r.status, r.detail) for r in engine.trigger(200)] == [("a", 503, queue.LATE), ("b", 503, queue.LATE)]
    # there is room again; what comes too late is refused at once
    assert [(r.request_id, r.detail) for r in engine.trigger(210, [("e", 5), ("f", 205)])] == [("e", queue.LATE)]
    assert engine.timers == {290}
    assert [r.request_id for r in engine.trigger(290)] == ["c"] and [r.request_id for r in engine.trigger(1000)] == ["f"]


@given(st.lists(st.tuples(st.integers(0, 120), st.integers(0, 6), st.booleans()), max_size=25), st.integers(1, 8), st.integers(1, 4), st.sampled_from([0, 30, 90]), st.sampled_from([50, 1000]))
@settings(max_examples=150, deadline=None)
def test_every_request_leaves_once_and_by_the_rules(steps, capacity, most, wait_ms, timeout_ms):
    engine = Engine(capacity=capacity, most=most, wait_ms=wait_ms, timeout_ms=timeout_ms)
    arrived, left, now, number = {}, [], 0, 0
    for pause, count, again in [*steps, (5000, 0, False)]:
        # the engine wakes for timers in between
        for due in sorted(t for t in engine.timers if t < now + pause):
            left += [(r, due) for r in engine.trigger(due)]
        now += pause
        new = [(f"{number + k:04d}", now) for k in range(count)]
        number += count
        arrived |= dict(new)
        if again:
            engine.start()
        left += [(r, now) for r in engine.trigger(now, new)]
    assert sorted(r.request_id for r, _ in left) == sorted(arrived)
    batches = {}
    for r, at in left:
        assert r.waited_ms == at - arrived[r.request_id]
        if r.status is None:
            assert r.waited_ms < timeout_ms
            batches.setdefault(r.batch, []).append((r, at))
        else:
            assert r.detail == queue.FULL or r.waited_ms >= timeout_ms
    assert sorted(batches) == list(range(1, len(batches) + 1))
    for own in batches.values():
        assert len({at for _, at in own}) == 1 and len(own) <= most and (len(own) == most or own[0][0].waited_ms >= wait_ms)
    served = [r.request_id for b in sorted(batches) for r, _ in batches[b]]
    assert served == sorted(served)


def test_options_are_checked():
    for bad in ({"capacity": 0}, {"most": True}, {"timeout_ms": float("nan")}, {"wait_ms": -1}, {"wait_ms": float("inf")}):
        with pytest.raises(ValueError):
            queue.check_options(**({"capacity": 1, "timeout_ms": 1, "most": 1, "wait_ms": 0} | bad))


BODY = '{"state": "x", "questions": {"q": {"type": "noul", "instructions": "?"}}}'


def test_a_restart_goes_on_with_what_waits(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def put(name, ids):
        (tmp_path / name).write_text("".join(json.dumps({"request_id": i, "body": BODY}) + "\n" for i in ids))
        os.rename(tmp_path / name, source / name)

    def run(trigger, **options):
        stream = spark.readStream.schema("request_id string, body string").json(str(source)).withColumn("arrived", F.current_timestamp())
        return serve.serve(stream, lambda frame, _: got.extend(frame.collect()), state, trigger=trigger, most=3, **options)

    got = []
    put("a.json", ["a1", "a2", "a3", "a4"])
    # one batch is full; a4 waits for company in the state store
    run({"availableNow": True}, wait_ms=60_000, timeout_ms=600_000).awaitTermination()
    assert sorted(r.request_id for r in got) == ["a1", "a2", "a3"]
    put("b.json", ["b1", "b2", "b3"])
    run({"availableNow": True}, wait_ms=60_000, timeout_ms=600_000).awaitTermination()
    assert sorted(r.request_id for r in got) == ["a1", "a2", "a3", "a4", "b1", "b2"] and {r.status for r in got} == {200}
    # b3 is late when c1 wakes the stream; then nothing else arrives, and c1's deadline fires by its timer
    put("c.json", ["c1"])
    query = run({"processingTime": "200 milliseconds"}, wait_ms=60_000, timeout_ms=2_000)
    end = time.time() + 60
    while len(got) < 8 and time.time() < end and query.exception() is None:
        time.sleep(0.2)
    query.stop()
    assert [(r.request_id, r.status, r.detail) for r in got[6:]] == [("b3", 503, queue.LATE), ("c1", 503, queue.LATE)]
