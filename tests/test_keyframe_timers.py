"""A job of a keyframe stream has one timer, however many rows wait."""

import pandas as pd

from orbitframe.streaming.keyframes import Keyframes


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None


class Rows(Value):
    def get(self):
        return iter(self.held or [])

    def put(self, x):
        self.held = list(x)

    def appendList(self, x):  # noqa: N802
        self.held = [*(self.held or []), *x]


class Handle:
    def __init__(self):
        self.timers, self.asked = set(), 0

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getListState(self, *_):  # noqa: N802
        return Rows()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)
        self.asked += 1

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_one_timer_a_job():
    k, h = Keyframes(10.0), Handle()
    k.init(h)
    rows = pd.DataFrame({"event_id": range(100), "ts": pd.to_datetime([1000 * (100 - i) for i in range(100)], unit="ms"), "score": [20.0 * (i % 2) for i in range(100)]})
    list(k.handleInputRows((1,), iter([rows[:50], rows[50:]]), None))
    assert h.timers == {1001} and h.asked == 1
    h.timers.clear()
    out = pd.concat(list(k.handleExpiredTimer((1,), Now(50_500), None)))
    assert out["event_id"].tolist() == list(range(99, 49, -1)) and h.timers == {51_001}
    early = rows[:1].assign(event_id=200, ts=pd.to_datetime([50_700], unit="ms"))
    list(k.handleInputRows((1,), iter([early]), None))
    assert h.timers == {50_701}
    h.timers.clear()
    rest = pd.concat(list(k.handleExpiredTimer((1,), Now(10**9), None)))
    assert set(rest["event_id"]) >= set(range(49)) and not h.timers and h.asked == 3
