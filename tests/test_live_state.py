"""What a line of a live stream costs: messages to its state, whatever the number of its notes."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Row

from lineweave.streaming import stateful


class Handle:
    """One value and the timers of one line; counts the messages."""

    def __init__(self):
        self.value, self.timers, self.sent = None, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(get=self.read, update=self.write)

    def read(self):
        self.sent += 1
        return self.value

    def write(self, value):
        self.sent += 1
        self.value = value

    def registerTimer(self, at):
        self.sent += 1
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self.sent += 1
        self.timers.remove(at)


def test_one_read_and_one_write_a_batch():
    handle, line = Handle(), stateful._Phrases(2.0, 1000.0)
    line.init(handle)

    def batch(times, now):
        handle.sent = 0
        found = list(line.handleInputRows(("a",), iter([Row(o=float(t), p=60, d=1.0, ms=t * 1000) for t in times]), SimpleNamespace(getCurrentWatermarkInMs=lambda: now * 1000)))
        assert handle.sent <= 4 and len(handle.timers) <= 1
        for at in [t for t in handle.timers if t <= now * 1000]:
            found += list(line.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: now * 1000), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
            handle.timers.remove(at)
        return [tuple(f) for f in found]

    assert batch(range(100), 0) == []  # all but the first wait
    assert handle.timers == {1000}
    assert batch([100, 110], 0) == [] and handle.timers == {1000}  # later notes leave the timer alone
    assert batch([], 105) == [("a", 0, 0.0, 101.0, 101)]
    assert batch([], 200) == [("a", 1, 110.0, 111.0, 1)] and not handle.timers
    assert batch([300], 299) == [] and batch([], 400) == [("a", 2, 300.0, 301.0, 1)]


def test_a_heartbeat_leaves_nothing_behind():
    handle, line = Handle(), stateful._Phrases(2.0, 1000.0)
    line.init(handle)
    assert list(line.handleInputRows((None,), iter([Row(o=None, p=None, d=None, ms=5)]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert handle.value is None and not handle.timers
