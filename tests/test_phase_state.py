"""The phase replay reads and writes a session's state once a call, however many events wait."""

from pyspark.sql import Row

from studyloom.streaming.phases import PhaseReplay


class Handle:
    """State of one key in memory; counts accesses."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _called(self, value=None):
        self.calls += 1
        return value

    def getValueState(self, name, schema):  # noqa: N802
        outer, held = self, {}

        class Value:
            def get(self):
                return outer._called(held.get("x"))

            def update(self, x):
                outer._called(held.__setitem__("x", x))

            def clear(self):
                outer._called(held.clear())

        return Value()

    def getMapState(self, name, key, value):  # noqa: N802
        outer, held = self, {}

        class Map:
            def iterator(self):
                return outer._called(iter(list(held.items())))

            def updateValue(self, k, v):  # noqa: N802
                outer._called(held.__setitem__(k, v))

            def removeKey(self, k):  # noqa: N802
                outer._called(held.pop(k))

        return Map()

    def registerTimer(self, at):  # noqa: N802
        self._called(self.timers.add(at))

    def deleteTimer(self, at):  # noqa: N802
        self._called(self.timers.discard(at))

    def listTimers(self):  # noqa: N802
        return self._called(iter(list(self.timers)))


class Times:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def test_accesses_do_not_grow_with_events():
    handle = Handle()
    replay = PhaseReplay("intro", 90 * 86_400_000)
    replay.init(handle)
    rows = [Row(at=1_000_000 * i, event_id=i, wanted="exam" if i % 2 else "history") for i in range(1, 1001)]
    (first,) = replay.handleInputRows((1,), iter(rows[::-1] + rows[:3]), Times(0))
    assert first == Row(user_id=1, phase="history", refused=1, late=0, waiting=1000)
    (half,) = replay.handleExpiredTimer((1,), Times(500_500), None)
    assert (half.phase, half.refused, half.waiting) == ("history", 1, 500) and handle.timers == {501_001}
    (last,) = replay.handleExpiredTimer((1,), Times(1_000_000), None)
    assert (last.phase, last.refused, last.waiting) == ("history", 1, 0) and len(handle.timers) == 1
    assert handle.calls < 20
    (gone,) = replay.handleExpiredTimer((1,), Times(1_000_000 + 90 * 86_400_000), None)
    assert gone.phase == "history" and not handle.timers
    (new,) = replay.handleInputRows((1,), iter([Row(at=8_000_000_000_000, event_id=2000, wanted="history")]), Times(7_800_000_000))
    assert (new.phase, new.refused, new.late) == ("history", 0, 0)
