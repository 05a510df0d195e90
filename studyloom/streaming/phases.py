"""The replay of a session's phases as its events come in, in any order.

Events wait in state until the watermark has passed them and are then applied in order of (ts, event_id), so that events that
overtake each other within the delay change nothing. What a session has reached is reported after every batch: what is
settled, and the waiting events on top of it in the order known so far.

Defined results: an event whose id waits already is the same event and counts once; one that comes when the watermark has passed
its time is late: it changes no phase (Spark drops it before it gets here, or it is counted in ``late``); moves that aren't allowed
are counted in ``refused``; a session without events for ``idle`` beyond the watermark is settled and its state is let go, so that a
later event begins a new session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import SQL as _FOLDS
from ..operators.folds import TRANSITIONS, wanted_phase
from .incremental import run_once

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PhaseReplay(StatefulProcessor):
    """Settled phase and waiting events of one session, in one state value: each call reads and writes it once, however many
    events wait, as every access is a round trip between the worker and the JVM."""

    def __init__(self, start: str, idle_ms: int) -> None:
        self.start, self.idle_ms = start, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "phase string, refused long, late long, until long, last long, timer long, at array<long>, event_id array<long>, wanted array<string>")

    def _now(self) -> tuple[list, dict]:
        """What is settled, and the waiting events by (at, event_id)."""
        got = self.session.get()
        if got is None:
            return [self.start, 0, 0, -(1 << 62), -(1 << 62), None], {}
        at, event_id, wanted = got[6:]
        return list(got[:6]), dict(zip(zip(at, event_id, strict=True), wanted, strict=True))

    @staticmethod
    def _apply(phase: str, refused: int, wanted: str) -> tuple[str, int]:
        return (wanted, refused) if wanted in TRANSITIONS[phase] else (phase, refused + 1)

    def _settle(self, now: list, waiting: dict, watermark_ms: int) -> list:
        """Apply what the watermark has passed; what still waits is returned."""
        rest = []
        for (at, event_id), wanted in sorted(waiting.items()):
            if at // 1000 <= watermark_ms:
                now[0], now[1] = self._apply(now[0], now[1], wanted)
            else:
                rest.append((at, event_id, wanted))
        now[3] = max(now[3], watermark_ms)
        timer = rest[0][0] // 1000 + 1 if rest else now[4] + self.idle_ms
        if timer != now[5]:
            if now[5] is not None:
                self.handle.deleteTimer(now[5])
            self.handle.registerTimer(timer)
            now[5] = timer
        self.session.update((*now, *([r[k] for r in rest] for k in range(3))))
        return rest

    def _report(self, key: tuple, now: list, rest: list) -> Row:
        phase, refused = now[0], now[1]
        for _, _, wanted in rest:
            phase, refused = self._apply(phase, refused, wanted)
        return Row(user_id=key[0], phase=phase, refused=refused, late=now[2], waiting=len(rest))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        (now, waiting), watermark = self._now(), timerValues.getCurrentWatermarkInMs()
        for at, event_id, wanted in ((r.at, r.event_id, r.wanted) for r in rows):
            if at // 1000 <= now[3]:
                now[2] += 1
            else:
                waiting[at, event_id] = wanted
                now[4] = max(now[4], at // 1000)
        yield self._report(key, now, self._settle(now, waiting, watermark))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        (now, waiting), watermark = self._now(), timerValues.getCurrentWatermarkInMs()
        rest = self._settle(now, waiting, watermark)
        yield self._report(key, now, rest)
        if not rest and watermark >= now[4] + self.idle_ms:
            self.session.clear()
            self.handle.deleteTimer(now[5])

    def close(self) -> None:
        pass


def phase_replay(events: DataFrame, late: str = "1 day", idle_days: int = 90, start: str = "intro") -> DataFrame:
    """(user_id, phase, refused, late, waiting) of each session with news, from a stream (user_id, ts, event_id, event_type).

    The session must use the RocksDB state store."""
    e = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", wanted_phase(F.col("event_type")).alias("wanted"))
    schema = "user_id long, phase string, refused long, late long, waiting long"
    return e.groupBy("user_id").transformWithState(PhaseReplay(start, idle_days * 86_400_000), schema, "Update", "EventTime")


def replayed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """``phase_replay`` over a folder of events to its end; the last report of each session."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return run_once(spark, sf_dir, phase_replay, "update", ["user_id"], **options)
    finally:
        spark.conf.set(name, before)


def stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir).select("user_id", "phase", F.col("refused").cast("int").alias("refused"))


QUERIES = {"stream_phases": stream_phases}
SQL = {"stream_phases": _FOLDS["phases"]}
