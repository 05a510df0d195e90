"""The phase replay of a stream against the batch replay, in shuffled arrival."""

import datetime
import random

import pytest

from studyloom.operators.folds import TRANSITIONS, replay_phases, wanted_phase
from studyloom.streaming import phases

KINDS = ["view", "click", "purchase", "signup", "error", "other"]
START = datetime.datetime(2024, 1, 1)


def events(seed, users=6, n=240):
    rng = random.Random(seed)
    return [(i, START + datetime.timedelta(hours=i, minutes=rng.randrange(50)), rng.randrange(users), rng.choice(KINDS)) for i in range(n)]


def write(spark, folder, batches):
    """One file a batch, older ones first."""
    from pyspark.sql import functions as F

    folder.mkdir()
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
        part = folder / f"part{k}"
        frame.withColumns({"value": F.lit(1.0), "props": F.lit("{}")}).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(folder / f"events{k:03}.parquet")


def plain(rows):
    """(phase, refused) of each user after its distinct events in order."""
    names = dict(zip(KINDS, ["exam", "tests", "diagnosis", "treatment", "scoring", "history"], strict=True))
    out = {}
    for _, _, user, kind in sorted(set(rows), key=lambda r: (r[1], r[0])):
        phase, refused = out.get(user, ("intro", 0))
        out[user] = (names[kind], refused) if names[kind] in TRANSITIONS[phase] else (phase, refused + 1)
    return out


def result(spark, folder, **options):
    return {r.user_id: (r.phase, r.refused) for r in phases.replayed(spark, str(folder), **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_changes_nothing(spark, tmp_path, seed):
    """Events that overtake each other by less than the delay, and some that come twice."""
    rows = events(seed)
    rng = random.Random(seed)
    arrival = sorted(rows + rng.sample(rows, 30), key=lambda r: r[0] + rng.uniform(0, 16))
    write(spark, tmp_path / "e", [arrival[i : i + 45] for i in range(0, len(arrival), 45)])
    got = result(spark, tmp_path / "e", files=1)
    assert got == plain(rows)
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert got == {r.user_id: (r.phase, r.refused) for r in replay_phases(batch.withColumn("w", wanted_phase(batch["event_type"])), ["user_id"], ["ts", "event_id"], "w").collect()}


def test_late_events_change_no_phase(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(hours=12 * i), 1, "other" if i % 2 else "view") for i in range(20)]
    late = [(100, START + datetime.timedelta(minutes=5), 1, "click")]
    write(spark, tmp_path / "e", [rows[:10], rows[10:15], late, rows[15:]])
    assert result(spark, tmp_path / "e", files=1) == plain(rows)


def test_an_idle_session_begins_anew(spark, tmp_path):
    day = lambda d: START + datetime.timedelta(days=d)
    first = [(1, day(0), 1, "other"), (2, day(1), 1, "view")]
    other = [(3, day(200), 2, "other")]
    again = [(4, day(202), 1, "click"), (5, day(203), 1, "other")]
    write(spark, tmp_path / "e", [first, other, [(6, day(201), 2, "view")], again])
    assert result(spark, tmp_path / "e", files=1) == {1: ("history", 1), 2: ("exam", 0)}
