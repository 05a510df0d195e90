"""The quota stream keeps no state and merges the parts of its batches."""

import datetime
from pathlib import Path

from pyspark.sql import functions as F

from studyloom.session import shared_folder
from studyloom.streaming import incremental

START = datetime.datetime(2024, 1, 1)
SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_parts_of_batches_merge_without_state(spark, tmp_path):
    """Four batches share users and hours; a row without a time counts nowhere, those without user or value do."""
    rows = [(i, START + datetime.timedelta(minutes=7 * (i % 50), seconds=i), i % 3 or None, "view", None if i % 11 == 0 else i / 4, "{}") for i in range(200)]
    rows.append((200, None, 1, "view", 1.0, "{}"))
    (tmp_path / "e").mkdir()
    for k in range(4):
        part = tmp_path / f"part{k}"
        spark.createDataFrame(rows[k::4], SHAPE).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(tmp_path / "e" / f"events{k}.parquet")
    folder = Path(shared_folder(spark))
    before = set(folder.glob("stream-*"))
    parts = incremental.run_once(spark, str(tmp_path / "e"), lambda e: e.select("ts", "user_id", "value"), "append", files=1, partial=incremental.quota_parts)
    got = {tuple(r) for r in incremental.merged_quota(parts).collect()}
    want = incremental.sliding_quota(spark.createDataFrame(rows, SHAPE).withColumn("ts", F.col("ts").cast("timestamp")))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
    assert incremental.stream_quota(spark, str(tmp_path / "e")).count() == len(got)
    ran = set(folder.glob("stream-*")) - before
    assert len(ran) == 2 and not any((where / "state" / "state").exists() for where in ran)
