"""Incremental versions of the stateful computations, on Structured Streaming.

Each takes a streaming (or batch) DataFrame of events and returns a DataFrame, so the caller chooses source,
sink and trigger. ``run_once`` drives one over a folder of Parquet files to its end (availableNow).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """The events table as a stream of ``files`` files a batch, with an event time that watermarks accept."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and minutes of each day and kind."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("minutes"))
    return g.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", F.round("minutes", 2).alias("minutes"))


def sliding_quota(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and cost of each user in hours that start every 5 minutes."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "60 minutes", "5 minutes"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_seconds("window.start").alias("start"), "user_id", "n", F.round("total", 4).alias("total"))


#: Seconds of a quota's windows and from one's start to the next's, and partial rows that one task merges.
HOUR, SLIDE, MERGED = 3600, 300, 500_000


def quota_parts(events: DataFrame) -> DataFrame:
    """(start, user_id, n, total): requests and cost of each user in the 5 minutes from ``start``, of which every hour consists."""
    start = F.floor(F.unix_seconds("ts") / SLIDE) * SLIDE
    return events.where("ts is not null").groupBy(start.cast("long").alias("start"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def merged_quota(parts: DataFrame) -> DataFrame:
    """``sliding_quota`` from its parts, of which a user may have several with one start. Parts are dealt out by user before they
    are spread over the hours that hold them, so an event is shuffled once, not once for each hour."""
    spark = parts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // MERGED))
    hours = F.sequence(F.col("start") - (HOUR - SLIDE), F.col("start"), F.lit(SLIDE))
    each = parts.repartition(tasks, "user_id").select(F.explode(hours).alias("start"), "user_id", "n", "total")
    g = each.groupBy("start", "user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return g.select("start", "user_id", "n", F.round("total", 4).alias("total"))


def session_groups(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user by gaps."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


def once_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; in a batch one of each key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def next_review(state: tuple[int, float, int], quality: int) -> tuple[int, float, int]:
    """The spaced-repetition step on (interval, ease, repetitions)."""
    interval, ease, reps = state
    eased = max(1.3, ease + (0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02)))
    if quality < 3:
        return 1, eased, 0
    return (1 if reps == 0 else 6 if reps == 1 else int(interval * ease + 0.5)), eased, reps + 1


def review_states(events: DataFrame) -> DataFrame:
    """Each user's review state after every batch of events (update mode); events of a batch go in order of time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(key: Any, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now = state.get if state.exists else (0, 2.5, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for quality in rows["quality"]:
            now = next_review(now, int(quality))
        state.update(now)
        yield pd.DataFrame({"user_id": [key[0]], "interval": [now[0]], "ease": [now[1]], "reps": [now[2]]})

    k = F.get_json_object("props", "$.k").cast("double")
    quality = F.when(k >= 90, 5).when(k >= 75, 4).when(k >= 60, 3).when(k >= 40, 2).when(k >= 20, 1).otherwise(0)
    e = events.select("user_id", "ts", "event_id", quality.alias("quality"))
    return e.groupBy("user_id").applyInPandasWithState(advance, "user_id long, interval long, ease double, reps long", "interval long, ease double, reps long", "update", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], mode: str = "complete", keys: list[str] | None = None, files: int = 1000, partial: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The result of a transformation after the whole stream, as a Parquet table in the shared folder.
    With ``partial`` each batch is written as that aggregates it, so that the stream needs no state and the caller merges the parts.

    Each micro-batch overwrites a folder of its own, so one that is run again leaves no second copy. Of a complete
    result the last batch counts, of appended rows all, of updated ones the last of each of ``keys``."""
    where = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    result = transform(event_stream(spark, sf_dir, files))
    kept = partial or (lambda batch: batch)

    def save(batch: DataFrame, number: int) -> None:
        kept(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/n={number}")

    columns = kept(spark.createDataFrame([], result.schema)).schema
    shape = T.StructType([*columns.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], shape).write.parquet(f"{where}/out/n=-1")  # no events, no rows
    sink = result.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{where}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(shape).parquet(f"{where}/out/*")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    elif mode == "update":
        last = out.groupBy(*keys).agg(F.max("batch").alias("batch"))
        out = out.join(last, [*keys, "batch"])
    return out.select(*columns.names)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(spark, sf_dir, tumbling_counts)


def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = run_once(spark, sf_dir, lambda e: e.select("ts", "user_id", "value"), "append", partial=quota_parts)
    return merged_quota(parts)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(spark, sf_dir, session_groups)


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = run_once(spark, sf_dir, lambda e: once_each(e.withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"], "40 days").select("user_id", "day"), "append")
    return seen.groupBy("user_id").agg(F.count("*").alias("days"))


def stream_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(spark, sf_dir, review_states, "update", ["user_id"]).select("user_id", "interval", F.round("ease", 6).alias("ease"), "reps")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_quota, stream_sessions, stream_once, stream_reviews)}
SQL = {
    "stream_tumbling": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS minutes FROM events GROUP BY ALL",
    "stream_quota": """SELECT CAST(s AS BIGINT) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT user_id, value, unnest(generate_series(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - 3300, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300, 300)) AS s FROM events) GROUP BY ALL""",
    "stream_sessions": """SELECT user_id, min(us) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (
      SELECT user_id, event_id, epoch_us(ts) AS us, CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 7200000000, true) AS BIGINT) AS new FROM events)) GROUP BY user_id, session""",
    "stream_once": "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id",
}
