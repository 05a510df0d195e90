"""Order and time: as-of and range joins, ranges from starts, overlaps, neighbours, carried headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before it, by key (null if none).

    Both sides go through one window per key, so nothing is joined; ties on the right: the larger value."""
    a = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), value)
    w = Window.partitionBy(*by).orderBy("__t", "__side", value).rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return merged.where("__side = 1").drop("__t", "__side")


@query("""
SELECT p.event_id, p.user_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest signup at or before it."""
    e = scan(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", "ts", "signup_id").select("event_id", "user_id", "signup_id")


@query("""
SELECT o_custkey, o_orderkey, o_orderdate AS from_ts, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '2002-01-01') AS to_ts FROM orders""")
def next_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each start's range up to the next start, the last one up to a given end."""
    o = scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    end = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("from_ts"), F.coalesce(end, F.lit("2002-01-01").cast("timestamp_ntz")).alias("to_ts"))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points within [low, high), by buckets of ``width``: a range is copied to the buckets it covers, so the
    join is an equality and Spark may split a skewed bucket."""
    spread = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(spread, "__b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


@query("""
WITH r AS (SELECT event_id AS range_id, epoch_us(ts) AS lo, epoch_us(ts) + 1800000000 AS hi FROM events WHERE event_type = 'error')
SELECT range_id, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN r ON epoch_us(ts) >= lo AND epoch_us(ts) < hi GROUP BY range_id""")
def range_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the half hour from each error of some users."""
    e = scan(spark, sf_dir, "events", "event_id", "user_id", "ts", "value", "event_type").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    r = e.where("event_type = 'error'").select(F.col("event_id").alias("range_id"), F.col("us").alias("lo"), (F.col("us") + 1_800_000_000).alias("hi"))
    return range_join(e.select("us", "value"), r, "us", "lo", "hi", 1_800_000_000).groupBy("range_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE lo < prev_hi) AS overlaps, CAST(max(lo - prev_hi) AS BIGINT) AS widest_gap FROM (
  SELECT user_id, epoch_us(ts) AS lo, lag(epoch_us(ts) + 3600000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_hi FROM events) GROUP BY user_id""")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that start before the one before them ends."""
    e = scan(spark, sf_dir, "events", "user_id", "event_id", "ts").withColumn("lo", F.unix_micros(F.col("ts").cast("timestamp")))
    x = e.withColumn("prev_hi", F.lag(F.col("lo") + 3_600_000_000).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("lo") < F.col("prev_hi")).alias("overlaps"), F.max(F.col("lo") - F.col("prev_hi")).alias("widest_gap"))


@query("""
SELECT p_partkey, p_brand, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS neighbours FROM (
  SELECT a.p_partkey, a.p_brand, b.p_partkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) b ON a.p_brand = b.p_brand AND a.r <> b.r AND abs(a.r - b.r) <= 4) GROUP BY ALL""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four neighbours before and after each node in its chapter."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    both = F.concat(F.collect_list("p_partkey").over(w.rowsBetween(-4, -1)), F.collect_list("p_partkey").over(w.rowsBetween(1, 4)))
    return scan(spark, sf_dir, "part", "p_partkey", "p_brand").select("p_partkey", "p_brand", F.array_join(F.transform(both, lambda k: k.cast("string")), ",").alias("neighbours"))


def catalog_units(toc: DataFrame, total_pages: int, by: list[str]) -> DataFrame:
    """Page ranges of headings (pos, level, title, page): of each page the deepest heading, the last one at ties;
    a range ends before the next heading's page; headings that point back before the first content page go."""
    w = Window.partitionBy(*by)
    first = toc.withColumn("__first", F.first("page").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    deepest = first.where("page >= __first").withColumn("__r", F.row_number().over(Window.partitionBy(*by, "page").orderBy(F.desc("level"), F.desc("pos")))).where("__r = 1")
    following = F.lead("page", 1, total_pages + 1).over(w.orderBy("page"))
    return deepest.withColumn("page_end", F.greatest(F.col("page"), following - 1)).drop("__first", "__r").withColumnRenamed("page", "page_start")


def carry_headings(rows: DataFrame, by: list[str], order: str, level: str, title: str, depth: int = 3) -> DataFrame:
    """Rows with the titles of the headings above them (h1 .. h<depth>); a heading closes the deeper ones."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k in range(1, depth + 1):
        value = F.when(F.col(level) == k, F.struct(F.col(title).alias("t"))).when(F.col(level) < k, F.struct(F.lit(None).cast("string").alias("t")))
        out = out.withColumn(f"h{k}", F.last(value, ignorenulls=True).over(w)["t"])
    return out


@query("""
WITH x AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)
SELECT conv_id, turn, role, (SELECT max(turn) FROM x u WHERE u.conv_id = x.conv_id AND u.turn <= x.turn AND u.level = 1) AS system_turn,
  (SELECT max(turn) FROM x u WHERE u.conv_id = x.conv_id AND u.turn <= x.turn AND u.level = 2) AS user_turn FROM x""")
def carried_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the latest system and user turn up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("turn")), ignorenulls=True).over(w)
    return scan(spark, sf_dir, "conversations", "conv_id", "turn", "role").select("conv_id", "turn", "role", last("system").alias("system_turn"), last("user").alias("user_turn"))


@query("""
SELECT user_id, session, count(*) AS n, min(ts) AS from_ts, max(ts) AS to_ts FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
  SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR, true) AS BIGINT) AS new FROM events)) GROUP BY user_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped into sessions by gaps of over two hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = scan(spark, sf_dir, "events", "user_id", "ts", "event_id").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    new = F.coalesce(F.col("us") - F.lag("us").over(w) > 7_200_000_000, F.lit(True)).cast("long")
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


@query("""
SELECT source, max(doc_id) - min(doc_id) + 1 = count(DISTINCT doc_id) AS contiguous, string_agg(CAST(doc_id AS VARCHAR), '-' ORDER BY doc_id) FILTER (WHERE r <= 3) AS first_three FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a group's keys are without gaps, and its first three in order."""
    d = scan(spark, sf_dir, "documents", "source", "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    firsts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("doc_id")))), lambda k: k.cast("string")), "-")
    return d.groupBy("source").agg((F.max("doc_id") - F.min("doc_id") + 1 == F.count_distinct("doc_id")).alias("contiguous"), firsts.alias("first_three"))
