"""Activity and outcome dashboards: overviews, success rates, streaks, timelines, rolling quotas, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up, json_number, or_else, percent
from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query


@query("""
SELECT user_id, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS n_view, count(DISTINCT CASE WHEN event_type = 'click' THEN event_id END) AS n_click,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS n_purchase, count(DISTINCT CASE WHEN event_type = 'signup' THEN event_id END) AS n_signup,
  round(sum(value), 2) AS total_value, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM events GROUP BY user_id""")
def user_activity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct events of four kinds, total and active days of each user."""
    e = scan(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value", "ts")
    kinds = [F.count_distinct(F.when(F.col("event_type") == k, F.col("event_id"))).alias(f"n_{k}") for k in ("view", "click", "purchase", "signup")]
    return e.groupBy("user_id").agg(*kinds, F.round(F.sum("value"), 2).alias("total_value"), F.count_distinct(F.to_date("ts")).alias("active_days"))


@query("""
SELECT c_mktsegment, event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_k, count(*) AS n, max(ts) AS last_ts
FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def json_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a JSON field by segment and kind, over an inner join."""
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "props", "ts")
    c = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    joined = e.join(c, e.user_id == c.c_custkey)
    return joined.groupBy("c_mktsegment", "event_type").agg(F.round(F.avg(json_number(F.col("props"), "$.k")), 6).alias("avg_k"), F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("""
SELECT source, count(*) AS n_chunks, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(DISTINCT lang) AS n_langs, min(n_chars) AS shortest
FROM documents GROUP BY source""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, range and distinct values of each source's documents."""
    d = scan(spark, sf_dir, "documents", "source", "doc_id", "lang", "n_chars")
    return d.groupBy("source").agg(F.count("*").alias("n_chunks"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count_distinct("lang").alias("n_langs"), F.min("n_chars").alias("shortest"))


@query("""
SELECT count(*) AS completed, CAST(coalesce(floor(avg(o_totalprice) + 0.5), 0) AS BIGINT) AS avg_score, CAST(sum(floor(o_totalprice / 60.0 + 0.5)) AS BIGINT) AS total_minutes
FROM orders WHERE o_orderstatus = 'F'""")
def completed_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of completed rows, rounded mean (0 if none) and minutes rounded row by row."""
    o = scan(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'F'")
    return o.agg(F.count("*").alias("completed"), F.coalesce(half_up(F.avg("o_totalprice")), F.lit(0)).cast("long").alias("avg_score"), F.sum(half_up(F.col("o_totalprice") / 60.0)).cast("long").alias("total_minutes"))


@query("""
SELECT coalesce(nullif(trim(c_mktsegment), ''), 'other') AS specialty, CAST(floor(avg(o_totalprice) + 0.5) AS BIGINT) AS avg_score, count(*) AS n
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def activity_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded mean outcome of completed rows by segment; parents without a child count as 'other'."""
    o = scan(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'")
    c = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    return joined.groupBy(or_else(F.col("c_mktsegment"), "other").alias("specialty")).agg(half_up(F.avg("o_totalprice")).cast("long").alias("avg_score"), F.count("*").alias("n"))


@query("""
SELECT l_returnflag, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (WHERE CASE WHEN l_tax = 0 THEN l_discount > 0 ELSE l_discount / l_tax >= 0.75 END) / count(*) + 0.5) AS BIGINT) AS success_pct
FROM lineitem GROUP BY l_returnflag""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all rows whose ratio reaches 3/4; by a zero denominator any positive numerator passes."""
    li = scan(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_tax")
    ok = F.when(F.col("l_tax") == 0, F.col("l_discount") > 0).otherwise(F.try_divide(F.col("l_discount"), F.col("l_tax")) >= 0.75)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), percent(F.count_if(ok), F.count("*")).alias("success_pct"))


@query("""
SELECT user_id, round(sum(coalesce(value, 0)), 2) AS xp, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days,
  count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS today FROM events GROUP BY user_id""")
def xp_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience points, count, learning days and today's count; today is the last day in the data."""
    e = scan(spark, sf_dir, "events", "user_id", "value", "ts").withColumn("day", F.to_date("ts"))
    today = e.agg(F.max("day").alias("today_day"))
    joined = e.crossJoin(F.broadcast(today))  # one row
    return joined.groupBy("user_id").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("xp"), F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.count_if(F.col("day") == F.col("today_day")).alias("today"))


def streaks(days: DataFrame, user: str, day: str) -> DataFrame:
    """(user, from_day, to_day, length): runs of consecutive days; a window per user over distinct days."""
    distinct = days.select(user, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(user).orderBy(day)))
    runs = distinct.withColumn("island", island).groupBy(user, "island")
    return runs.agg(F.min(day).alias("from_day"), F.max(day).alias("to_day"), F.count("*").alias("length")).drop("island")


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), t AS (SELECT max(day) AS today FROM d),
r AS (SELECT user_id, max(day) AS to_day, count(*) AS length FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM d) GROUP BY user_id, g)
SELECT u.user_id, coalesce(max(length) FILTER (WHERE to_day >= today - 1), 0) AS streak FROM (SELECT DISTINCT user_id FROM d) u LEFT JOIN r USING (user_id), t GROUP BY u.user_id""")
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive active days that end today or yesterday (0 otherwise)."""
    days = scan(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.to_date("ts").alias("day"))
    runs = streaks(days, "user_id", "day").crossJoin(F.broadcast(days.agg(F.max("day").alias("today"))))
    alive = F.when(F.col("to_day") >= F.date_sub("today", 1), F.col("length"))
    return runs.groupBy("user_id").agg(F.coalesce(F.max(alive), F.lit(0)).cast("long").alias("streak"))


@query("""
SELECT o_orderkey, o_custkey, c_name, o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate <= TIMESTAMP '1995-03-01' AND o_orderstatus = 'O'""")
def due_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items due by a given time, with their owner's name (null if unknown)."""
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    due = o.where((F.col("o_orderdate") <= F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")).drop("o_orderstatus")
    return due.join(scan(spark, sf_dir, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest rows; ties by key."""
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return o.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(20)


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'advanced' WHEN o_totalprice >= 150000 THEN 'intermediate' ELSE 'beginner' END AS next_level
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's latest row (an aggregation, so no owner's history is sorted) and the level it recommends."""
    o = scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    level = F.when(F.col("x.o_totalprice") >= 300000, "advanced").when(F.col("x.o_totalprice") >= 150000, "intermediate").otherwise("beginner")
    return last.select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), level.alias("next_level"))


@query("""
SELECT event_id, user_id, count(*) OVER w - 1 AS n_before, round(sum(value) OVER w - value, 4) AS value_before,
  count(*) OVER w - 1 < 3 AND sum(value) OVER w - value < 150 AS allowed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def rolling_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and cost of the hour before each event, and whether the quota let it pass."""
    e = scan(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    n, v = F.count("*").over(w) - 1, F.sum("value").over(w) - F.col("value")
    return e.select("event_id", "user_id", n.alias("n_before"), F.round(v, 4).alias("value_before"), ((n < 3) & (v < 150)).alias("allowed"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS minutes FROM events GROUP BY ALL")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and minutes per day and kind."""
    e = scan(spark, sf_dir, "events", "ts", "event_type", "value")
    return e.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("minutes"))


@query("""
WITH a AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS v, avg(value) FILTER (WHERE event_type = 'click') AS c, avg(value) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT user_id, round(0.4 * coalesce(v, 0) + 0.3 * coalesce(c, 0) + 0.3 * coalesce(p, 0), 4) AS mastery, (v IS NOT NULL)::INT + (c IS NOT NULL)::INT + (p IS NOT NULL)::INT AS components FROM a""")
def mastery_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean of three kinds of evidence per user, with how many of them there are."""
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "value")
    parts = {"view": 0.4, "click": 0.3, "purchase": 0.3}
    a = e.groupBy("user_id").agg(*(F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in parts))
    total = sum((F.lit(w) * F.coalesce(F.col(k), F.lit(0.0)) for k, w in parts.items()), F.lit(0.0))
    return a.select("user_id", F.round(total, 4).alias("mastery"), sum((F.col(k).isNotNull().cast("int") for k in parts), F.lit(0)).alias("components"))


@query("""
WITH a AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS v, avg(value) FILTER (WHERE event_type = 'click') AS c, avg(value) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT user_id, round(0.4 * coalesce(v, 0) + 0.3 * coalesce(c, 0) + 0.3 * coalesce(p, 0), 4) AS mastery FROM a ORDER BY 2, 1 LIMIT 20""")
def weak_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users of least mastery."""
    return mastery_map(spark, sf_dir).select("user_id", "mastery").orderBy("mastery", "user_id").limit(20)


@query("""
WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS s, min(ts) FILTER (WHERE event_type = 'view') AS v, min(ts) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY user_id)
SELECT count(*) AS users, count(s) AS signed, count(*) FILTER (WHERE v >= s) AS viewed, count(*) FILTER (WHERE p >= s) AS bought, count(*) FILTER (WHERE n >= 3) AS bought_three,
  round(median(CASE WHEN p >= s THEN epoch(p) - epoch(s) END) / 60, 2) AS median_minutes FROM f""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the steps they reached, and the median time from the first to the last."""
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "ts")
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    f = e.groupBy("user_id").agg(first("signup").alias("s"), first("view").alias("v"), first("purchase").alias("p"), F.count_if(F.col("event_type") == "purchase").alias("n"))
    seconds = (F.unix_micros(F.col("p").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1e6
    return f.agg(
        F.count("*").alias("users"), F.count("s").alias("signed"), F.count_if(F.col("v") >= F.col("s")).alias("viewed"), F.count_if(F.col("p") >= F.col("s")).alias("bought"),
        F.count_if(F.col("n") >= 3).alias("bought_three"), F.round(F.percentile(F.when(F.col("p") >= F.col("s"), seconds), 0.5) / 60, 2).alias("median_minutes"),
    )


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, min(day) AS first_day FROM d GROUP BY user_id)
SELECT CAST(first_day AS VARCHAR) AS first_day, count(*) AS cohort, count(*) FILTER (WHERE user_id IN (SELECT d.user_id FROM d JOIN f g ON g.user_id = d.user_id WHERE d.day = g.first_day + 7)) AS back_d7 FROM f GROUP BY first_day""")
def retention_d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts by first day and how many came back seven days later."""
    days = scan(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.to_date("ts").alias("day")).distinct()
    first = F.min("day").over(Window.partitionBy("user_id"))
    seen = days.withColumn("first_day", first).groupBy("user_id", "first_day").agg(F.max((F.col("day") == F.date_add("first_day", 7)).cast("int")).alias("back"))
    return seen.groupBy(F.col("first_day").cast("string").alias("first_day")).agg(F.count("*").alias("cohort"), F.sum("back").cast("long").alias("back_d7"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events),
u AS (SELECT user_id, avg(value) FILTER (WHERE z <= 2) - avg(value) FILTER (WHERE a <= 2) AS gain FROM r GROUP BY user_id HAVING count(*) >= 4)
SELECT count(*) AS users, round(median(gain), 6) AS median_gain FROM u""")
def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over users of (mean of the last two) - (mean of the first two), from four rows on."""
    e = scan(spark, sf_dir, "events", "user_id", "value", "ts", "event_id")
    up, down = (Window.partitionBy("user_id").orderBy(F.col("ts"), F.col("event_id")), Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    r = e.select("user_id", "value", F.row_number().over(up).alias("a"), F.row_number().over(down).alias("z"))
    u = r.groupBy("user_id").agg((F.avg(F.when(F.col("z") <= 2, F.col("value"))) - F.avg(F.when(F.col("a") <= 2, F.col("value")))).alias("gain"), F.count("*").alias("n")).where("n >= 4")
    return u.agg(F.count("*").alias("users"), F.round(F.percentile("gain", 0.5), 6).alias("median_gain"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(*) FILTER (WHERE value > 90) / count(*), 6) AS slow_rate FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by kind and the rate of slow ones."""
    e = scan(spark, sf_dir, "events", "event_type", "value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.count_if(F.col("value") > 90) / F.count("*"), 6).alias("slow_rate"))


@query("""
SELECT user_id, CAST(sum(greatest(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 0)) AS BIGINT) AS tokens, round(sum(greatest(value, 0) * 3 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 15) / 1e6, 8) AS cost FROM events GROUP BY user_id""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (never negative) and an estimated cost by user."""
    e = scan(spark, sf_dir, "events", "user_id", "value", "props")
    k = json_number(F.col("props"), "$.k")
    return e.groupBy("user_id").agg(F.sum(F.greatest(F.coalesce(k.cast("long"), F.lit(0)), F.lit(0))).cast("long").alias("tokens"), F.round(F.sum(F.greatest("value", F.lit(0.0)) * 3 + k * 15) / 1e6, 8).alias("cost"))
