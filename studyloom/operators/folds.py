"""Order-dependent folds and scores: spaced repetition, exams, locks, rubric scoring, phases.

A fold runs over one key's rows, gathered in order in an array; keys are learners, items or sessions, whose
histories are short. Nothing is gathered across keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

from ..functions.columns import half_up, json_number, let  # noqa: E402

#: Score bounds of the recall qualities 5 .. 1.
QUALITY_BOUNDS = (90, 75, 60, 40, 20)


def quality_of(score):
    """Recall quality 0-5 of a score 0-100."""
    out = F.lit(0)
    for q, bound in reversed(list(zip(range(5, 0, -1), QUALITY_BOUNDS, strict=True))):
        out = F.when(score >= bound, q).otherwise(out)
    return out


def sm2_state(interval=0, ease=2.5, reps=0):
    return F.struct(F.lit(interval).cast("long").alias("interval"), F.lit(ease).cast("double").alias("ease"), F.lit(reps).cast("long").alias("reps"))


def sm2_step(state, quality):
    """The next review state: a quality below 3 starts again; intervals are 1, 6, then interval x ease (as it was
    before this review); the ease is at least 1.3."""
    q = quality.cast("double")
    ease = F.greatest(F.lit(1.3), state["ease"] + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    grown = F.when(state["reps"] == 0, F.lit(1.0)).when(state["reps"] == 1, F.lit(6.0)).otherwise(half_up(state["interval"] * state["ease"]))
    passed = quality >= 3
    return F.struct(F.when(passed, grown).otherwise(F.lit(1.0)).cast("long").alias("interval"), ease.alias("ease"), F.when(passed, state["reps"] + 1).otherwise(F.lit(0)).cast("long").alias("reps"))


def sm2_fold(reviews: DataFrame, by: list[str], order: list[str], quality: str) -> DataFrame:
    """Each key's state after all its reviews in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, quality)))
    done = reviews.groupBy(*by).agg(ordered.alias("r"))
    return done.withColumn("s", F.aggregate("r", sm2_state(), lambda s, r: sm2_step(s, r[quality]))).select(*by, F.col("s.interval").alias("interval"), F.col("s.ease").alias("ease"), F.col("s.reps").alias("reps"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
r AS (SELECT user_id, i, CASE WHEN k >= 90 THEN 5 WHEN k >= 75 THEN 4 WHEN k >= 60 THEN 3 WHEN k >= 40 THEN 2 WHEN k >= 20 THEN 1 ELSE 0 END AS q FROM e),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS interval, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS reps FROM r
  UNION ALL SELECT f.user_id, r.i, CASE WHEN q < 3 THEN 1 WHEN f.reps = 0 THEN 1 WHEN f.reps = 1 THEN 6 ELSE floor(f.interval * f.ease + 0.5) END,
    greatest(1.3, f.ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))), CASE WHEN q < 3 THEN 0 ELSE f.reps + 1 END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, CAST(interval AS BIGINT) AS interval, round(ease, 6) AS ease, reps FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def sm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review state of each learner after all events in order."""
    e = scan(spark, sf_dir, "events", "user_id", "ts", "event_id", "props").withColumn("q", quality_of(json_number(F.col("props"), "$.k")))
    return sm2_fold(e, ["user_id"], ["ts", "event_id"], "q").withColumn("ease", F.round("ease", 6))


def exam_credit(answer, given, kind):
    """1 for an equal answer; for several choices a half if some are right and none is wrong; else 0."""
    right, wrong = F.bit_count(answer.bitwiseAND(given)), F.bit_count(given.bitwiseAND(F.bitwise_not(answer)))
    half = (kind == "multiple") & (right > 0) & (wrong == 0)
    return F.when(given.isNull(), 0.0).when(answer == given, 1.0).when(half, 0.5).otherwise(0.0)


@query("""
WITH a AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) & 15 AS given, CAST(event_id % 15 + 1 AS INTEGER) AS answer FROM events),
c AS (SELECT user_id, CASE WHEN given = answer THEN 1.0 WHEN bit_count(given & answer) > 0 AND bit_count(given & ~answer) = 0 THEN 0.5 ELSE 0.0 END AS credit, given <> answer AS wrong FROM a)
SELECT user_id, CAST(floor(100 * CAST(sum(credit) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS total_score, count(*) FILTER (WHERE NOT wrong) AS n_correct, count(*) FILTER (WHERE wrong) AS n_wrong FROM c GROUP BY user_id""")
def exam_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams with choices as bit masks; partial credit still counts as wrong."""
    e = scan(spark, sf_dir, "events", "user_id", "event_id", "props")
    a = e.select("user_id", json_number(F.col("props"), "$.k").cast("int").bitwiseAND(15).alias("given"), (F.col("event_id") % 15 + 1).cast("int").alias("answer"))
    credit, wrong = exam_credit(F.col("answer"), F.col("given"), F.lit("multiple")), F.col("given") != F.col("answer")
    return a.groupBy("user_id").agg(half_up(100 * F.sum(credit) / F.count("*")).cast("long").alias("total_score"), F.count_if(~wrong).alias("n_correct"), F.count_if(wrong).alias("n_wrong"))


def mastery(quality, reps, best):
    """0-100 of the last quality and the repetitions, at least the best evaluation."""
    by_review = F.least(F.lit(100), half_up(quality / 5.0 * 60 + F.least(reps, F.lit(5)) / 5.0 * 40))
    return F.greatest(F.coalesce(by_review, F.lit(0)), F.coalesce(best, F.lit(0))).cast("long")


def status_of(m):
    return F.when(m >= 80, "mastered").when(m >= 40, "learning").otherwise("new")


def lock_fold(nodes: DataFrame, by: list[str], order: list[str], chapter: str, level: str) -> DataFrame:
    """Nodes in order with ``locked``: a node is locked if the one before it in the same chapter is locked or not
    mastered and it has been hardly begun (below 20); a null level counts as 0.

    A locked node is below 20, so it is not mastered either: only the level of the node before matters, and a window
    over each path tells it."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.coalesce(F.col(level), F.lit(0))
    named = nodes.select(*by, *order, F.col(chapter).alias("chapter"), F.col(level).alias("level"), F.lag(F.struct(F.col(chapter).alias("chapter"), now.alias("level"))).over(w).alias("before"))
    same = F.col("before").isNotNull() & F.col("before.chapter").eqNullSafe(F.col("chapter"))
    return named.select(*by, *order, "chapter", "level", (same & (F.col("before.level") < 80) & (F.coalesce("level", F.lit(0)) < 20)).alias("locked"))


@query("""
WITH RECURSIVE q AS (SELECT l_partkey, CAST(floor(avg(l_quantity) * 2) AS BIGINT) AS level FROM lineitem GROUP BY 1),
n AS (SELECT p_type AS path, p_brand AS chapter, p_partkey, CASE WHEN contains(p_name, 'a') THEN 5 ELSE coalesce(level, 0) END AS level, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS i FROM part LEFT JOIN q ON l_partkey = p_partkey),
f AS (SELECT path, chapter, p_partkey, level, i, false AS locked FROM n WHERE i = 1 UNION ALL
  SELECT n.path, n.chapter, n.p_partkey, n.level, n.i, n.chapter = f.chapter AND NOT (NOT f.locked AND f.level >= 80) AND n.level < 20 FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1)
SELECT path, chapter, p_partkey, level, locked FROM f""")
def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked nodes along each path, by chapter and key."""
    q = scan(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.floor(F.avg("l_quantity") * 2).cast("long").alias("level"))
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand").join(q, F.col("p_partkey") == F.col("l_partkey"), "left")
    level = F.when(F.contains(F.col("p_name"), F.lit("a")), F.lit(5)).otherwise(F.coalesce("level", F.lit(0))).cast("long")
    nodes = p.select(F.col("p_type").alias("path"), "p_brand", "p_partkey", level.alias("level"))
    return lock_fold(nodes, ["path"], ["p_brand", "p_partkey"], "p_brand", "level").select("path", "chapter", "p_partkey", "level", "locked")


@query("""
SELECT user_id, event_id, CASE WHEN k IS NULL THEN 'beginner' WHEN k >= 85 THEN 'advanced' WHEN k >= 60 THEN 'intermediate' ELSE 'beginner' END AS level,
  CASE WHEN value >= 70 AND k < 60 THEN 'overconfident' WHEN value < 40 AND k >= 75 THEN 'underconfident' ELSE 'calibrated' END AS calibration
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def recommended_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next difficulty from a score, and how the confidence fits it."""
    e = scan(spark, sf_dir, "events", "user_id", "event_id", "value", "props").withColumn("k", json_number(F.col("props"), "$.k"))
    k, v = F.col("k"), F.col("value")
    return e.select("user_id", "event_id", stretch_level(k).alias("level"), F.when((v >= 70) & (k < 60), "overconfident").when((v < 40) & (k >= 75), "underconfident").otherwise("calibrated").alias("calibration"))


def stretch_level(score):
    return F.when(score >= 85, "advanced").when(score >= 60, "intermediate").otherwise("beginner")


def greedy_matches(given, wanted, same):
    """Indexes of ``wanted`` that the given texts take, one after another: each takes the first free one it fits."""
    def step(used, text):
        free = F.filter(F.sequence(F.lit(0), F.size(wanted) - 1), lambda i: ~F.array_contains(used, i) & same(text, F.get(wanted, i)))
        first = let(free, lambda x: F.get(x, F.lit(0)))
        return let(F.when(F.size(wanted) > 0, first), lambda i: F.when(i.isNotNull(), F.array_append(used, i)).otherwise(used))

    return F.aggregate(given, F.array().cast("array<int>"), step)


#: Phases of a session and where each may go.
TRANSITIONS = {
    "intro": ["history"], "history": ["exam", "tests"], "exam": ["history", "tests", "diagnosis"], "tests": ["exam", "diagnosis"],
    "diagnosis": ["treatment"], "treatment": ["scoring"], "scoring": ["feedback"], "feedback": [],
}
#: The phases in which an intent is allowed.
PERMISSIONS = {
    "ask_history": ["intro", "history", "exam"], "physical_exam": ["exam", "history"], "order_test": ["tests", "exam"],
    "mention_diagnosis": ["diagnosis", "exam", "tests"], "mention_treatment": ["diagnosis", "treatment"],
    "phase_transition": ["history", "exam", "tests", "diagnosis"], "greeting": ["intro", "history", "exam", "tests"],
    "off_topic": ["intro", "history", "exam", "tests", "diagnosis"], "empty": [], "unknown": ["intro", "history", "exam", "tests"],
}


def _listed(table: dict):
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))


def permitted(intent, phase):
    """Whether an intent is allowed in a phase; no unknown one is."""
    return F.coalesce(F.array_contains(F.try_element_at(_listed(PERMISSIONS), intent.cast("string")), phase.cast("string")), F.lit(False))


def wanted_phase(event_type):
    """The phase that an event of the tables stands for."""
    names = {"view": "exam", "click": "tests", "purchase": "diagnosis", "signup": "treatment", "error": "scoring"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), event_type), F.lit("history"))


def replay_phases(events: DataFrame, by: list[str], order: list[str], wanted: str, start: str = "intro") -> DataFrame:
    """The phase each session is in after its wanted phases in order; moves that aren't allowed are counted and ignored."""
    allowed = _listed(TRANSITIONS)
    begin = F.struct(F.lit(start).alias("phase"), F.lit(0).alias("refused"))

    def step(s, x):
        ok = F.coalesce(F.array_contains(F.try_element_at(allowed, s["phase"]), x[wanted]), F.lit(False))
        return F.struct(F.when(ok, x[wanted]).otherwise(s["phase"]).alias("phase"), F.when(ok, s["refused"]).otherwise(s["refused"] + 1).alias("refused"))

    gathered = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, wanted))).alias("x"))
    return gathered.withColumn("s", F.aggregate("x", begin, step)).select(*by, "s.phase", "s.refused")


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'view' THEN 'exam' WHEN 'click' THEN 'tests' WHEN 'purchase' THEN 'diagnosis' WHEN 'signup' THEN 'treatment' WHEN 'error' THEN 'scoring' ELSE 'history' END AS w FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'intro' AS phase, 0 AS refused FROM e UNION ALL
  SELECT user_id, ei, CASE WHEN ok THEN w ELSE phase END, CASE WHEN ok THEN refused ELSE refused + 1 END FROM (
    SELECT f.user_id, phase, refused, e.i AS ei, e.w, (phase = 'intro' AND w = 'history') OR (phase = 'history' AND w IN ('exam', 'tests')) OR (phase = 'exam' AND w IN ('history', 'tests', 'diagnosis')) OR (phase = 'tests' AND w IN ('exam', 'diagnosis')) OR (phase = 'diagnosis' AND w = 'treatment') OR (phase = 'treatment' AND w = 'scoring') OR (phase = 'scoring' AND w = 'feedback') AS ok
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, phase, refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scan(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type")
    return replay_phases(e.withColumn("w", wanted_phase(F.col("event_type"))), ["user_id"], ["ts", "event_id"], "w")


@query("""
SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY first_id) AS weak FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(event_id) AS first_id FROM events WHERE value < 10 GROUP BY 1, 2) GROUP BY user_id""")
def weak_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of poor results, in the order they came."""
    e = scan(spark, sf_dir, "events", "user_id", "event_id", "value", "props").where("value < 10")
    k = e.groupBy("user_id", json_number(F.col("props"), "$.k").cast("long").alias("k")).agg(F.min("event_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "k")))
    return k.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["k"].cast("string")), ",").alias("weak"))
