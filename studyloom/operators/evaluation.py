"""Outputs judged against a golden set: which terms they hold and how, scores, means, and classes of errors; names in a reader's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan
from .terms import term_method

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: What the parts of the overall score weigh, what a forbidden term costs, and how many relations are enough.
WEIGHTS = {"completeness": 0.35, "hallucination_risk": 0.30, "schema_compliance": 0.20, "relation_quality": 0.15}
COST, ENOUGH = 20, 3


def paired(outputs: DataFrame, golden: DataFrame, by: list[str]) -> DataFrame:
    """The rows of both with the same place (``by``); what the longer one has beyond the shorter is left out."""
    return golden.join(outputs, by)


def evaluate(pairs: DataFrame) -> DataFrame:
    """``pairs`` with match_details, completeness, hallucination_risk, schema_compliance, relation_quality, overall_score and errors.

    Golden columns: must_have and forbidden, arrays of terms; expected, an array of relations; synonyms, a map from terms to arrays of
    names. Output columns: content, a map of fields; relations, an array; failed. A required term is found by the first way in which
    some field holds it, fields in order of their names; forbidden ones count once for each field that holds them. errors is a struct of arrays: missing,
    hallucination (distinct terms) and wrong_relation (expected ones that the output lacks). Nulls are empty; without required terms
    completeness is 0."""
    none = F.array().cast("array<string>")
    text = lambda c: F.filter(F.coalesce(F.col(c), none), lambda x: x.isNotNull())
    values = F.transform(F.array_sort(F.map_entries(F.coalesce("content", F.map_from_arrays(none, none)))), lambda e: F.coalesce(e["value"], F.lit("")))
    ready = pairs.withColumns({"fields": values, "must": text("must_have"), "banned": text("forbidden"), "wanted": text("expected"), "had": text("relations")})
    names = lambda t: F.coalesce(F.try_element_at(F.coalesce("synonyms", F.map_from_arrays(none, F.array().cast("array<array<string>>"))), t), none)

    def found(t: Column) -> Column:
        ways = F.transform("fields", lambda f: term_method(f, t, names(t)))
        hit = F.array_position(F.transform(ways, lambda w: w.isin("exact", "normalized", "synonym")), F.lit(True))
        return F.struct(t.alias("term"), (hit > 0).alias("found"), F.when(hit > 0, F.try_element_at(ways, hit.cast("int"))).otherwise("not_found").alias("method"), F.when(hit > 0, F.substring(F.try_element_at("fields", hit.cast("int")), 1, 60)).alias("matched"))

    ready = ready.withColumn("match_details", F.transform("must", found))
    holds = lambda f, t: (t != "") & F.contains(F.lower(f), F.lower(t))
    times = F.aggregate("banned", F.lit(0), lambda n, t: n + F.size(F.filter("fields", lambda f: holds(f, t))))
    filled = F.size(F.filter("match_details", lambda d: d["found"]))
    ready = ready.withColumns({
        "completeness": F.when(F.size("must") > 0, F.round(filled / F.size("must") * 100, 1)).otherwise(0.0),
        "hallucination_risk": F.round(100.0 - times * COST, 1),
        "schema_compliance": F.when(F.coalesce("failed", F.lit(False)), 0.0).otherwise(1.0),
        "relation_quality": F.round(F.least(F.size("had") / ENOUGH * 100, F.lit(100.0)), 1),
    })
    overall = F.round(sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 1)
    errors = F.struct(
        F.filter("match_details", lambda d: ~d["found"])["term"].alias("missing"), F.filter(F.array_distinct("banned"), lambda t: F.exists("fields", lambda f: holds(f, t))).alias("hallucination"),
        F.array_except("wanted", "had").alias("wrong_relation"),
    )
    return ready.withColumns({"overall_score": overall, "errors": errors}).drop("fields", "must", "banned", "wanted", "had")


def means(scored: DataFrame) -> DataFrame:
    """One row with the mean of each score, to one decimal."""
    return scored.agg(*(F.round(F.avg(c), 1).alias(c) for c in [*WEIGHTS, "overall_score"]))


def error_classes(scored: DataFrame, title: str) -> DataFrame:
    """(class, n, titles): how many samples show each class of errors, and the titles of which."""
    classes = {"low_completeness": "missing", "hallucination": "hallucination", "low_relation_quality": "wrong_relation"}
    shown = F.array_compact(F.array(*(F.when(F.size(f"errors.{k}") > 0, F.lit(name)) for name, k in classes.items())))
    return scored.select(F.col(title).alias("title"), F.explode(shown).alias("class")).groupBy("class").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("title")).alias("titles"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a golden sample (its first words required, its last one forbidden), the turn after it as the output."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    golden = c.where("role = 'user'").select("conv_id", "turn", F.array_distinct(F.slice(words, 1, 5)).alias("must_have"), F.slice(F.reverse(words), 1, 1).alias("forbidden"), F.slice(words, 1, 2).alias("expected"))
    out = c.where("role != 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.create_map(F.lit("a"), F.substring_index("text", "\n", 1), F.lit("b"), F.col("text")).alias("content"), F.slice(words, 1, 2).alias("relations"), (F.length("text") < 40).alias("failed"))
    return evaluate(paired(out, golden, ["conv_id", "turn"]).withColumn("synonyms", F.lit(None).cast("map<string,array<string>>")))


@query(r"""
WITH w AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM conversations),
p AS (SELECT g.conv_id, g.turn, list_distinct(g.ws[:5]) AS must, g.ws[len(g.ws):] AS banned, g.ws[:2] AS expected, [lower(split_part(o.text, chr(10), 1)), lower(o.text)] AS f, o.ws[:2] AS had, length(o.text) < 40 AS failed
      FROM w g JOIN w o ON o.conv_id = g.conv_id AND o.turn = g.turn + 1 WHERE g.role = 'user' AND o.role <> 'user'),
n AS (SELECT *, len([t FOR t IN must IF contains(f[2], t) OR contains(regexp_replace(f[2], '[^\p{L}\p{N}()]', '', 'g'), t)]) AS filled,
      coalesce(list_sum([CAST(contains(f[1], t) AS INT) + CAST(contains(f[2], t) AS INT) FOR t IN banned]), 0) AS bad FROM p),
s AS (SELECT conv_id, turn, CASE WHEN len(must) > 0 THEN round(filled * 1.0::DOUBLE / len(must) * 100, 1) ELSE 0 END AS completeness, round(100.0 - bad * 20, 1)::DOUBLE AS hallucination_risk, CASE WHEN failed THEN 0.0 ELSE 1.0 END::DOUBLE AS schema_compliance,
      round(least(len(had)::DOUBLE / 3 * 100, 100), 1) AS relation_quality, len(must) - filled AS n_missing, CAST(bad > 0 AS INT) AS n_hallucination, len([t FOR t IN list_distinct(expected) IF NOT list_contains(had, t)]) AS n_wrong FROM n)
SELECT conv_id, turn, completeness, hallucination_risk, schema_compliance, relation_quality, round(completeness * 0.35::DOUBLE + hallucination_risk * 0.30::DOUBLE + schema_compliance * 0.20::DOUBLE + relation_quality * 0.15::DOUBLE, 1) AS overall_score, n_missing, n_hallucination, n_wrong FROM s""")
def evaluated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores and the numbers of errors of each answer by its question."""
    n = {"n_missing": "missing", "n_hallucination": "hallucination", "n_wrong": "wrong_relation"}
    return _turns(spark, sf_dir).select("conv_id", "turn", *WEIGHTS, "overall_score", *(F.size(f"errors.{k}").cast("long").alias(c) for c, k in n.items()))


#: The numerals of parts, the weight of a name without one, and the order of Chinese names.
NUMERALS, LAST, LOCALE = "一二三四五六七八九十", 999, "zh"


def part_weight(name: Column) -> Column:
    """The number of a part, 一 to 十九, in a name; LAST without one or with another."""
    n = F.regexp_extract(name, f"第([{NUMERALS}]+)篇", 1)
    place = lambda c: F.instr(F.lit(NUMERALS), c)
    teen = F.when(F.length(n) == 1, place(n)).when(F.startswith(n, F.lit("十")), 10 + F.when(F.substring(n, 2, 1) == "十", 10).otherwise(place(F.substring(n, 2, 1))))
    return F.when(n == "", LAST).otherwise(F.coalesce(teen, F.lit(LAST)))


def in_reading_order(names: DataFrame, name: str, within: list[str]) -> DataFrame:
    """``names`` with weight and place, from 1 in each group: by the number of their part, then as a Chinese reader sorts them, then by code."""
    order = Window.partitionBy(*within).orderBy("weight", F.collate(F.col(name), LOCALE), name)
    return names.withColumn("weight", part_weight(F.col(name))).withColumn("place", F.row_number().over(order))


@query("""
WITH n AS (SELECT DISTINCT p_brand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '第' || ['一', '三', '十', '十二', '二'][p_partkey % 5 + 1] || '篇 ' WHEN 2 THEN '第二十篇 ' ELSE '第九篇' END || p_name AS name FROM part),
w AS (SELECT *, CASE WHEN name LIKE '第一篇%' THEN 1 WHEN name LIKE '第二篇%' THEN 2 WHEN name LIKE '第三篇%' THEN 3 WHEN name LIKE '第九篇%' THEN 9 WHEN name LIKE '第十篇%' THEN 10 WHEN name LIKE '第十二篇%' THEN 12 ELSE 999 END AS weight FROM n)
SELECT p_brand, name, weight, row_number() OVER (PARTITION BY p_brand ORDER BY weight, CASE WHEN name LIKE '第%' THEN 0 ELSE 1 END, name) AS place FROM w""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with numbers of several kinds in the order of a catalog, by brand."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    numeral = F.get(F.array(*map(F.lit, ("一", "三", "十", "十二", "二"))), (F.col("p_partkey") % 5).cast("int"))
    kind = F.col("p_size") % 4
    front = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("第"), numeral, F.lit("篇 "))).when(kind == 2, "第二十篇 ").otherwise("第九篇")
    names = p.select("p_brand", F.concat(front, "p_name").alias("name")).distinct()
    return in_reading_order(names, "name", ["p_brand"])
