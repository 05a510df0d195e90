"""Names resolved to known ones by ladders of rungs, each taking only what the ones before have left.

A rung is an equality join on some key of both names, so no rung compares all pairs; the rungs of similar names and of
parts of names find candidates by rare characters or trigrams, without loss, and verify them.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import no_space, title_key
from ..plans.registry import Registry
from ..sources.tables import scan
from .search import rare_first

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: Confidence of a resolution by rung, and from which on it needs no review.
CONFIDENCE = {"exact_title": 0.98, "alias": 0.92, "normalized": 0.85, "fuzzy": 0.65}
SURE = 0.85
#: The least ratio of similar headings; the least length of a heading that begins another, and of what follows.
RATIO, STEM = 0.85, 4


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff and Obershelp's similarity: twice the length of the longest matching blocks, taken recursively, over both lengths."""
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)  # what it learns of this side is kept
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def _numbered(name: Column) -> Column:
    """The characters with how often each came before, so that repeats count."""
    chars = F.array_sort(F.split(name, ""))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))


def similar_sequences(wanted: DataFrame, known: DataFrame, least: float = RATIO) -> DataFrame:
    """(name, target, ratio) of all pairs of ``wanted`` (name) and ``known`` (target) with a ratio of ``least`` (over 0.5) or more.

    2 M >= least (a + b) for the M characters in common blocks, and M is at most the characters in common (counted with
    repeats) and at most the shorter length; so lengths differ by a factor of 2 / least - 1 at most, and
    a name shares at least its length times least / (2 - least) characters with one that is similar: its rarest characters, as many as may be
    missing and one more, hold one of the other's such. Only names that meet in one are compared."""
    if least <= 0.5:
        raise ValueError("the ratio must be over 0.5")
    both = wanted.select("name").union(known.select("target")).distinct().where("length(name) > 0")
    need = F.ceil(F.length("name") * F.lit(least / (2 - least)) - 1e-9).cast("long")
    first = rare_first(both.select("name", need.alias("need"), F.explode(_numbered(F.col("name"))).alias("gram"))).where("at <= size - need")
    x = first.join(wanted.select("name").distinct(), "name").select("name", F.col("size").alias("n"), "gram")
    y = first.join(known.select(F.col("target").alias("name")).distinct(), "name").select(F.col("name").alias("target"), F.col("size").alias("k"), "gram")
    fits = 2 * F.least("n", "k") >= F.lit(least - 1e-9) * (F.col("n") + F.col("k"))
    pairs = x.join(y, "gram").where(fits).select("name", "target").distinct()
    shared = F.size(F.array_intersect(_numbered(F.col("name")), _numbered(F.col("target"))))
    pairs = pairs.where(2 * shared >= F.lit(least - 1e-9) * (F.length("name") + F.length("target")))
    return pairs.withColumn("ratio", sequence_ratio("name", "target")).where(F.col("ratio") >= least)


def match_headings(wanted: DataFrame, known: DataFrame, least: float = RATIO) -> DataFrame:
    """(name, target, rung, how) for each wanted heading (name, aliases) and the known ones (target, pos), in order of pos.

    Rungs: 1 equal without blanks, or one of the aliases is (strict); 2 equal as a title key (fuzzy); 3 similar title
    keys (fuzzy); 4 a known key of STEM characters or more begins the wanted one, which goes on for as many
    (hierarchical). In a rung the known heading of least pos counts, and only headings that no earlier rung has found go on; what is
    left is ``missing``."""
    strict, key = no_space, title_key
    names = wanted.select("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).dropDuplicates(["name"])
    best = lambda hits, rung: hits.groupBy("name").agg(F.min(F.struct("pos", "target")).alias("x")).select("name", F.col("x.target").alias("target"), F.lit(rung).alias("rung"))
    plain = known.where("target is not null").select("target", "pos", strict(F.col("target")).alias("strict"), key(F.col("target")).alias("key"))
    forms = names.select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), strict))).alias("strict"))
    found = best(forms.join(plain, "strict"), 1)

    left = names.join(found, "name", "left_anti").select("name", key(F.col("name")).alias("key")).where("key != ''")
    second = best(left.join(plain.where("key != ''"), "key"), 2)
    left = left.join(second, "name", "left_anti")
    keys = plain.where("key != ''").groupBy("key").agg(F.min(F.struct("pos", "target")).alias("y")).select("key", "y.pos", "y.target")
    near = similar_sequences(left.select(F.col("key").alias("name")), keys.select(F.col("key").alias("target")), least).select(F.col("name").alias("key"), F.col("target").alias("near"))
    third = best(left.join(near, "key").select("name", F.col("near").alias("key")).join(keys, "key"), 3)
    left = left.join(third, "name", "left_anti")
    long = left.where(F.length("key") >= 2 * STEM)
    stems = long.select("name", F.explode(F.transform(F.sequence(F.lit(STEM), F.length("key") - STEM), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    fourth = best(stems.join(keys, "key"), 4)
    found = found.unionByName(second).unionByName(third).unionByName(fourth)
    how = F.when(F.col("rung") == 1, "strict").when(F.col("rung") <= 3, "fuzzy").when(F.col("rung") == 4, "hierarchical").otherwise("missing")
    return names.select("name").join(found, "name", "left").select("name", "target", "rung", how.alias("how"))


def _match_key(c: Column) -> Column:
    """Lower case without bracketed parts and blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[（(].*?[）)]", ""), r"\s+", "")


def resolve_relations(relations: DataFrame, points: DataFrame, strict: bool = False) -> DataFrame:
    """``relations`` (source_id, target_name, relation_type) resolved to ``points`` (id, title, aliases).

    Candidates are all points but the source itself: ``exact_title`` where the titles are equal, or their keys (lower case, without
    bracketed parts and blanks); ``alias`` where an alias has the key; with ``strict`` only equal titles are exact and equal keys
    ``normalized``. Where there are none of these, ``fuzzy`` ones: titles whose key holds the wanted one, of over 3 characters. The
    first candidate of the highest CONFIDENCE, by id, is the resolution if that is SURE, else the relation needs review.

    Result: the relation's columns with resolved_target_id, match_method (``unresolved`` without candidates), confidence, needs_review,
    ambiguous (others are as good) and candidates, an array of (target_id, method, confidence). Equal relations count
    once; without a source or a name there is none; an empty key equals nothing, but an equal title does.

    Candidates are gathered once for each name, not for each relation, and joined by name."""
    shape = "array<struct<rank:int,target_id:long,method:string>>"
    wanted = relations.where("source_id is not null and target_name != ''").select("source_id", "target_name", "relation_type").distinct()
    names = wanted.select("target_name").distinct().withColumn("key", _match_key(F.col("target_name")))
    known = points.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("title", F.lit("")).alias("title"), "aliases").withColumn("key", _match_key(F.col("title")))

    keyed = names.where("key != ''")
    rung = lambda df, rank, method: df.select("target_name", F.struct(F.lit(rank).alias("rank"), F.col("id").alias("target_id"), F.lit(method).alias("method")).alias("c"))
    same = rung(names.join(known, F.col("target_name") == F.col("title")).drop(known["key"]), 1, "exact_title")
    by_key = rung(keyed.join(known.drop("aliases"), "key"), 3 if strict else 1, "normalized" if strict else "exact_title")
    aliases = known.select("id", F.explode("aliases").alias("alias")).select("id", _match_key(F.col("alias")).alias("key"))
    by_alias = rung(keyed.join(aliases, "key"), 2, "alias")
    every = same.union(by_key).union(by_alias).groupBy("target_name", "c.target_id").agg(F.min("c").alias("c"))
    listed = every.groupBy("target_name").agg(F.array_sort(F.collect_list("c")).alias("near"))

    told = wanted.join(listed, "target_name", "left")
    others = lambda c: F.filter(F.coalesce(c, F.array().cast(shape)), lambda x: x["target_id"] != F.col("source_id").cast("long"))
    told = told.withColumn("near", others(F.col("near")))

    # the last rung, only for names of which some relation has no candidate yet
    rest = told.where("size(near) = 0").select("target_name").distinct().withColumn("key", _match_key(F.col("target_name"))).where("length(key) > 3")
    trigrams = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))."), F.lit(1)))
    titles = known.where("length(title) > 3").select("id", "key")
    held = titles.select("key").distinct().select("key", F.explode(trigrams(F.col("key"))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("often"))
    grams = rest.select("target_name", F.col("key").alias("part"), F.explode(trigrams(F.col("key"))).alias("gram"))
    rarest = grams.join(often, "gram").groupBy("target_name", "part").agg(F.min(F.struct("often", "gram"))["gram"].alias("gram"))
    inside = rarest.join(held, "gram").where(F.contains("key", "part")).select("target_name", "key").join(titles, "key")
    parts = inside.groupBy("target_name").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("rank"), F.col("id").alias("target_id"), F.lit("fuzzy").alias("method")))).alias("far"))
    told = told.join(parts, "target_name", "left").withColumn("all", F.when(F.size("near") > 0, F.col("near")).otherwise(others(F.col("far"))))

    confidence = lambda x: F.try_element_at(F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv)), x["method"])
    first = F.get(F.col("all"), F.lit(0))
    told = told.withColumn("confidence", F.coalesce(confidence(first), F.lit(0.0)))
    return told.select(
        "source_id", "target_name", "relation_type", F.when(F.col("confidence") >= SURE, first["target_id"]).alias("resolved_target_id"),
        F.coalesce(first["method"], F.lit("unresolved")).alias("match_method"), "confidence", ((F.col("confidence") < SURE) | (F.coalesce(first["method"], F.lit("")) == "fuzzy")).alias("needs_review"),
        (F.size(F.filter("all", lambda x: x["rank"] == first["rank"])) > 1).alias("ambiguous"),
        F.transform("all", lambda x: F.struct(x["target_id"].alias("target_id"), x["method"].alias("method"), confidence(x).alias("confidence"))).alias("candidates"),
    )


#: Names of parts as wanted: a form for each size of part.
_FORMS = [("p_name", "p_name"), ("upper(p_name)", "upper(p_name)"), ("concat(p_name, ' (', p_brand, ')')", "p_name || ' (' || p_brand || ')'"), ("p_brand", "p_brand"), ("substring(p_name, 2, length(p_name) - 2)", "substr(p_name, 2, length(p_name) - 2)"), ("concat('no ', p_name)", "'no ' || p_name"), ("substring(p_name, 1, 3)", "substr(p_name, 1, 3)")]


def _form(which: int) -> str:
    return "CASE pmod(p_size, 7) " + " ".join(f"WHEN {i} THEN {f[which]}" for i, f in enumerate(_FORMS)) + " END"


_KEY = r"regexp_replace(regexp_replace(lower(trim({})), '[（(].*?[）)]', '', 'g'), '\s+', '', 'g')"


@query(f"""
WITH k AS (SELECT p_name AS title, min(p_partkey) AS id, list(DISTINCT p_brand) FILTER (WHERE p_partkey % 50 = 0) AS aliases FROM part GROUP BY 1),
r AS (SELECT DISTINCT k.id AS source_id, {_form(1).replace('pmod(p_size, 7)', 'p_size % 7')} AS target_name, p_type AS relation_type FROM part JOIN k ON title = p_name),
n AS (SELECT source_id, target_name, relation_type, {_KEY.format('target_name')} AS key FROM r WHERE target_name <> ''),
c AS (SELECT n.*, k.id AS target_id, CASE WHEN title = target_name OR (key <> '' AND {_KEY.format('title')} = key) THEN 1 WHEN key <> '' AND list_contains([{_KEY.format('a')} FOR a IN aliases], key) THEN 2 END AS rank
      FROM n JOIN k ON k.id <> n.source_id),
f AS (SELECT n.*, k.id AS target_id, 4 AS rank FROM n JOIN k ON k.id <> n.source_id AND length(title) > 3 AND length(key) > 3 AND contains({_KEY.format('title')}, key)
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rank IS NOT NULL AND c.source_id = n.source_id AND c.target_name = n.target_name AND c.relation_type = n.relation_type)),
a AS (SELECT * FROM c WHERE rank IS NOT NULL UNION ALL SELECT * FROM f),
s AS (SELECT source_id, target_name, relation_type, min(rank) AS rank, arg_min(target_id, (rank, target_id)) AS best, count(*) AS n_candidates, count(*) FILTER (WHERE rank = least_rank) AS n_best
      FROM (SELECT *, min(rank) OVER (PARTITION BY source_id, target_name, relation_type) AS least_rank FROM a) GROUP BY ALL)
SELECT n.source_id, n.target_name, n.relation_type, CASE WHEN rank <= 3 THEN best END AS resolved_target_id, CASE rank WHEN 1 THEN 'exact_title' WHEN 2 THEN 'alias' WHEN 4 THEN 'fuzzy' ELSE 'unresolved' END AS match_method,
  CASE rank WHEN 1 THEN 0.98 WHEN 2 THEN 0.92 WHEN 4 THEN 0.65 ELSE 0.0 END::DOUBLE AS confidence, coalesce(rank, 9) > 3 AS needs_review, coalesce(n_best, 0) > 1 AS ambiguous, coalesce(n_candidates, 0) AS n_candidates
FROM n LEFT JOIN s ON s.source_id = n.source_id AND s.target_name = n.target_name AND s.relation_type = n.relation_type""")
def resolved_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as relations from their name to a form of it or their brand, resolved among all names, of which some have brands as aliases."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    known = p.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"), F.collect_set(F.when(F.col("p_partkey") % 50 == 0, F.col("p_brand"))).alias("aliases"))
    rels = p.join(known.select(F.col("title").alias("p_name"), F.col("id").alias("source_id")), "p_name").select("source_id", F.expr(_form(0)).alias("target_name"), F.col("p_type").alias("relation_type"))
    return resolve_relations(rels, known).withColumn("n_candidates", F.size("candidates").cast("long")).drop("candidates")


@query()
def heading_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in other forms matched to the names as they are, by all rungs (no SQL twin for similar sequences; a
    test compares with nested loops and a plain sequence matcher)."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    known = p.groupBy(F.col("p_name").alias("target")).agg(F.min("p_partkey").alias("pos"))
    name = F.col("p_name")
    forms = F.array(name, F.concat(name, F.lit("s")), F.concat(F.substring(name, 2, 99), F.lit("x")), F.concat(name, F.lit(" of "), F.col("p_brand")), F.concat(F.col("p_brand"), name), F.concat(F.lit("第一章"), name, F.lit("（x）")))
    wanted = p.select("p_name", "p_brand").distinct().select(F.explode(forms).alias("name"), F.array(F.concat(F.lit("x "), name)).alias("aliases")).dropDuplicates(["name"])
    return match_headings(wanted, known)
