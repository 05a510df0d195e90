"""Loads as copy-on-write: upserts, full and idempotent refreshes, conditional updates, resumable work, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The target's rows that the source doesn't replace, and the source's rows. Parquet has no row updates: the
    caller writes the result to a new place."""
    return target.join(source.select(*key), key, "left_anti").unionByName(source)


@query("""
WITH s AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT -1, 'new', 0.0)
SELECT * FROM s UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    delta = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = spark.createDataFrame([(-1, "new", 0.0)], c.schema)
    return upsert(c, delta.unionByName(new), ["c_custkey"])


def load_section(target: DataFrame, source: DataFrame, key: str, section: str, valid: str = "true") -> DataFrame:
    """The target after a section's load: the section's stale rows go, the source's valid rows (one a key) replace
    theirs, all other rows stay. Loading the same source twice gives the same table."""
    fresh = source.where(valid).groupBy(key).agg(F.min(F.struct(*(c for c in source.columns if c != key))).alias("x")).select(key, "x.*").select(*source.columns)
    kept = target.join(fresh.select(section).distinct(), section, "left_anti").join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def load_report(before: DataFrame, after: DataFrame, source: DataFrame, key: str, section: str) -> DataFrame:
    """One row: rows of the section before and after, keys expected, stale ones removed, and whether all is as expected."""
    here = source.select(section).distinct()
    b, a, e = (df.join(here, section, "left_semi").select(key).distinct() for df in (before, after, source))
    marks = b.withColumn("b", F.lit(1)).join(a.withColumn("a", F.lit(1)), key, "full_outer").join(e.withColumn("e", F.lit(1)), key, "full_outer")
    return marks.agg(F.count("b").alias("before"), F.count("a").alias("after"), F.count("e").alias("expected"), F.count_if(F.col("b").isNotNull() & F.col("e").isNull()).alias("stale"), (F.count("a") == F.count("e")).alias("idempotent"))


@query("""
SELECT count(*) FILTER (WHERE p_brand = 'Brand#11') AS before, count(*) FILTER (WHERE p_brand = 'Brand#11' AND p_partkey % 2 = 0) AS after, count(*) FILTER (WHERE p_brand = 'Brand#11' AND p_partkey % 2 = 0) AS expected,
  count(*) FILTER (WHERE p_brand = 'Brand#11' AND p_partkey % 2 <> 0) AS stale, true AS idempotent FROM part""")
def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's load, twice, and its report."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    source = p.where("p_brand = 'Brand#11' and p_partkey % 2 = 0")
    once = load_section(p, source, "p_partkey", "p_brand")
    return load_report(p, load_section(once, source, "p_partkey", "p_brand"), source, "p_partkey", "p_brand")


def cascade_delete(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], start: str, doomed: str) -> dict[str, DataFrame]:
    """The tables after the rows of ``start`` that the condition ``doomed`` holds for are deleted, and with them all rows that refer to a
    deleted one, along ``references``: (child, column, parent, parent's column). A null refers to nothing.

    Keys go from table to table, each table is read once for each reference and joined by its key. A table that leads back to
    itself is an error, as its depth is not known."""
    children: dict[str, list] = {}
    for child, column, parent, key in references:
        children.setdefault(parent, []).append((child, column, key))
    order, open_ = [], []

    def visit(name: str) -> None:
        if name in open_:
            raise ValueError("tables refer to each other in a circle: " + " > ".join([*open_[open_.index(name) :], name]))
        if name not in order:
            open_.append(name)
            for child, *_ in children.get(name, []):
                visit(child)
            open_.pop()
            order.insert(0, name)  # parents before their children

    visit(start)
    gone = {start: tables[start].where(F.coalesce(F.expr(doomed), F.lit(False)))}
    out = dict(tables) | {start: tables[start].where(~F.coalesce(F.expr(doomed), F.lit(False)))}
    for name in order:
        marks = [(column, gone[parent].select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()) for child, column, parent, key in references if child == name and parent in gone]
        if name == start or not marks:
            continue
        rest, lost = tables[name], None
        for column, keys in marks:
            hit = rest.join(keys, column, "left_semi").select(*tables[name].columns)
            lost, rest = hit if lost is None else lost.unionByName(hit), rest.join(keys, column, "left_anti").select(*tables[name].columns)
        gone[name], out[name] = lost, rest
    return out


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS name, count(*) AS n, sum(c_custkey) AS keys FROM customer WHERE c_acctbal >= 0 UNION ALL
SELECT 'orders', count(*), sum(o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL
SELECT 'lineitem', count(*), sum(l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL
SELECT 'events', count(*), sum(event_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM c)""")
def cascade_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when customers in debt go, with their orders, these orders' lines and their events."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}
    extra = {"customer": ["c_acctbal"], "orders": ["o_custkey"], "lineitem": [], "events": ["user_id"]}
    tables = {t: scan(spark, sf_dir, t, k, *extra[t]) for t, k in keys.items()}
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")]
    left = cascade_delete(tables, refs, "customer", "c_acctbal < 0")
    rows = [df.agg(F.count("*").alias("n"), F.sum(keys[t]).alias("keys")).select(F.lit(t).alias("name"), "n", "keys") for t, df in left.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def conditional_update(df: DataFrame, condition: str, changes: dict[str, str]) -> DataFrame:
    """Rows with ``changed``: where the condition holds the columns take new values, else they stay."""
    ok = F.coalesce(F.expr(condition), F.lit(False))
    return df.withColumn("changed", ok).withColumns({c: F.when(F.col("changed"), F.expr(e)).otherwise(F.col(c)) for c, e in changes.items()})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AND o_totalprice > 250000 AS changed FROM orders")
def optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return conditional_update(o, "o_orderstatus = 'O' and o_totalprice > 250000", {"o_orderstatus": "'F'"}).select("o_orderkey", "o_orderstatus", "changed")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 100")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that isn't done yet."""
    done = scan(spark, sf_dir, "labels", "doc_id")
    return scan(spark, sf_dir, "documents", "doc_id", "source", "n_chars").where("n_chars > 100").join(done, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id LIMIT 50")
def backfill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rows that lack a value (a page of a backfill)."""
    j = scan(spark, sf_dir, "documents", "doc_id").join(scan(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return j.where("quality is null").select("doc_id").orderBy("doc_id").limit(50)


@query("""
SELECT p_name, min(p_partkey) AS p_partkey, min_by(p_brand, p_partkey) AS p_brand, string_agg(t, ',' ORDER BY first_key) AS types FROM (
  SELECT p_name, p_type AS t, min(p_partkey) AS first_key, min(p_partkey) AS p_partkey, min_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1, 2) GROUP BY p_name""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one name merged: the first row's values, and the lists' union in order."""
    p = scan(spark, sf_dir, "part", "p_name", "p_partkey", "p_brand", "p_type")
    one = p.groupBy("p_name", "p_type").agg(F.min(F.struct("p_partkey", "p_brand")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("x.p_partkey", "p_type")))
    return one.groupBy("p_name").agg(F.min("x").alias("f"), F.array_join(F.transform(ordered, lambda t: t["p_type"]), ",").alias("types")).select("p_name", "f.p_partkey", "f.p_brand", "types")


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) - prev > 50) AS jumps, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < prev) AS drops FROM (
  SELECT *, lag(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id""")
def counter_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a counter that should neither fall nor jump."""
    e = scan(spark, sf_dir, "events", "user_id", "ts", "event_id", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    x = e.withColumn("prev", F.lag("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("k") - F.col("prev") > 50).alias("jumps"), F.count_if(F.col("k") < F.col("prev")).alias("drops"))


@query("""
SELECT conv_id, turn, r.role AS role, CASE WHEN r.role = 'user' THEN text ELSE 're: ' || text END AS text FROM conversations, (VALUES ('user'), ('assistant')) r(role) WHERE conversations.role = 'user'""")
def paired_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows, of user and assistant, that share a turn."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("re: "), "text").alias("text")))
    return c.select("conv_id", "turn", F.explode(pair).alias("m")).select("conv_id", "turn", "m.role", "m.text")


@query("SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS used FROM events WHERE event_type = 'view' GROUP BY user_id")
def usage_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses counted once a day and user."""
    e = scan(spark, sf_dir, "events", "user_id", "event_type", "ts").where("event_type = 'view'")
    return e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("used"))


#: The title of a failed extraction, as a key; the least content of a row without sections; what stands for a missing chapter and title.
FAILED, LEAST_CONTENT, NO_CHAPTER, POINTS = "extractionfailed", 15, "未分类", "知识要点"


def finalized(rows: DataFrame, book: dict[str, str], part: str | None = None, section: str | None = None) -> DataFrame:
    """``rows`` (order_num, title, chapter, sub_chapter, content, anchor, failed, sections) ready to load: id, path, book and provenance.

    Rows without a title or with that of a failed extraction, failed ones and ones with neither sections nor LEAST_CONTENT characters of
    content go. ``part`` and ``section``, where given, stand for the row's own chapter and sub_chapter, else a blank
    chapter is NO_CHAPTER and a blank sub_chapter null. The id is stable over loads; of rows with one id the first by order_num (then by content) stays. A row without
    sections gets its content as one. The provenance holds a digest of the content and, where it differs, the row's own chapter.

    ``book``: id, subject and edition."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    has_sections = F.coalesce(F.size("sections") > 0, F.lit(False))
    fine = (text("title") != "") & (key(F.col("title")) != FAILED) & ~F.coalesce("failed", F.lit(False)) & (has_sections | (F.length(text("content")) >= LEAST_CONTENT))
    blank = lambda c: F.nullif(c, F.lit(""))
    own = blank(text("chapter"))
    chapter = F.lit(part) if part else F.coalesce(own, F.lit(NO_CHAPTER))
    sub = F.lit(section) if section else blank(text("sub_chapter"))
    out = rows.where(F.coalesce(fine, F.lit(False))).withColumns({"title": text("title"), "content": text("content"), "own": own, "chapter": chapter, "sub_chapter": sub, "anchor": blank(text("anchor"))})
    parts = [F.lit(book["id"]), F.col("chapter"), F.coalesce("sub_chapter", F.lit("")), key(F.col("title"))]
    out = out.withColumn("id", F.when(F.col("anchor").isNull(), stable_id(parts, "kn-")).otherwise(stable_id([*parts, F.col("anchor")], "kn-")))
    one = F.struct("title", "chapter", "sub_chapter", "content", "anchor", "own", "sections")
    first = out.groupBy("id").agg(F.min_by(F.struct("order_num", one.alias("r")), F.struct("order_num", "content")).alias("x")).select("id", "x.order_num", "x.r.*")
    listed = F.when(F.coalesce(F.size("sections") > 0, F.lit(False)), F.col("sections")).when(F.col("content") != "", F.array(F.struct(F.lit(POINTS).alias("title"), F.col("content").alias("content"))))
    path = F.array_compact(F.array(F.lit(book["subject"]), "chapter", "sub_chapter", "title"))
    elsewhere = F.when(F.col("own") != F.col("chapter"), F.col("own"))
    provenance = F.struct(F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.col("anchor").alias("source_anchor"), elsewhere.alias("own_chapter"))
    return first.select("id", "order_num", "title", F.lit(book["subject"]).alias("subject"), "chapter", "sub_chapter", F.lit(book["id"]).alias("book_id"), F.lit(book["edition"]).alias("edition"), "content", listed.alias("sections"), path.alias("knowledge_path"), provenance.alias("provenance"))


@query(r"""
WITH r AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, trim(lang) AS chapter, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS sub, trim(text) AS content, CASE WHEN doc_id % 5 = 0 THEN 'a' || doc_id % 7 END AS anchor FROM documents),
v AS (SELECT *, 'kn-' || substr(sha256('book' || chr(0) || chapter || chr(0) || coalesce(sub, '') || chr(0) || lower(regexp_replace(title, '\s+', '', 'g')) || CASE WHEN anchor IS NULL THEN '' ELSE chr(0) || anchor END), 1, 20) AS id
      FROM r WHERE title <> '' AND doc_id % 11 <> 0 AND length(content) >= 15)
SELECT id, min(doc_id) AS order_num, arg_min(len(list_filter(['subject', chapter, sub, title], lambda x: x IS NOT NULL)), doc_id) AS depth, arg_min(substr(sha256(content), 1, 16), doc_id) AS content_hash FROM v GROUP BY id""")
def finalized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows to load, their first lines as titles."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    rows = d.select(
        F.col("doc_id").alias("order_num"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.col("lang").alias("chapter"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("sub_chapter"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a"), (F.col("doc_id") % 7).cast("string"))).alias("anchor"), (F.col("doc_id") % 11 == 0).alias("failed"), F.lit(None).cast("array<struct<title:string,content:string>>").alias("sections"),
    )
    out = finalized(rows, {"id": "book", "subject": "subject", "edition": "1"})
    return out.select("id", "order_num", F.size("knowledge_path").cast("long").alias("depth"), F.col("provenance.content_hash").alias("content_hash"))
