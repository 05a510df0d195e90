"""Catalogs, filters, audits and joins: trees, coverage, orphans, duplicates, null rates, rule violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query


@query("""
SELECT CASE WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%brass%' THEN 'brass' ELSE lower(trim(p_type)) END AS subject, count(*) AS n,
  string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1""")
def subject_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sorted distinct labels by normalised subject."""
    p = scan(spark, sf_dir, "part", "p_type", "p_brand")
    low = F.lower("p_type")
    subject = F.when(low.contains("steel"), "steel").when(low.contains("brass"), "brass").otherwise(F.lower(F.trim("p_type")))
    return p.groupBy(subject.alias("subject")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("""
SELECT p_type AS part_name, coalesce(nullif(p_brand, ''), 'uncategorised') AS chapter, count(*) AS n_nodes, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS nodes,
  CAST(sum(count(*)) OVER (PARTITION BY p_type) AS BIGINT) AS n_in_part FROM part GROUP BY 1, 2""")
def chapter_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a three-level tree in order, with counts at two grains."""
    p = scan(spark, sf_dir, "part", "p_type", "p_brand", "p_partkey")
    chapter = F.coalesce(F.nullif(F.col("p_brand"), F.lit("")), F.lit("uncategorised"))
    leaves = p.groupBy(F.col("p_type").alias("part_name"), chapter.alias("chapter")).agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string")), ",").alias("nodes"))
    return leaves.withColumn("n_in_part", F.sum("n_nodes").over(Window.partitionBy("part_name")))


def nested_tree(leaves: DataFrame) -> DataFrame:
    """One row per part with its chapters as an ordered array of structs."""
    return leaves.groupBy("part_name").agg(F.array_sort(F.collect_list(F.struct("chapter", "n_nodes", "nodes"))).alias("chapters"))


@query("""
WITH q AS (SELECT l_partkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT p_brand AS chapter, count(*) AS n, count(*) FILTER (WHERE m >= 26) AS mastered, count(*) FILTER (WHERE m >= 24 AND m < 26) AS learning, CAST(floor(100.0 * count(*) FILTER (WHERE m >= 26) / count(*) + 0.5) AS BIGINT) AS mastered_pct
FROM part LEFT JOIN q ON l_partkey = p_partkey GROUP BY 1""")
def progress_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts and percentage by chapter; the large side is aggregated before the join."""
    q = scan(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"))
    j = scan(spark, sf_dir, "part", "p_partkey", "p_brand").join(q, F.col("p_partkey") == F.col("l_partkey"), "left")
    done, some = F.count_if(F.col("m") >= 26), F.count_if((F.col("m") >= 24) & (F.col("m") < 26))
    return j.groupBy(F.col("p_brand").alias("chapter")).agg(F.count("*").alias("n"), done.alias("mastered"), some.alias("learning"), F.floor(F.lit(100.0) * done / F.count("*") + 0.5).cast("long").alias("mastered_pct"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')) AND (p_brand = 'Brand#11' OR p_type = 'STANDARD')")
def search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal substrings in two columns, case aside, and an OR of equalities."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    hit = F.lower("p_name").contains("al") | F.lower("p_type").contains("al")
    return p.where(hit & ((F.col("p_brand") == "Brand#11") | (F.col("p_type") == "STANDARD"))).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "part", "p_partkey", "p_brand").where(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33"))


@query(r"""SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n_tokens FROM documents WHERE list_contains(string_split(text, ' '), 'the')""")
def array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose token array holds a token."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("tokens", F.split("text", " "))
    return d.where(F.array_contains("tokens", "the")).select("doc_id", F.size(F.array_distinct("tokens")).cast("long").alias("n_tokens"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def exists_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose owner meets a condition (semi join)."""
    c = scan(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000")
    return scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 7")
def secured_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One principal's rows, without the hidden column."""
    from ..sources.tables import secured

    return secured(scan(spark, sf_dir, "customer"), "c_nationkey", 7, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a link."""
    links = scan(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 48")
    return scan(spark, sf_dir, "part", "p_partkey", "p_name").join(links, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("SELECT n_nationkey, n_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey WHERE r_regionkey IS NULL")
def missing_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = scan(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    return scan(spark, sf_dir, "nation").join(parents, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").select("n_nationkey", "n_name")


@query("""SELECT r_name, n_name, s_suppkey, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").where("s_acctbal > 0")
    n, r = scan(spark, sf_dir, "nation"), scan(spark, sf_dir, "region")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "s_suppkey", "s_name")


@query("""
SELECT count(*) AS n, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS uncovered, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphan,
  round(100.0 * count(l.doc_id) / nullif(count(*), 0), 4) AS covered_pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and orphan links, and the covered percentage."""
    d, links = scan(spark, sf_dir, "documents", "doc_id"), scan(spark, sf_dir, "labels", "doc_id").distinct()
    both = d.withColumn("d", F.lit(1)).join(links.withColumn("l", F.lit(1)), "doc_id", "full_outer")
    n, covered = F.count("d"), F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull())
    return both.agg(n.alias("n"), covered.alias("covered"), (n - covered).alias("uncovered"), F.count_if(F.col("d").isNull()).alias("orphan"), F.round(100.0 * covered / F.nullif(n, F.lit(0)), 4).alias("covered_pct"))


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    return d.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""
SELECT source, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS no_quality, count(*) FILTER (WHERE coalesce(toxic, quality) IS NULL) AS no_label, count(*) FILTER (WHERE lang NOT IN ('en', 'de') OR lang IS NULL) AS other_lang,
  round(100.0 * count(*) FILTER (WHERE quality IS NULL) / count(*), 4) AS missing_pct, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS not_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) > 0""")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rates by source, with null-safe comparisons."""
    j = scan(spark, sf_dir, "documents", "doc_id", "source", "lang").join(scan(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.count_if(F.col("quality").isNull())
    return j.groupBy("source").agg(
        F.count("*").alias("n"), missing.alias("no_quality"), F.count_if(F.coalesce("toxic", "quality").isNull()).alias("no_label"), F.count_if(~F.col("lang").isin("en", "de") | F.col("lang").isNull()).alias("other_lang"),
        F.round(100.0 * missing / F.count("*"), 4).alias("missing_pct"), F.count_if(~F.col("quality").eqNullSafe(F.lit(1))).alias("not_good"),
    ).where("n > 0")


def violations(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """(key..., rule): one row for each rule that a row breaks; a rule is the condition of being bad."""
    broken = F.array_compact(F.array(*(F.when(F.expr(bad), F.lit(name)) for name, bad in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


@query("""
SELECT rule, count(*) AS n, min(o_orderkey) AS first_key FROM (
  SELECT o_orderkey, 'cheap' AS rule FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT o_orderkey, 'late' FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '2000-01-01') GROUP BY rule""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of enum, range and cross-column rules, counted."""
    o = scan(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    rules = {"cheap": "o_totalprice < 5000", "status": "o_orderstatus not in ('O', 'F')", "late": "o_orderstatus = 'F' and o_orderdate > timestamp_ntz'2000-01-01'"}
    return violations(o, ["o_orderkey"], rules).groupBy("rule").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def gates(df: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(gate, passed): whether each condition holds for all rows; true for none."""
    checks = df.agg(*(F.coalesce(F.bool_and(F.expr(c)), F.lit(True)).alias(g) for g, c in conditions.items()))
    return checks.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in conditions))).alias("x")).select("x.*")


def require(df: DataFrame, conditions: dict[str, str]) -> None:
    """Raise with the names of all gates that fail."""
    failed = [r.gate for r in gates(df, conditions).collect() if not r.passed]
    if failed:
        raise ValueError(f"failed: {', '.join(failed)}")


@query("""
SELECT 'positive' AS gate, coalesce(bool_and(l_quantity > 0), true) AS passed FROM lineitem UNION ALL SELECT 'discounted', coalesce(bool_and(l_discount <= 0.05), true) FROM lineitem
UNION ALL SELECT 'dated', coalesce(bool_and(l_shipdate IS NOT NULL), true) FROM lineitem""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = scan(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_shipdate")
    return gates(li, {"positive": "l_quantity > 0", "discounted": "l_discount <= 0.05", "dated": "l_shipdate is not null"})


@query("SELECT c_custkey, 'only_customer' AS side FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 13 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT c_custkey, 'both' FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 13 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference and intersection of key sets."""
    c = scan(spark, sf_dir, "customer", "c_custkey", "c_nationkey").where("c_nationkey < 13").select("c_custkey")
    o = scan(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o).withColumn("side", F.lit("only_customer")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))


@query("""
SELECT source, lang, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (WHERE n_chars < 200) / count(*) + 0.5) AS BIGINT) AS short_pct FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 30""")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 largest groups with a rate."""
    d = scan(spark, sf_dir, "documents", "source", "lang", "n_chars")
    g = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.floor(100.0 * F.count_if(F.col("n_chars") < 200) / F.count("*") + 0.5).cast("long").alias("short_pct"))
    return g.orderBy(F.desc("n"), "source", "lang").limit(30)


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'metal' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE p_type END AS subject, CASE WHEN p_name IS NULL OR p_name = '' THEN 'unnamed' ELSE split_part(p_name, ' ', 1) END AS chapter FROM part")
def ordered_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based repairs in order, as one projection."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_type", "p_name")
    subject = F.when(F.col("p_type").like("%STEEL%"), "metal").when(F.col("p_type").like("PROMO%"), "promo").otherwise(F.col("p_type"))
    chapter = F.when(F.col("p_name").isNull() | (F.col("p_name") == ""), "unnamed").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return p.select("p_partkey", subject.alias("subject"), chapter.alias("chapter"))


@query("""
SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, length(html) AS html_chars FROM pages""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.length("html").cast("long").alias("html_chars"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of raw pages (Java patterns, so no SQL twin; tests compare with Python)."""
    from ..sources.tables import html_text

    return scan(spark, sf_dir, "pages", "page_id", "html").select("page_id", html_text().alias("text")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
