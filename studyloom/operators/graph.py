"""Graphs and trees: recursive walks, edges in both directions, cycles, missing ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import checkpointed
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query


def tree_walk(nodes: DataFrame, roots: str) -> DataFrame:
    """(id, root, depth, path) of every node (id, parent, name) below the roots that meet a condition; level by level.

    A node that is its own ancestor is not walked again, so a cycle ends; there is no limit of depth."""
    level = nodes.where(roots).select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("path"), F.array("id").alias("trail"))
    children = nodes.select(F.col("id").alias("cid"), "parent", "name")
    out = None
    while True:
        level = checkpointed(level)
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out.drop("trail")
        below = level.join(children, (F.col("id") == F.col("parent")) & ~F.array_contains("trail", F.col("cid")))
        level = below.select(F.col("cid").alias("id"), "root", (F.col("depth") + 1).alias("depth"), F.concat_ws(" > ", "path", "name").alias("path"), F.array_append("trail", F.col("cid")).alias("trail"))


@query("""
WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
t AS (SELECT id, id AS root, 0 AS depth, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, root, depth + 1, path || ' > ' || name FROM n JOIN t ON n.parent = t.id) SELECT * FROM t""")
def recursive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one tree, walked by a recursive query."""
    r = scan(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) id", "cast(null as string) parent", "r_name name")
    n = scan(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) id", "concat('r', n_regionkey) parent", "n_name name")
    s = scan(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) id", "concat('n', s_nationkey) parent", "s_name name")
    return spark.sql(
        """WITH RECURSIVE t AS (SELECT id, id AS root, 0 AS depth, name AS path FROM {nodes} WHERE parent IS NULL
        UNION ALL SELECT n.id, t.root, t.depth + 1, concat(t.path, ' > ', n.name) FROM {nodes} n JOIN t ON n.parent = t.id) SELECT * FROM t""",
        nodes=r.unionByName(n).unionByName(s),
    )


def two_way_edges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Each link at both its ends, once; self-links and missing ends go."""
    real = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    return real.select(F.col(left).alias("src"), F.col(right).alias("dst")).union(real.select(F.col(right).alias("src"), F.col(left).alias("dst"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Nodes with their sorted neighbours."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("related"))


@query("""
WITH d AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT src, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS related FROM d GROUP BY src""")
def edges_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and parts' keys as one set of nodes, all line items as links."""
    near = adjacency(two_way_edges(scan(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey"))
    return near.select("src", F.size("related").cast("long").alias("degree"), F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges on a cycle or between two: those whose start has no way in, or whose end has no way out, are
    peeled off until none is left to peel. (src, dst)."""
    now = checkpointed(edges.select("src", "dst").distinct())
    size, left = -1, now.count()
    while left not in (0, size):
        size = left
        now = checkpointed(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        left = now.count()
    return now


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c) with the greatest c that reaches each node of ``start`` (node, c) along edges; rounds end when nothing changes."""
    now, mark = checkpointed(start), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("node", "c").cast("long"))).first()
        if seen == mark:
            return now
        mark = seen
        moved = edges.join(now, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c")
        now = checkpointed(now.union(moved).groupBy("node").agg(F.max("c").alias("c")))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """The nodes (src, dst) that reach themselves, by strongly connected components.

    Each round peels what is on no cycle and colours every node with the greatest node that reaches it. The nodes of
    a colour that reach its own node back are one component, found for all colours at once, and leave the graph.
    So no set of reachable pairs is made, however large a component is."""
    found = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = on_cycles(edges.where("src != dst"))
    while not left.isEmpty():
        colour = _spread(left.select(F.col("src").alias("node"), F.col("src").alias("c")).union(left.select("dst", "dst")).distinct(), left)
        x, y = colour.toDF("src", "cs"), colour.toDF("dst", "cd")
        back = left.join(x, "src").join(y, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = colour.where("node = c")
        members = _spread(own, back)
        large = members.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
        found = checkpointed(found.union(members.join(large, "c").select("node")).distinct())
        gone = members.select("node")
        left = on_cycles(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    return found


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem),
s AS (SELECT DISTINCT src FROM e), inner_e AS (SELECT e.* FROM e JOIN s ON e.dst = s.src),
w AS (SELECT src AS start, dst AS node FROM inner_e UNION SELECT w.start, e.dst FROM w JOIN inner_e e ON e.src = w.node) SELECT start AS node FROM w WHERE start = node""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that depend on themselves, in the graph of all line items from supplier key to part key."""
    return cyclic_nodes(scan(spark, sf_dir, "lineitem", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())


@query("""
SELECT DISTINCT n.n_nationkey AS src, m.n_nationkey AS dst FROM nation n JOIN nation m ON n.n_regionkey IS NOT DISTINCT FROM m.n_regionkey AND n.n_nationkey < m.n_nationkey""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends resolved by a null-safe key."""
    a = scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").toDF("src", "ra")
    b = scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").toDF("dst", "rb")
    return a.join(b, F.col("ra").eqNullSafe(F.col("rb")) & (F.col("src") < F.col("dst"))).select("src", "dst").distinct()
