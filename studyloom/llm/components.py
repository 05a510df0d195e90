"""Connected components of an edge table as DataFrame joins (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import forget, settle, written


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of them (and the node). Aggregates before it joins."""
    if larger_only:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = both.join(least, "a")
    if larger_only:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of the component.

    Rounds end when a round changes nothing, which is observed as it is written; each is written to the shared folder, so no round
    is computed twice and a lost executor costs its own tasks only. Self-loops give a node with
    itself as root. Null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now = written(edges.where("a != b").distinct(), "edges")
    mark = None
    while True:
        seen_by = Observation()
        round_ = _stars(_stars(now, True), False).observe(seen_by, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s"))
        after = written(round_, "edges")
        seen = seen_by.get
        forget(now)
        now = after
        if mark == seen:
            break
        mark = seen
    settle(edges.sparkSession)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    known = stars.union(roots)
    return known.union(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("root")))
