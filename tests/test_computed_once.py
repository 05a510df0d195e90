"""Values that lambdas refer to are computed once, and edits are counted only as far as they matter."""

from pyspark.sql import functions as F

from studyloom.functions.columns import fuzzy_match, similarity
from studyloom.operators import outline


def test_titles_and_topics_are_computed_once(spark):
    assert str(outline.canonical_title(F.col("t"))).count("regexp_replace") == 2
    assert str(outline.topics(F.col("t"))).count("aggregate") == 1
    text = "".join(f"【病因{k}】 body number {k}" for k in range(300))
    (row,) = spark.createDataFrame([(text,)], "t string").select(outline.bracket_sections(F.col("t")).alias("s")).collect()
    assert len(row.s) == 300 and {s.title for s in row.s} == {"病因"}


def test_edits_are_counted_up_to_the_bound(spark):
    pairs = [(a, b) for a in ("abcdefghij", "abcdefghiX", "abcdefghXY", "Xbcdefghijk", "abcde", "abcdX", "x" * 40, "x" * 33 + "y" * 7, "x" * 32 + "y" * 8, "") for b in ("abcdefghij", "abcde", "x" * 40, "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    plain = (F.length("a") > 0) & (F.length("b") > 0) & (F.contains(a, b) | F.contains(b, a) | (similarity(a, b) > 0.8))
    got = df.select(fuzzy_match(a, b).alias("x"), plain.alias("y")).collect()
    assert all(r.x == r.y for r in got) and {r.x for r in got} == {True, False}
    assert "levenshtein(a, b)" not in str(fuzzy_match(a, b))
