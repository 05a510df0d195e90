"""Buckets of the same lines are one, so that near copies that share most bands don't meet in each of them."""

from pyspark.sql import functions as F

from studyloom.llm import line_dedup
from studyloom.llm.line_dedup import _met, _shingles, banded, lines_of, signatures
from tests.llm.test_line_dedup import near


def test_buckets_of_the_same_members_are_one(spark):
    docs = spark.createDataFrame(near(7) + [(99, "a line that has no copy at all")], "doc_id long, text string")
    lines = lines_of(docs, "doc_id", "text")
    members = {}
    for r in banded(signatures(lines)).collect():
        members.setdefault(r.b, set()).add(r.h)
    want = {frozenset(x) for x in members.values() if len(x) > 1}
    got = {}
    for r in _met(lines)[1].collect():
        got.setdefault(r.b, []).append(r.h)
    assert len(got) == len(want) < sum(len(x) > 1 for x in members.values())
    assert {frozenset(x) for x in got.values()} == want and all(len(x) == len(set(x)) for x in got.values())


def test_shingles_of_a_line(spark):
    rows = [("abc",), ("abcdefgh",), ("abcdefghi",), ("z" * 50,), ("\U0001f600" * 7 + "éab",)]
    got = spark.createDataFrame(rows, "key string").select("key", F.size(_shingles(F.col("key"))).alias("n")).collect()
    assert {r.key: r.n for r in got} == {k: len({k[i : i + 8] for i in range(max(1, len(k) - 7))}) for (k,) in rows}


def test_a_pair_is_verified_once(spark, monkeypatch):
    """A bucket's leader meets the others in the first step only."""
    seen, verify = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *rest: seen.append([tuple(sorted((r.a, r.b))) for r in pairs.collect()]) or verify(pairs, *rest))
    docs = spark.createDataFrame(near(5), "doc_id long, text string")
    line_dedup.line_dedup(docs).collect()
    first, *later = seen
    assert first and not {p for step in later for p in step} & set(first)
