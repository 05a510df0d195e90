"""Ranks against a walk over positions."""

import random
import re

import pytest

from studyloom.operators import fulltext


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def rank(text, terms):
    """Every stretch that holds all terms and none of whose parts does, one by one."""
    ws = words(text)
    at = [i for i, w in enumerate(ws) if w in terms]
    total, stretches = 0.0, []
    for i in at:
        end = next((j for j in at if j >= i and set(terms) <= set(ws[i : j + 1])), None)
        if end is not None and not set(terms) <= set(ws[i + 1 : end + 1]):
            stretches.append((i, end))
    for p, q in stretches:
        total += 0.1 / (1 + sum(w not in terms for w in ws[p : q + 1]))
    return total if stretches else None


@pytest.mark.parametrize("asked", ["a", "a b", "a B, c!", "a b c d", "zz a", "", "a a b"])
def test_ranks_match_a_walk(spark, asked):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["A b-C", None, "", "a_b c"]
    terms = fulltext.query_terms(asked)
    index = fulltext.inverted_index(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    got = {r.id: r["rank"] for r in fulltext.ranked(index, asked).collect()}
    want = {i: r for i, t in enumerate(texts) if terms and (r := rank(t, terms)) is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_ranks_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.id: r["rank"] for r in fulltext.ranked(fulltext.inverted_index(docs), "the of and").collect()}
    want = {r.doc_id: x for r in docs.collect() if (x := rank(r.text, ["the", "of", "and"])) is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want) and got


def test_index_places(spark):
    index = fulltext.inverted_index(spark.createDataFrame([(1, "One two, ONE"), (2, None)], "doc_id int, text string")).collect()
    assert sorted((r.term, r.id, r.positions) for r in index) == [("one", 1, [1, 3]), ("two", 1, [2])]


def test_hybrid_filters_and_mixes(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a c c b", "x"), (3, "c", "x"), (4, "c", "x"), (5, "a b", "y"), (6, "a b", "x")], "doc_id long, text string, src string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0])], "id long, embedding array<double>")
    got = fulltext.hybrid(docs, vectors, "a b", [1.0, 0.0], 10, docs["src"] == "x").collect()
    assert [(r.id, round(r["rank"], 4)) for r in got] == [(3, 0.0), (1, 0.1), (2, round(0.1 / 3, 4))]
    assert [r.id for r in fulltext.hybrid(docs, vectors, "a b", [1.0, 0.0], 2).collect()] == [5, 3]
    assert [r.id for r in fulltext.hybrid(docs, vectors, " ", [1.0, 0.0], 9).collect()] == [5, 3]
