"""Candidates of name matching, term search and quotes against nested loops."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from studyloom.functions.columns import fuzzy_match, word_in
from studyloom.operators import graph, search, terms


def test_similar_names_lose_nothing(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(150)} | {"blue anvil", "old anvil", "anvil", "aaaa", "aaab", "baaa"}
    n = spark.createDataFrame([(x,) for x in sorted(names)], "name string")
    got = {(r.a, r.b) for r in search.similar_names(n, 0.6).collect()}
    pairs = n.select(F.col("name").alias("a")).crossJoin(n.select(F.col("name").alias("b"))).where("a < b")
    assert got == {(r.a, r.b) for r in pairs.where(fuzzy_match(F.col("a"), F.col("b"), 0.6)).collect()} and ("blue anvil", "old anvil") in got


def holds(text, term):
    """A term in a text, by the rules of ``word_in``, in plain Python."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKC", x).lower() if not c.isspace() and unicodedata.category(c)[0] not in "PSZ")
    term = term.strip()
    if re.fullmatch(r"[A-Za-z0-9]{1,4}", term):
        return bool(re.search(rf"(^|[^a-z0-9]){term}([^a-z0-9]|$)", text, re.I | re.A))
    return len(plain(term)) >= 2 and plain(term) in plain(text)


@pytest.mark.parametrize("limit", [terms.TERM_BYTES, -1])
def test_terms_lose_nothing(spark, monkeypatch, limit):
    """By the automaton and by the join."""
    monkeypatch.setattr(terms, "TERM_BYTES", limit)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abAB肺Ｂ-") for _ in range(rng.randint(1, 7))) for _ in range(6)) for _ in range(60)] + ["", None, "a", "a"]
    wanted = {"".join(rng.choice("ab B肺ａ-") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"", " ", "肺", "-", "abab\\E", "  ab "}
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted(tuple(r) for r in terms.terms_in(t, spark.createDataFrame([(x,) for x in [*wanted, None]], "term string"), ["id"]).collect())
    assert got == sorted((i, w) for i, x in enumerate(texts) for w in wanted if x is not None and holds(x, w)) and got
    every = t.where("text is not null").crossJoin(spark.createDataFrame([(x,) for x in wanted], "term string")).where(word_in(F.col("text"), F.col("term")))
    assert got == sorted((r.id, r.term) for r in every.collect())


def test_terms_of_answer_keys(spark):
    """Names of diagnoses in running text, in other widths and spellings, but not as arbitrary parts of words."""
    cases = [("患者是肺栓塞吗", "肺栓塞", True), ("escopdx", "COPD", False), ("a COPD, b", "copd", True), ("ＳＴＥＭＩ 可能", "STEMI", True), ("S-T-E-M-I", "STEMI", True), ("你的诊断是 STEMI。", "STEMI", True),
             ("我就是胸口一直疼。", "心梗", False), ("PE?", "PE", True), ("pen", "PE", False), ("痛PE痛", "PE", True), ("x", None, False), (None, "PE", False), ("...", "..", False)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, text string, term string, want boolean")
    for r in frame.withColumn("got", F.coalesce(word_in(F.col("text"), F.col("term")), F.lit(False))).collect():
        assert r.got == r.want, r
    key = spark.createDataFrame([("急性前壁ST段抬高型心肌梗死",), ("STEMI",), ("急性前壁心梗",), ("心梗",)], "term string")
    said = spark.createDataFrame([(1, "你的诊断是 STEMI。"), (2, "我觉得可能是急性前壁心梗。"), (3, "我就是胸口一直疼。")], "id int, text string")
    assert {r.id: r.leak for r in terms.longest_terms(said, key, ["id"]).collect()} == {1: "STEMI", 2: "急性前壁心梗"}


def test_presence_by_name_and_synonym(spark):
    cases = [("Beta Blocker given", "beta blocker", [], "exact"), ("beta-blocker given", "Beta Blocker", [], "normalized"), ("aspirin 100mg", "ASA", ["Aspirin", None], "synonym"), ("rest", "ASA", ["aspirin"], "not_found"), ("", "ASA", [], "no_content"), ("x", None, None, "no_content"), ("(a) b", "(A)b", None, "normalized")]
    frame = spark.createDataFrame([(*c[:3], c[3]) for c in cases], "text string, term string, names array<string>, want string")
    for r in frame.withColumn("got", terms.term_method(F.col("text"), F.col("term"), F.col("names"))).collect():
        assert r.got == r.want, r


def test_quotes_are_whole_items(spark):
    docs = spark.createDataFrame([(1, "x one two  three four five six y"), (2, "one two three four five seven"), (3, "a b"), (4, None), (5, "xa b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "a b"), (3, "b"), (4, ""), (5, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in terms.quotes(docs, items).collect()) == [(1, 1), (3, 2), (3, 3), (5, 3)]


def test_quotes_match_nested_loops(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "ab"]) for _ in range(n))
    docs, items = [(i, say(rng.randint(0, 40))) for i in range(60)], [(i, say(rng.randint(1, 9))) for i in range(40)]
    found = terms.quotes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted((d, i) for d, x in docs for i, y in items if f" {y} " in f" {x} ")


def test_cyclic_nodes_match_closure(spark):
    rng = random.Random(6)
    for n, k in ((12, 14), (30, 33), (8, 30), (5, 0)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(k)}
        reach = set(edges)
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
            if more == reach:
                break
            reach = more
        got = {r.node for r in graph.cyclic_nodes(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
        assert got == {a for a, b in reach if a == b}


def test_tree_walk_has_no_depth_limit_and_ends_on_cycles(spark):
    chain = [(i, i - 1 if i else None, str(i)) for i in range(40)] + [(100, 101, "x"), (101, 100, "y")]
    nodes = spark.createDataFrame(chain, "id long, parent long, name string")
    assert max(r.depth for r in graph.tree_walk(nodes, "parent is null").collect()) == 39
    assert sorted(r.path for r in graph.tree_walk(nodes, "id = 100").collect()) == ["x", "x > y"]
