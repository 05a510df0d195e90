"""Ladders of names against nested loops over all of them."""

import random
import re
from difflib import SequenceMatcher

import pytest

from studyloom.operators import resolve
from studyloom.plans.catalog import QUERIES


def names(seed, n=90):
    rng = random.Random(seed)
    out = {"".join(rng.choice("abc肺 ") for _ in range(rng.randint(1, 14))) for _ in range(n)}
    for x in list(out)[: n // 2]:
        i = rng.randrange(len(x) + 1)
        out |= {x[:i] + "z" + x[i:], x[:i] + x[i + 1 :], x[i:] + x[:i], x.upper(), x + " " + x}
    return sorted(out)


@pytest.mark.parametrize("least", [0.6, 0.85, 0.97])
def test_similar_sequences_lose_nothing(spark, least):
    wanted, known = names(1), names(2) + ["x" * 250 + "y" * 30, ""]
    wanted += ["x" * 255 + "y" * 25, ""]
    got = {(r.name, r.target): r.ratio for r in resolve.similar_sequences(spark.createDataFrame([(x,) for x in wanted], "name string"), spark.createDataFrame([(x,) for x in known], "target string"), least).collect()}
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(wanted) for b in set(known) if a and b}
    assert got == {k: v for k, v in want.items() if v >= least} and got


def strict(x):
    return re.sub(r"\s+", "", x)


def key(x):
    return re.sub(r"^第[一二三四五六七八九十百千万零\d]+[章节篇]", "", re.sub(r"[（(].*?[)）]", "", strict(x))).lower()


def heading(name, aliases, known):
    """(target, rung) by walking through the known headings in order, rung by rung."""
    alike = {strict(a) for a in aliases or []}
    tests = [
        lambda t: strict(t) == strict(name) or strict(t) in alike,
        lambda t: key(t) and key(t) == key(name),
        lambda t: key(t) and key(name) and SequenceMatcher(None, key(name), key(t)).ratio() >= 0.85,
        lambda t: len(key(t)) >= 4 and len(key(name)) - len(key(t)) >= 4 and key(name).startswith(key(t)),
    ]
    for rung, test in enumerate(tests, 1):
        for t in known:
            if test(t):
                return t, rung
    return None, None


def test_headings_match_the_ladder(spark):
    known = names(3, 40) + ["第一章 heart failure", "Heart Failure (acute)", "chronic kidney", "(x)", "第二节", "aaaaaaaaaaaaaaaa"]
    wanted = [(x, ["zz"]) for x in names(4, 60)] + [("heart failure", None), ("HEART  FAILURES", []), ("heart failures of children", []), ("other", ["chronic  kidney"]), ("", None), ("(y)", None), ("第三章heartfailure（b）", None), ("chronic kidneys", [None]), ("kidney", ["x"])]
    w = spark.createDataFrame(wanted, "name string, aliases array<string>")
    k = spark.createDataFrame([(t, i) for i, t in enumerate(known)], "target string, pos int")
    got = {r.name: (r.target, r.rung) for r in resolve.match_headings(w, k).collect()}
    want = {n: heading(n, [a for a in al or [] if a is not None], known) for n, al in wanted}
    assert got == want and {r for _, r in got.values()} == {1, 2, 3, 4, None}


def test_heading_query_matches_nested_loops(spark):
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    first = {}
    for p in sorted(parts, key=lambda p: p.p_partkey):
        first.setdefault(p.p_name, p.p_partkey)
    known = sorted(first, key=first.get)
    got = QUERIES["heading_ladder"](spark, sf).collect()
    # the alias of a form stands for no part, so it can be left out here
    assert all((r.target, r.rung) == heading(r.name, [], known) for r in got) and {r.how for r in got} >= {"strict", "fuzzy", "hierarchical"}


def relation_key(x):
    return re.sub(r"\s+", "", re.sub(r"[（(].*?[）)]", "", x.lower().strip()))


def resolved(source, target, points, strict_keys):
    """(resolved, method, confidence, candidates) by a walk over all points."""
    found = []
    for i, title, aliases in points:
        if i == source:
            continue
        title = title or ""
        same_key = relation_key(target) != "" and relation_key(title) == relation_key(target)
        if title == target or (same_key and not strict_keys):
            found.append((1, i, "exact_title", 0.98))
        elif relation_key(target) and any(a is not None and relation_key(a) == relation_key(target) for a in aliases or []):
            found.append((2, i, "alias", 0.92))
        elif same_key:
            found.append((3, i, "normalized", 0.85))
    if not found and len(relation_key(target)) > 3:
        found = [(4, i, "fuzzy", 0.65) for i, title, _ in points if i != source and len(title or "") > 3 and relation_key(target) in relation_key(title)]
    found.sort()
    best = found[0] if found else (9, None, "unresolved", 0.0)
    return best[1] if best[3] >= 0.85 else None, best[2], best[3], best[3] < 0.85, sum(f[0] == best[0] for f in found) > 1, [f[1:] for f in found]


@pytest.mark.parametrize("strict_keys", [False, True])
def test_relations_match_a_walk_over_all_points(spark, strict_keys):
    rng = random.Random(7)
    titles = names(5, 40) + ["Heart Failure", "heart failure (acute)", "Chronic heart failure", None, "", "(x)", "HeartFailure"]
    points = [(i, t, rng.choice([None, [], ["Hf", None], ["heart  failure"], [rng.choice(titles)]])) for i, t in enumerate(titles)]
    asked = [(rng.randrange(len(points)), t, "causes") for t in [*names(5, 40), *names(6, 40), "heart failure", "eart fail", "HF", "(y)", "(x)", "fail", "no such", ""]]
    asked += [(s, t, "treats") for s, t, _ in asked] + asked[:5] + [(None, "HF", "causes"), (1, None, "causes")]
    asked += [(i, t, "self") for i, t, _ in points if t]
    got = resolve.resolve_relations(spark.createDataFrame(asked, "source_id long, target_name string, relation_type string"), spark.createDataFrame(points, "id long, title string, aliases array<string>"), strict_keys).collect()
    rows = {(s, t, k) for s, t, k in asked if s is not None and t}
    assert len(got) == len(rows) and {(r.source_id, r.target_name, r.relation_type) for r in got} == rows
    methods = set()
    for r in got:
        want = resolved(r.source_id, r.target_name, points, strict_keys)
        assert (r.resolved_target_id, r.match_method, r.confidence, r.needs_review, r.ambiguous, [tuple(c) for c in r.candidates]) == want, r
        methods.add(r.match_method)
    assert methods == {"exact_title", "alias", "fuzzy", "unresolved"} | ({"normalized"} if strict_keys else set())


def test_no_points_and_no_relations(spark):
    empty = spark.createDataFrame([], "id long, title string, aliases array<string>")
    one = spark.createDataFrame([(1, "a", "b")], "source_id long, target_name string, relation_type string")
    assert [r.match_method for r in resolve.resolve_relations(one, empty).collect()] == ["unresolved"]
    assert resolve.resolve_relations(one.where("false"), empty).collect() == []
