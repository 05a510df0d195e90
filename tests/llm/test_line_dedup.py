import random

import pytest

from studyloom.llm.line_dedup import DEN, NUM, SHINGLE, _planes, components_of, line_dedup, lines_of
from tests.llm.conftest import corpus

BLANKS = " \t\r\f\v "


def shingles(line):
    key = line.strip(BLANKS).lower()
    return frozenset(key[i : i + SHINGLE] for i in range(max(1, len(key) - SHINGLE + 1)))


def brute(rows):
    """The texts left when all pairs of lines are compared; rows of (id, text)."""
    keys = {}
    for i, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if i is not None and line.strip(BLANKS):
                keys.setdefault(line.strip(BLANKS).lower(), []).append((i, no, text))
    sets = {k: shingles(k) for k in keys}
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(keys)
    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if DEN * len(x & y) >= NUM * len(x | y):
                root[find(names[a])] = find(names[b])
    keep = {}
    for k, places in keys.items():
        keep[find(k)] = min([keep.get(find(k), (1e9,)), *places], key=lambda p: p[:2])
    out = []
    for i, text in rows:
        if text is None or i is None:
            out.append((i, text))
            continue
        lines = [x for no, x in enumerate(text.split("\n")) if not x.strip(BLANKS) or keep[find(x.strip(BLANKS).lower())] == (i, no, text)]
        out.append((i, "\n".join(lines)))
    return out


def test_planes_meet_once():
    planes = _planes()
    assert len(planes) == 12 and all(len(set(p)) == 3 for p in planes)
    assert {x for p in planes for x in p} == set(range(9))
    assert all(len(set(p) & set(q)) <= 1 for i, p in enumerate(planes) for q in planes[:i])


def near(seed):
    """Lines with groups of near copies: one base line of 40 words with a word or two changed."""
    rng = random.Random(seed)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(3):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["changed", "x", "other words"])
            lines.append(rng.choice(["", "  "]) + " ".join(words) + rng.choice(["", " \r"]))
        rows.append((i, "\n".join(lines)))
    return rows


def dedup(spark, rows):
    return line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_matches_brute_force(spark):
    rows = [(r[0], r[1]) for r in corpus(2, 80)]
    assert sorted((r.doc_id, r.text) for r in dedup(spark, rows) if r.text is not None) == sorted(x for x in brute(rows) if x[1] is not None)


def test_near_copies_match_brute_force(spark):
    """Of 120 lines at most 3 are missed, and none goes that the brute force keeps."""
    rows = near(5)
    got, want = {r.doc_id: r.text.split("\n") for r in dedup(spark, rows)}, {i: t.split("\n") for i, t in brute(rows)}
    assert all(set(want[i]) - {""} <= set(got[i]) for i in want)
    assert sum(len(set(got[i]) - set(want[i]) - {""}) for i in want) <= 3


def test_edges(spark, no_docs):
    assert line_dedup(no_docs).collect() == []
    rows = [(1, "same line here\n\nother"), (1, "same line here\n\nother"), (5, "SAME LINE HERE "), (None, "same line here"), (2, None), (3, ""), (4, "同じ行です\n同じ行です\n違う文です"), (6, "a  long" + "xyz" * 30 + "  word\n\u00a0\t")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as N_lines", "'k' as h", "'q' as key")).collect()
    texts = sorted(str(r.text) for r in got)
    assert texts == sorted(["same line here\n\nother", "same line here\n\nother", "", "same line here", "None", "", "同じ行です\n違う文です", "a  long" + "xyz" * 30 + "  word\n\u00a0\t"])
    assert all(r.h == "k" and r.key == "q" for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_whole_tables(spark, sf):
    """Of the line pairs of similarity 0.8 or more, found by a plain index of shingles, 0.98 are in one component at least."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    keys = sorted({line.strip(BLANKS).lower() for r in docs.collect() for line in (r.text or "").split("\n")} - {""})
    sets = [shingles(k) for k in keys]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):  # links share one of any len(s) / 5 + 1 shingles, the rarest here
        rare = sorted(s, key=lambda x: len(where[x]))[: len(s) - -(-NUM * len(s) // DEN) + 1]
        links |= {(min(i, j), max(i, j)) for x in rare for j in where[x] if i != j and DEN * len(s & sets[j]) >= NUM * len(s | sets[j])}
    one_each = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "doc_id long, text string")
    lines = lines_of(one_each, "doc_id", "text")
    number = {r.h: r.id for r in lines.select("h", "id").collect()}
    roots = {number[r.node]: r.root for r in components_of(lines).collect()}
    met = sum(roots.get(i) is not None and roots.get(i) == roots.get(j) for i, j in links)
    assert len(links) > 20 and met >= 0.98 * len(links)
    by_root = {}
    for i, r in roots.items():
        by_root.setdefault(r, []).append(i)
    linked = {i for pair in links for i in pair}
    assert all(i in linked for group in by_root.values() if len(group) > 1 for i in group)  # no line without a link is in one
