import random
import re

import pytest

from studyloom.llm import kernels
from studyloom.llm.jaccard_join import jaccard_join, keep_one
from tests.llm.conftest import corpus


def sets_of(rows, width):
    out = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    return out


def brute(rows, width, num, den):
    sets, root = sets_of(rows, width), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if r not in least or (i is not None and (least[r] is None or i < least[r])) else least[r]
    return sorted((str(i), len(sets[k]), str(least[find(k)])) for k, (i, _) in enumerate(rows))


def chained(seed, n=90):
    """Near copies of near copies: long chains, whose ends are far apart, and groups near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    bases = [[word() for _ in range(rng.randint(60, 120))] for _ in range(4)]
    rows = []
    for i in range(n):
        base = rng.choice(bases)
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.4:
            bases[bases.index(base)] = text  # the group drifts
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in corpus(9, 150)], chained(1), chained(2)], ids=["mixed", "chain1", "chain2"])
def test_matches_brute_force(spark, monkeypatch, rows, width, num):
    monkeypatch.setattr(kernels, "SLICE_BYTES", 4000)
    rows = [*rows, (None, rows[0][1]), (None, "alone here"), (None, None), (None, None)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=width, num=num).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, num, 100)


def test_keep_one(spark, no_docs):
    assert keep_one(no_docs).collect() == [] and keep_one(no_docs).columns == no_docs.columns
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text, "a"), (1, text + "!", "b"), (1, text + "!", "b"), (3, text.upper(), "c"), (4, "", "d"), (5, None, "e"), (6, "other words", "f")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string"), num=60).collect()
    assert sorted((r.doc_id, r.key) for r in got) == [(1, "b"), (4, "d"), (5, "e"), (6, "f")]
