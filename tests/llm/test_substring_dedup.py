import re

import pytest

from studyloom.llm import kernels
from studyloom.llm.substring_dedup import substring_dedup
from tests.llm.conftest import corpus


def brute(rows, width):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (i, t) in enumerate(rows)}
    least = {}
    for k, (i, _) in enumerate(rows):
        for at in range(len(words[k]) - width + 1) if i is not None else ():
            w = tuple(words[k][at : at + width])
            least[w] = min(least.get(w, i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for at in range(len(words[k]) - width + 1) if i is not None else ():
            if least[tuple(words[k][at : at + width])] < i:
                gone.update(range(at, at + width))
        out.append((i, len(words[k]), len(gone), " ".join(w for p, w in enumerate(words[k]) if p not in gone)))
    return out


@pytest.mark.parametrize("width", [5, 50])
@pytest.mark.parametrize("slice_bytes", [700, 2 << 20])
def test_matches_brute_force(spark, monkeypatch, width, slice_bytes):
    monkeypatch.setattr(kernels, "SLICE_BYTES", slice_bytes)
    rows = [(r[0], r[1]) for r in corpus(3, 120)] + [(None, "x y z " * 30), (3, "another text of an id that is there already " * 4)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute(rows, width), key=key)


def test_intervals_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"a {passage} b {passage}"), (3, "c " + passage[:100])]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].removed_starts, got[2].removed_ends, got[2].kept_text) == ([1, 62], [61, 122], "a b")
    assert got[1].n_removed == got[3].n_removed == 0


def test_edges(spark, no_docs):
    assert substring_dedup(no_docs).collect() == []
    long = " ".join(str(i) for i in range(100_000))
    rows = [(1, long, 5), (2, long, 6), (2, long, 6), (3, None, 7), (4, "", 8)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, N_Words int").selectExpr("*", "1 as id", "2 as tag", "3 as starts")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 100_000, 0), (2, 100_000, 100_000), (2, 100_000, 100_000), (3, 0, 0), (4, 0, 0)]
    assert all((r.id, r.tag, r.starts) == (1, 2, 3) for r in got)
