import random
import re

import numpy as np
import pytest

from studyloom.llm.decontaminate import decontaminate, suffix_array
from tests.llm.conftest import corpus

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        ws, hit, found, longest = lower(t), set(), set(), 0
        for item, text in items:
            iw = lower(text)
            k = min(window, len(iw))
            if not k:
                continue
            wins = {tuple(iw[a : a + k]) for a in range(len(iw) - k + 1)}
            for a in range(len(ws) - k + 1):
                if tuple(ws[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    found.add(None if item is None else str(item))
            for a in range(len(ws)):
                for b in range(len(iw)):
                    n = 0
                    while a + n < len(ws) and b + n < len(iw) and ws[a + n] == iw[b + n]:
                        n += 1
                    if n >= k:
                        longest = max(longest, n)
        out.append((i, len(ws), len(hit), sorted(found, key=lambda x: (x is None, x or "")), bool(hit), longest))
    return out


@pytest.mark.parametrize("depth", [1, 3, 7, 40])
def test_suffix_array_is_sorted(depth):
    rng = random.Random(depth)
    codes = np.array([0 if rng.random() < 0.03 else 2 * rng.randint(1, 4) for _ in range(800)] + [0])

    def key(i):
        out = []
        while i < len(codes) and codes[i] and len(out) < depth:
            out.append(codes[i])
            i += 1
        return out

    sa = suffix_array(codes, depth)
    assert sorted(sa) == list(range(len(codes)))
    keys = [key(i) for i in sa]
    assert keys == sorted(keys)


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_matches_brute_force(spark, limit):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in corpus(6, 50)]
    vocab = sorted({w for _, t in rows for w in (t or "").split()})
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(11, 30)))) for k in range(12)]
    items += [(100, "Two Words"), (101, None), (102, "..."), (None, "never mind this item at all please ok"), (9, vocab[3])]
    for k in range(0, 50, 4):
        words = items[k % 12][1].split()
        cut = rng.randint(0, 4)
        rows[k] = (rows[k][0], f"{rows[k][1] or ''} {' '.join(words[cut : cut + rng.randint(8, 20)]).upper()}, two words! {' '.join(words)}")
    seen = {}
    for i, t in items:
        if i is not None and t is not None:
            seen[i] = min(seen.get(i, t), t)
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items, r.contaminated, r.longest_words) for r in got) == sorted(brute(rows, list(seen.items())))


def test_edges(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate(no_docs, some).collect() == []
    rows = [(1, None), (1, None), (None, "x one two three y"), (2, "word " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as N_HIT", "8 as hit_words", "9 as item_id")
    assert [r.contaminated for r in decontaminate(docs, none).collect()] == [False] * 4
    got = decontaminate(docs, some).collect()
    assert sorted(str(r.doc_id) for r in got if r.contaminated) == ["None"] and all(r.item_id == 9 for r in got)


def test_a_head_shared_by_many_items(spark):
    """Items and occurrences of one window are not multiplied: 20,000 by 20,000 of them in a few documents."""
    head = "please answer the following question as well as you can"
    items = [(k, f"{head} item{k} ends") for k in range(20_000)]
    docs = [(d, " ".join(f"{head} x{d}" for _ in range(4000))) for d in range(5)] + [(9, f"so {head} item77 ends here")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in got.selectExpr("doc_id", "n_hit", "size(hit_items) as n", "longest_words", "longest_at", "longest_item").collect()}
    assert all((rows[d].n_hit, rows[d].n, rows[d].longest_words, rows[d].longest_at, rows[d].longest_item) == (40_000, 20_000, 10, 0, "0") for d in range(5))
    assert (rows[9].n_hit, rows[9].n, rows[9].longest_words, rows[9].longest_at, rows[9].longest_item) == (12, 20_000, 12, 1, "77")


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_longest_match_and_its_place(spark, limit):
    items = [(1, "a b c d e f g h i j k l"), (2, "z a b c d e f g h i j q"), (3, "c d"), (4, "b c d e f g h i j k")]
    docs = [(1, "x a b c d e f g h i j k y"), (2, "c d and c d"), (3, "z a b c d e f g h i j k l"), (4, "nothing")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit=limit).collect()
    best = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in got}
    assert best == {1: (11, 1, "1"), 2: (2, 0, "3"), 3: (12, 1, "1"), 4: (0, -1, None)}


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "one two", "p", "q", "r", 5)], "doc_id long, text string, __row string, __n string, hit_words string, Longest_At int")
    got = decontaminate(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "__row", "__n", "hit_words", "n_words", "n_hit", "hit_items", "longest_words", "longest_at", "longest_item", "contaminated"]
    r = got.first()
    assert (r["__row"], r["__n"], r.hit_words, r.n_hit, r.longest_at) == ("p", "q", "r", 2, 0)
