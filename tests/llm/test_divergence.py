import re
from collections import Counter, defaultdict

import duckdb
import pytest

from studyloom.llm import divergence as D

LETTERS = str.maketrans(D.UPPER, D.LOWER)


def brute(rows, min_docs, top=D.TOP):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, term by term."""
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(D.TERM, (text or "").translate(LETTERS))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        of = {s: counts[lang, s] for ln, s in groups if ln == lang}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + D.SCALE * (c[t] + D.ALPHA) // (total + D.ALPHA * len(kept)) for t in kept}

        shares, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(sum(abs(p[t] - r[t]) for t in kept), x) for x, r in shares.items() if x != s]
            terms = [(p[t] - q[t], t) for t in kept if of[s][t] and p[t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 3, 10_000])
def test_matches_brute_force(spark, docs, min_docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()] + [("Élan élan ABC abc a1b", "fr", "s"), ("abc 数据 \U0001f600x", "fr", None), (None, None, "s"), ("", "fr", "empty"), ("ABC", "fr", "s")]
    frame = spark.createDataFrame(rows * 2, "text string, lang string, source string")
    got = sorted(tuple(r) for r in D.divergence(frame, min_docs=min_docs).collect())
    assert got == brute(rows * 2, min_docs)
    assert {r[2] for r in got} == ({"pair", "term"} if min_docs < 100 else {"pair"})


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in D.op11_source_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got and got == sorted(con.execute(f"select lang, source, part, item, value, rank from ({D.SQL})").fetchall())


def test_small_pieces_and_shards_change_nothing(spark, docs, monkeypatch):
    whole = sorted(map(tuple, D.divergence(docs, min_docs=2).collect()))
    monkeypatch.setattr(D, "PIECE", 1)
    monkeypatch.setattr(D, "SHARD_ROWS", 7)
    assert sorted(map(tuple, D.divergence(docs, min_docs=2).collect())) == whole


def test_empty_and_clashing(spark, no_docs):
    assert D.divergence(no_docs).collect() == []
    odd = spark.createDataFrame([("a b", "en", "x", 1, "t"), ("b", "en", "y", 2, "u")], "text string, lang string, source string, n int, term string")
    assert len(D.divergence(odd, min_docs=1).collect()) == 2 + 1 + 1


def test_long_text_and_many_copies(spark):
    rows = [("word " * 400_000, "en", "a")] + [("word other", "en", "b")] * 3000
    got = {(r.source, r.part, r["item"]): r.value for r in D.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=30).collect()}
    assert got["a", "pair", "b"] == got["b", "pair", "a"] == brute(rows, 30)[0][4]
