import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from studyloom.llm import fill_in_middle as M


def brute(i, text, unit=M.UNIT):
    text = text or ""
    units = re.findall(unit, text)
    n = len(units)
    h = hashlib.sha256(f"{M.SEED}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if "".join(units) != text:
        return None, "plain", None, None, text
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(frame, **options):
    out = M.fill_in_middle(frame, **options)
    rows = out.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    forms = set()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, options.get("unit", M.UNIT)), r.doc_id
        assert r.back == (r.text or "")
        forms.add(r.form)
    assert len(rows) == frame.count()
    return forms


def test_matches_brute_force(docs):
    assert check(docs) == {"plain", "psm", "spm"}


def test_odd_texts(spark):
    texts = ["\U0001f600" * 3000 + "é\n\r x", "\n" * 2048, "a<P>b", "<S", "<" * 1025 + "S>", "M><P" * 700, "x" * 1024, "y" * 1023, "P>", None, "", "ab" * 5000, "<M", "\x00\x01"]
    rows = [(i, t) for i, t in enumerate(texts * 20)] + [(None, "null id"), (3, "same id"), (3, "same id")]
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 7])
def test_any_block_size(docs, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    check(docs.where("length(text) < 600 or text is null"))


def test_words_as_units(docs):
    assert "psm" in check(docs, unit=r"[^ ]+ *| +")
    assert check(docs.where("text like '% %'"), unit=r"[^ ]+") == {"plain"}


def test_long_text(spark):
    text = "é\U0001f600z" * 700_000
    frame = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    out = M.fill_in_middle(frame).select("doc_id", "n", F.sha2(M.restored(F.col("output"), F.col("form")), 256).alias("h")).collect()
    assert [(r.n, r.h) for r in out] == [(2_100_000, hashlib.sha256(text.encode()).hexdigest())] * 3


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = M.op13_fill_in_middle(spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select {', '.join(columns)} from ({M.SQL})").fetchall())


def test_native_empty_and_clashing(spark, no_docs):
    assert M.fill_in_middle(no_docs).collect() == []
    odd = spark.createDataFrame([(1, "abc", "keep", 5, "z", "w")], "doc_id long, text string, __sha string, N int, output string, ___a string")
    got = M.fill_in_middle(odd)
    assert got.columns == ["doc_id", "text", "__sha", "___a", "n", "form", "prefix_chars", "middle_chars", "output"]
    r = got.first()
    assert (r["__sha"], r["___a"], r.n) == ("keep", "w", 3) and r.output == brute(1, "abc")[4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
