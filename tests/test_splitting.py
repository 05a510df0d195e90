"""Texts split within a budget."""

import random
import re

from pyspark.sql import functions as F

from studyloom.functions.columns import by_paragraph, overlapping
from studyloom.operators import texts


def arrays(spark, rows, expression):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, u array<string>")
    return [r.out for r in frame.withColumn("out", expression(F.col("u"))).orderBy("i").collect()]


def test_overlapping_units(spark):
    assert arrays(spark, [["aaaa", "bbbb", "ccc"], ["x" * 25, "y"], ["abc"], [], None, ["aaaaa", "bbbbbbbbb"]], lambda u: overlapping(u, 10, 3)) == [
        ["aaaabbbb", "bbbccc"], ["x" * 10, "x" * 10, "x" * 10, "x" * 4, "y"], ["abc"], [], None, ["aaaaa", "bbbbbbbbb"],
    ]


def test_overlapping_chunks_hold_all_text(spark):
    rng = random.Random(4)
    items = ["".join(rng.choice(["字" * rng.randint(1, 90), "。", "！", "\n", " ", "\t", "w" * rng.randint(1, 300)]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, " ", "x" * 5000]
    got = {}
    for r in texts.overlapping_chunks(spark.createDataFrame(list(enumerate(items)), "doc_id int, text string"), most=200, overlap=20).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, text in enumerate(items):
        units = [u.strip() for u in re.split(r"(?<=[。！？；\n])", re.sub(r"[ \t]+", " ", text or "").strip()) if u.strip()]
        assert bool(units) == (i in got) and all(len(c) <= 200 for c in got.get(i, []))
        joined = "\0".join(got.get(i, []))
        assert all(u in joined for u in units if len(u) <= 200), i


def test_paragraphs(spark):
    long = "p" * 25
    frame = spark.createDataFrame([(0, "short\n\ntext"), (1, f"one\n\ntwo\n \n{long}\n\nthree\n\nfour\n\nfive"), (2, "\n\n".join(["abcd"] * 5))], "i int, t string")
    got = [r.x for r in frame.withColumn("x", by_paragraph(F.col("t"), 12)).orderBy("i").collect()]
    assert got == [["short\n\ntext"], ["one\n\ntwo", "p" * 12, "p" * 12, "p", "three\n\nfour", "five"], ["abcd\n\nabcd", "abcd\n\nabcd", "abcd"]]


def test_markdown_pieces(spark):
    text = "intro " * 10 + "\n# A\n" + "\n\n".join("para " + "x" * 45 for _ in range(4)) + "\n## B\nshort\n## C\n" + "c" * 60
    rows = texts.markdown_pieces(spark.createDataFrame([(1, text), (2, None)], "i int, t string"), "i", "t", 120).orderBy("section_no", "piece_no").collect()
    assert [(r.section_no, r.piece_no, r.h1, r.h2, len(r.body)) for r in rows] == [(0, 0, None, None, 59), (1, 0, "A", None, 102), (1, 1, "A", None, 102), (3, 0, "A", "C", 60)]
