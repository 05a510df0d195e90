"""Work that a line does not need is not done: no walk from the right where no blank ends it, no look at sketches of unlike fullness."""

from pyspark.sql import functions as F

from studyloom.llm import line_dedup
from studyloom.llm.line_dedup import DEN, NUM, _able, _trimmed, sketches

BLANKS = " \t\r\f\v "


def test_trimmed_lines(spark):
    rows = ["", " ", "\t\r\f\v ", "a", " a", "a ", "\t a b\r", "a ", " \t", "é \x0b\x0c", "a\x1c ", "日本 \t語\t \r", "x" * 300 + " \t" * 50]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, line string").select("i", _trimmed(F.col("line")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: x.strip(BLANKS) for i, x in enumerate(rows)}


def test_a_key_is_made_once(spark):
    """Blank lines are filtered without their keys, so lower() stands in the plan for the key alone."""
    docs = spark.createDataFrame([(1, "a line\n \t\nAnother ")], "doc_id long, text string")
    lines = line_dedup.lines_of(docs, "doc_id", "text")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert sorted((r.no, r.key) for r in lines.collect()) == [(0, "a line"), (2, "another")]


def test_sketches_of_unlike_fullness_are_no_links(spark):
    """The bits are compared first, by number, and the answer is that of the words alone."""
    lines = [("abcdefgh" * 9)[:k] + "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(n)) for k in (0, 40) for n in (60, 64, 70, 120, 400)]
    keys = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "h long, key string")
    marks = sketches(keys).collect()
    sides = [spark.createDataFrame(marks, "h long, size long, ones long, words array<long>").select(*(F.col(c).alias(k + c) for c in ("h", "size", "ones", "words"))) for k in ("x_", "y_")]
    got = {(r.x_h, r.y_h): r.able for r in sides[0].crossJoin(sides[1]).select("x_h", "y_h", _able("x_", "y_", NUM, DEN).alias("able")).collect()}
    bits = {r.h: {64 * j + b for j, w in enumerate(r.words) for b in range(64) if w >> b & 1} for r in marks}
    size = {r.h: r.size for r in marks}
    assert {r.h: r.ones for r in marks} == {h: len(x) for h, x in bits.items()}
    assert got == {(x, y): (DEN + NUM) * len(bits[x] ^ bits[y]) <= (DEN - NUM) * (size[x] + size[y]) for x in bits for y in bits}
    assert any(got.values()) and not all(got.values())
