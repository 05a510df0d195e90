"""Lines without spaces are compared by the shingles at every character."""

import random

from studyloom.llm.line_dedup import DEN, NUM, SHINGLE, line_dedup


def shingles(line):
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def test_a_character_put_in_or_left_out(spark):
    rng = random.Random(8)
    csv = ",".join(str(rng.randrange(10**6)) for _ in range(60))
    url = "http://example.org/" + "/".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(25))
    khmer = "".join(chr(rng.randrange(0x1780, 0x17B3)) for _ in range(300))
    code = "".join(rng.choice("abcdefXYZ0123456789_+=") for _ in range(400))
    pairs = [(csv, "7" + csv), (url, url.replace("http", "https")), (khmer, khmer[:5] + khmer[6:]), (code, code[:30] + code[31:])]
    for x, y in pairs:
        a, b = shingles(x.lower()), shingles(y.lower())
        assert DEN * len(a & b) >= NUM * len(a | b)
    rows = [(10 * k + side, line) for k, pair in enumerate(pairs) for side, line in enumerate(pair)]
    got = {r.doc_id: r.n_removed_lines for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 10 for i, _ in rows}
