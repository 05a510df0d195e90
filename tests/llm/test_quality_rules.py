import re
from collections import Counter

import zstandard

from studyloom.llm.quality_rules import BANDS, CHUNK, CHUNK_BAND, CHUNK_SHARE, quality_rules


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    rep = {j for i in range(len(ws) - 4) if wins[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(ws) < 10 or 100 * len(rep) > 20 * len(ws)
    raw = text.encode()
    size = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    ok = not failed
    for least, low, high in reversed(BANDS):
        if len(raw) >= least:
            ok &= low <= size(raw) <= high
            break
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw) // CHUNK * CHUNK, CHUNK)]
    if chunks and sum(not CHUNK_BAND[0] <= size(c) <= CHUNK_BAND[1] for c in chunks) / len(chunks) >= CHUNK_SHARE:
        ok = False
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(rep), failed, ok


def test_matches_brute_force(docs):
    rows = quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(r.text), r.doc_id


def test_matches_brute_force_on_table(spark):
    rows = quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(r.text), r.doc_id
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_noise_and_repetition_are_rejected(spark):
    import base64
    import random

    rng = random.Random(3)
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(400))
    pattern = " ".join(f"row {i % 7} of" for i in range(3000))
    rows = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, noise), (2, pattern)], "doc_id long, text string")).collect()}
    assert rows[1].verdict == "incompressible" and not rows[2].kept


def test_empty_and_clashing(spark, no_docs):
    assert quality_rules(no_docs).collect() == []
    got = quality_rules(spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, N_WORDS int, kept string")).collect()
    assert got[0].n_words == 2 and got[0].kept is False
