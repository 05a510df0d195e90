from fractions import Fraction

import pytest

from studyloom.llm.source_mix import mix_sources, one_period, shares


@pytest.mark.parametrize("share", [{"a": 1}, {"a": 3, "b": 2, "c": 5}, {"a": 500, "b": 499, "c": 1}, {None: 7, "x": 13, "y": 80}])
def test_every_prefix_is_within_one_block(share):
    period, done = sum(share.values()), dict.fromkeys(share, 0)
    plan = one_period(share)
    assert [p[0] for p in plan] == list(range(period))
    for slot, s, j, release, deadline in plan:
        assert release <= slot < deadline
        done[s] += 1
        assert done[s] == j
        for z, w in share.items():
            assert abs(Fraction(w * (slot + 1), period) - done[z]) < 1


def test_shares_add_up():
    got = shares({"big": 10**9, "mid": 10**6, "tiny": 1}, 1000)
    assert sum(got.values()) == 1000 and min(got.values()) >= 1 and got["big"] > got["mid"] > got["tiny"]
    assert shares({"a": 5, "b": 7}, 10, weights={"a": 1, "b": 1}) == {"a": 5, "b": 5}
    with pytest.raises(ValueError):
        shares({"a": 1, "b": 1}, 10, weights={"a": 0, "b": 1})


def brute(rows, share, block):
    """Place blocks slot by slot over the whole table, earliest deadline first."""
    period, at, blocks = sum(share.values()), {}, {}
    for s, h, i, size in sorted(rows, key=lambda r: r[1]):
        blocks[i] = (s, at.get(s, 0) // block + 1)
        at[s] = at.get(s, 0) + size
    need = {s: max(b for z, b in blocks.values() if z == s) for s in share}
    slots, done, slot = {}, dict.fromkeys(share, 0), 0
    while any(done[s] < need[s] for s in share):  # a source that ended still takes its slots
        ready = [(-(-(done[s] + 1) * period // w), -w, s is not None, str(s), s) for s, w in share.items() if done[s] * period // w <= slot]
        s = min(ready)[-1]
        done[s] += 1
        slots[s, done[s]] = slot
        slot += 1
    return {i: slots[x] for i, x in blocks.items()}


def test_matches_slot_by_slot_schedule(spark, docs):
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in mix_sources(docs, block_chars=300, period=10).collect()}
    assert len(got) == docs.count()
    hashed = docs.select("source", F.xxhash64(F.lit(17), "doc_id", "text"), "doc_id", F.coalesce(F.length("text"), F.lit(0))).collect()
    sizes = {}
    for r in hashed:
        sizes[r[0]] = sizes.get(r[0], 0) + r[3]
    order = [(r[0], (r[1] & (2**64 - 1)) >> 1, r[2], r[3]) for r in hashed]
    share = shares(sizes, 12)
    assert sum(share.values()) == 12
    assert {i: r.slot for i, r in got.items()} == brute([(s, h, i, c) for s, h, i, c in order], share, 300)
    for r in got.values():
        assert r.release <= r.slot < r.deadline


def test_edges(spark, no_docs):
    assert mix_sources(no_docs).collect() == []
    rows = [(1, None, None), (None, "abc", "x"), (1, "abc", "x"), (1, "abc", "x"), (2, "z" * 50_000, "x"), (3, "", None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as BLOCK", "2 as s", "3 as h")).collect()
    assert len(got) == len(rows)


def test_missing_weights_and_long_documents(spark):
    rows = [(0, "x" * 95, "a"), (1, "y" * 10, "a"), (2, "z" * 10, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="no weight for 1 sources"):
        mix_sources(docs, weights={"a": 1.0})
    got = {r.doc_id: r for r in mix_sources(docs, weights={"a": 1.0, "b": 1.0}, block_chars=10).collect()}
    assert got[2].block == 1 and {got[0].block, got[1].block} in ({1, 2}, {1, 10})  # blocks 2 to 9 are empty if the long one is first
