"""Packed blocks: exact round trip, and sizes in proportion to their windows for any number of buckets."""

import numpy as np
import pyarrow as pa
import pytest

from studyloom.llm.kernels import bucket_of, by_range, pack, unpack


def windows(rng, docs=600, per=500):
    row = np.repeat(np.arange(docs), per)
    pos = np.tile(np.arange(per), docs)
    return rng.integers(0, 2**63, docs * per).astype(np.uint64), row, pos, np.cumsum(rng.integers(1, 9, docs)), rng.integers(0, 1 << 16, docs)


@pytest.mark.parametrize("buckets", [1, 7, 5000])
def test_round_trip(buckets):
    hashes, row, pos, ids, extra = windows(np.random.default_rng(1), 40, 50)
    keys = np.arange(buckets) * 3
    got = unpack(pa.Table.from_batches([pack(bucket_of(hashes, keys), row, pos, ids, extra, hashes)]))
    back = sorted(zip(got[0].tolist(), got[3][got[1]].tolist(), got[4][got[1]].tolist(), got[2].tolist()))
    assert back == sorted(zip((hashes & np.uint64((1 << 56) - 1)).tolist(), ids[row].tolist(), extra[row].tolist(), pos.tolist()))


def test_bytes_a_window_are_bounded():
    hashes, row, pos, ids, extra = windows(np.random.default_rng(2))
    size = {n: pack(bucket_of(hashes, np.arange(n)), row, pos, ids, extra, hashes).nbytes / len(hashes) for n in (51, 1900, 20_000)}
    assert size[51] < 12 and size[1900] < 16 and size[20_000] < 40


def test_ranges_hold_every_window_once(monkeypatch):
    from studyloom.llm import kernels

    monkeypatch.setattr(kernels, "SORT_AT_ONCE", 100)
    hashes = np.random.default_rng(3).integers(0, 500, 1234).astype(np.uint64)
    parts = list(by_range(hashes))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1234)) and len(parts) > 5
    assert sum(len(set(hashes[p].tolist())) for p in parts) == len(set(hashes.tolist()))
    assert [len(p) for p in by_range(hashes[:0])] == [0]
