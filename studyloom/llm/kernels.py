"""Vectorised text kernels used inside Arrow tasks: words, hashes and packed hash blocks.

Everything works on the UTF-8 buffers of Arrow string columns, so no Python string is made per
word. Word hashes are polynomial hashes over the bytes and window hashes are Rabin-Karp hashes
over the word hashes, both modulo 2**64 and computed with prefix sums:
``H(i, j) = (P[j] - P[i]) * B**-i`` where ``P`` is the running sum of ``x[k] * B**k``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that a kernel call works on at once (a longer document is one call of its own).
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**0..B**n and their inverses modulo 2**64."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, (SLICE_BYTES >> which) + 2)  # a slice has half as many words as bytes at most
        base = _BASES[which] | 1
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        got = (out[0], out[1])
        if n <= 4 * SLICE_BYTES:  # the powers of a huge document are not kept
            _POWERS[which] = got
    return got


def byte_table(lower: bool = False) -> np.ndarray:
    """A 64-bit value per byte; with ``lower`` A-Z have the values of a-z."""
    table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        table[65:91] = table[97:123]
    return table


def _lut(low_high: list[tuple[int, int]]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in low_high:
        lut[a : b + 1] = True
    return lut


#: Bytes of words: all but the space and the control characters 9-13.
NON_SPACE = ~_lut([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words: digits, letters and everything beyond ASCII.
ALNUM = _lut([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int | None = None):
    """Ranges of rows whose text has at most ``limit`` bytes (one row at least)."""
    limit = limit or SLICE_BYTES
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of member bytes inside one row) and each row's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # rows that have bytes
    first[edge] = inside[edge]
    stop = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stop] = inside[stop]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hashes(word_hash: np.ndarray, row_first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``width`` consecutive words of one row; (hashes, index of the first word)."""
    n = len(word_hash)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = _powers(n, 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(word_hash * power[:n], out=sums[1:])
    ok = np.ones(n - width + 1, bool)
    for shift in row_first[1:-1][np.diff(row_first[1:]) > 0] if width > 1 else ():  # starts too near a row's end
        ok[max(0, shift - width + 1) : shift] = False
    at = np.flatnonzero(ok)
    return mix((sums[at + width] - sums[at]) * inverse[at]), at


def row_of(at: np.ndarray, row_first: np.ndarray) -> np.ndarray:
    """The row to which each word index belongs."""
    return np.searchsorted(row_first, at, "right") - 1


# --- packed hash blocks -----------------------------------------------------------------------
# A shuffle of one row per window would carry tens of bytes for each. A block holds the windows of
# one slice of documents that fall into one bucket: 7 bytes of hash each, and compressed together their
# positions and the documents that have windows in the block, so that its size is in proportion to its
# windows, however many buckets there are.

BLOCK = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("hashes", pa.binary()), ("rest", pa.binary())])
BLOCK_DDL = "bucket int, n int, d int, hashes binary, rest binary"
#: Windows that are sorted at once where a bucket's blocks meet.
SORT_AT_ONCE = 1 << 18


def _planes(x: np.ndarray) -> bytes:
    """The bytes of ``x`` by significance, which compress better."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def _from_planes(raw: memoryview, at: int, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(dtype)


@cache
def _zstd() -> tuple:
    """One compressor and one decompressor a worker; making one costs more than a small block."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(*arrays: np.ndarray) -> bytes:
    return _zstd()[0].compress(b"".join(map(_planes, arrays)))


def _expand(raw: bytes, dtype) -> np.ndarray:
    got = _zstd()[1].decompress(raw)
    return _from_planes(got, 0, len(got) // np.dtype(dtype).itemsize, dtype)


def pack(bucket: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, extra: np.ndarray, hashes: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Blocks, one for each value of ``bucket``, of windows at ``pos`` of document ``row``; ids, extra: int64 by row.

    Windows come by ascending row and position."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket, row, pos = bucket[order], row[order], pos[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    doc_at = np.flatnonzero(fresh)
    doc_ids, doc_extra, gaps = ids[row[doc_at]], extra[row[doc_at]], np.diff(pos, prepend=0)
    gaps[doc_at] = pos[doc_at]
    counts = np.diff(np.append(doc_at, len(row))).astype(np.int32)
    doc_edges = np.searchsorted(doc_at, edges)
    gaps = gaps.astype(np.int32)
    seven = None if hashes is None else np.ascontiguousarray(hashes[order]).view(np.uint8).reshape(-1, 8)[:, :7]  # little-endian: the low 56 bits
    out: list[list] = [[], [], [], [], []]
    for a, b, i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), doc_edges[:-1].tolist(), doc_edges[1:].tolist(), strict=True):
        rest = _squeeze(gaps[a:b], counts[i:j], np.diff(doc_ids[i:j], prepend=0), doc_extra[i:j])
        for column, x in zip(out, (int(bucket[a]), b - a, j - i, b"" if seven is None else seven[a:b].tobytes(), rest), strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, BLOCK, strict=True)], schema=BLOCK)


def bucket_of(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The partition key of each hash's bucket."""
    return keys[((hashes >> U64(32)) % U64(len(keys))).astype(np.int64)]


def unpack(table: pa.Table, with_hashes: bool = True, with_pos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the blocks the 56-bit hash, the document's number and the position in it; by document id and extra."""
    n, d = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "d"))
    at, doc_at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(d)])
    hashes = np.zeros(at[-1] if with_hashes else 0, U64)
    doc, pos = np.empty(at[-1], np.int32), np.empty(at[-1] if with_pos else 0, np.int32)
    ids, extra = np.empty(doc_at[-1], np.int64), np.empty(doc_at[-1], np.int64)
    wide, inflate = hashes.view(np.uint8).reshape(-1, 8), _zstd()[1]
    seven, rests = table.column("hashes"), table.column("rest")
    for k in range(len(n)):
        w, m = slice(at[k], at[k + 1]), slice(doc_at[k], doc_at[k + 1])
        if with_hashes:
            wide[w, :7] = np.frombuffer(seven[k].as_buffer(), np.uint8).reshape(-1, 7)
        rest = inflate.decompress(rests[k].as_buffer())
        counts = _from_planes(rest, 4 * n[k], d[k], np.int32)
        doc[w] = np.repeat(np.arange(doc_at[k], doc_at[k + 1], dtype=np.int32), counts)
        if with_pos:
            gaps, head = _from_planes(rest, 0, n[k], np.int32), np.cumsum(counts) - counts
            sums = np.cumsum(gaps, dtype=np.int64)
            pos[w] = sums - np.repeat(sums[head] - gaps[head], counts)
        ids[m] = np.cumsum(_from_planes(rest, 4 * (n[k] + d[k]), d[k], np.int64))
        extra[m] = _from_planes(rest, 4 * (n[k] + d[k]) + 8 * d[k], d[k], np.int64)
    return hashes, doc, pos, ids, extra


def by_range(hashes: np.ndarray):
    """Indexes of the windows, by ranges of their hashes of SORT_AT_ONCE or so, so that sorting needs little memory."""
    parts = max(1, -(-len(hashes) // SORT_AT_ONCE))
    which = ((hashes & U64(0xFFFF)) % U64(parts)).astype(np.uint16)
    for k in range(parts):
        yield np.flatnonzero(which == k)


def spans(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
