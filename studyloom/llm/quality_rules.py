"""7. Quality rules: base counts and compression bands.

zstandard (level 3) compresses each whole text and each fixed chunk of CHUNK bytes. A band gives, for
texts of at least its length, the least and the greatest ratio (bytes by compressed bytes) that
running text reaches: below it a text is incompressible (encoded data, noise), above it repetitive.
Short texts compress badly whatever they say, so the bands widen and rise with the length; texts
below the first band have no limits. From 256 bytes on the least ratios lie below those of Chinese prose,
the densest measured (1.03 from 256 bytes, 1.17 from 512, 1.34 from 1024, 1.51 from 2048, 1.84 from 8192, chunks 1.68);
base64 has 1.29 at most below 2048 bytes and 1.33 beyond, so below 1024 bytes it can pass. Chunks have one
band; a text fails by its chunks if at least CHUNK_SHARE of its full chunks (there must be one) are outside,
or of these and its last CHUNK bytes.

Everything is computed row by row within the task that reads the row. Words, 5-word windows and lines
are compared by 64-bit hashes. Defined results: null counts as empty text, which has no words and so
fails the base rules; repeated rows are judged alike; extra columns pass through, and those named as a
result give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrow import with_computed
from .kernels import NON_SPACE, U64, buffers, byte_table, mix, row_of, span_hashes, window_hashes, words
from .shared import table

#: (least bytes, least ratio, greatest ratio), by rising length.
BANDS = ((128, 0.95, 3.0), (256, 1.02, 3.0), (512, 1.15, 3.5), (1024, 1.30, 3.5), (2048, 1.45, 4.0), (8192, 1.75, 5.0), (65536, 1.85, 6.5))
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (1.60, 4.5), 0.25
SYMBOLS = b"#*$%&|<>"


def _counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    rows = len(off) - 1
    table64 = byte_table()
    starts, ends, first = words(data, off, NON_SPACE)

    def per_row(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[off])

    member = np.zeros(256, bool)
    member[list(SYMBOLS)] = True
    hashes, at = window_hashes(span_hashes(data, starts, ends, table64), first, 5)
    row = row_of(at, first)
    key = hashes ^ mix(row.astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(head), len(key)))
    twice = order[np.repeat(size > 1, size)]
    marks = np.zeros(len(starts) + 1, np.int64)
    np.add.at(marks, at[twice], 1)
    np.add.at(marks, at[twice] + 5, -1)
    repeat = np.cumsum(marks)[:-1] > 0
    # lines: cut at \n and at the ends of rows
    newline = np.flatnonzero(data == 0x0A)
    line_row = np.searchsorted(off, newline, "right") - 1
    filled = np.flatnonzero(off[1:] > off[:-1])
    line_start = np.concatenate([off[:-1][filled], newline + 1])
    owner = np.concatenate([filled, line_row])
    by = np.lexsort((line_start, owner))
    line_start, owner = line_start[by], owner[by]
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    line_end = np.where(last, off[owner + 1] if len(owner) else 0, np.append(line_start[1:], 0) - 1)
    word_at = np.searchsorted(starts, line_start)
    has_word = (word_at < len(starts)) & (np.append(starts, len(data))[word_at] < line_end)
    line_start, line_end, owner = line_start[has_word], line_end[has_word], owner[has_word]
    line = span_hashes(data, line_start, line_end, table64) ^ mix(owner.astype(U64) + U64(1)) if len(owner) else np.zeros(0, U64)
    _, kept = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[kept] = False
    return {
        "n_words": np.diff(first),
        "word_chars": per_row(NON_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(member[data]),
        "n_dup_lines": np.bincount(owner[again], minlength=rows),
        "n_repeat_words": np.bincount(row_of(np.flatnonzero(repeat), first), minlength=rows),
    }


def _ratios(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's whole-text ratio and the share of its chunks outside the chunk band (0 without a full one)."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    whole, share = np.ones(len(off) - 1), np.zeros(len(off) - 1)
    low, high = CHUNK_BAND
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if a == b:
            continue
        raw = data[a:b].tobytes()
        whole[r] = len(raw) / len(compress(raw))
        chunks = len(raw) // CHUNK
        if chunks:
            outside = sum(not low <= CHUNK / len(compress(raw[i * CHUNK : (i + 1) * CHUNK])) <= high for i in range(chunks))
            share[r] = outside / chunks
            if len(raw) % CHUNK:
                outside += not low <= CHUNK / len(compress(raw[-CHUNK:])) <= high
                share[r] = max(share[r], outside / (chunks + 1))
    return whole, share


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, ratio, chunk_share (outside the band), verdict and kept."""
    floors = np.array([b[0] for b in BANDS])
    low, high = (np.array([wide, *(b[k] for b in BANDS)]) for k, wide in ((1, 0.0), (2, np.inf)))

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        out = _counts(data, off)
        whole, share = _ratios(data, off)
        band = np.searchsorted(floors, np.diff(off), "right")
        failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
        verdict = np.select([failed, whole > high[band], whole < low[band], share >= CHUNK_SHARE], ["base", "repetitive", "incompressible", "chunks"], "kept")
        return {k: pa.array(v) for k, v in (out | {"base_failed": failed, "ratio": whole, "chunk_share": share, "kept": verdict == "kept"}).items()} | {"verdict": pa.array(verdict.tolist(), pa.string())}

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), T.StructField("chunk_share", T.DoubleType()), T.StructField("verdict", T.StringType()), T.StructField("kept", T.BooleanType())]
    return with_computed(docs, text_col, compute, fields)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_share", "verdict")
