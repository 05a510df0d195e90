"""3. Token counts from distinct pre-tokens, without materialising a document's ids.

The model's normaliser leaves text as it is but for a space in front and the mark U+2581 in place of
spaces, and no piece of its vocabulary holds the mark after another character. So no merge crosses the
start of a run of marks, and a text's tokens are those of its pre-tokens: a run of marks and what
follows up to the next run. ``check_model`` tests both conditions and refuses other models.

Each slice of documents becomes blocks by bucket of the pre-token: the distinct pre-tokens once, and
per-document frequencies. Where a bucket's blocks meet, each distinct pre-token is encoded once, its
count is joined to the frequencies and summed per document; the buckets' partial sums are added up.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are counted row
by row; control strings inside a text are ordinary characters, as in the library; extra columns pass
through and those named as a result give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import bounded_batches
from . import kernels
from .kernels import U64, _expand, _squeeze, buffers, byte_table, mix, row_of, slices, span_hashes
from .shared import n_partitions, table, written

LIMIT = 4096
MARK = "▁"
_BLOCK = "bucket int, slice long, tokens binary, ends binary, rows binary, which binary, freq binary"
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_model(path: str) -> None:
    """Raise unless the model's tokens can be counted by pre-token."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("the model's normaliser does more than mark spaces")
    if any(MARK in p.piece.lstrip(MARK) for p in model.pieces) or any(p.type == 4 for p in model.pieces):
        raise ValueError("the model has pieces that cross the start of a pre-token")


def _pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which each text has a space in front and spaces for marks, and starts, ends, row of pre-tokens."""
    mark = np.frombuffer(MARK.encode(), np.uint8)
    is_mark = np.zeros(len(data), bool)
    if len(data) > 2:
        is_mark[:-2] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    skip = np.zeros(len(data), bool)
    skip[1:] |= is_mark[:-1]
    skip[2:] |= is_mark[:-2]
    text = np.where(is_mark, 0x20, data).astype(np.uint8)[~skip]
    off = np.concatenate([[0], np.cumsum(~skip)])[off]
    n = len(off) - 1
    full = off[1:] > off[:-1]  # an empty text has no tokens, not even the space
    text = np.insert(text, off[:-1][full], 0x20)
    off = off + np.concatenate([[0], np.cumsum(full)])
    space = text == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[off[:-1][full]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(text))
    return text, starts, ends, row_of(starts, off)


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit. Tasks read the model at ``path``."""
    check_model(path)
    bounded_batches(docs)
    parts = n_partitions(docs, text_col)
    n_buckets = 2 * parts
    with open(path, "rb") as f:
        model = f.read()  # half a megabyte, goes out with the function
    limit_bytes = kernels.SLICE_BYTES
    table64 = byte_table()

    def blocks(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys_all = batch.column(0).to_numpy()
            for a, b in slices(offsets, limit_bytes):
                text, starts, ends, row = _pretokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(starts):
                    continue
                hashes = span_hashes(text, starts, ends, table64)
                order = np.lexsort((row, hashes))
                hashes, row = hashes[order], row[order]
                new_token = np.concatenate([[True], hashes[1:] != hashes[:-1]])
                new_pair = new_token | np.concatenate([[True], row[1:] != row[:-1]])
                pair = np.flatnonzero(new_pair)
                freq, token = np.diff(np.append(pair, len(row))), (np.cumsum(new_token) - 1)[pair]
                some = order[np.flatnonzero(new_token)]  # one occurrence of each distinct pre-token
                bucket = ((hashes[new_token] >> U64(32)) % U64(n_buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0])), len(by))
                renamed = np.empty(len(by), np.int64)
                renamed[by] = np.arange(len(by))
                new = renamed[token]
                by_pair = np.argsort(new, kind="stable")
                new, freq, rows = new[by_pair], freq[by_pair], row[pair][by_pair]
                at = np.searchsorted(new, edges)
                size = (ends - starts)[some[by]]
                keys = np.ascontiguousarray(keys_all[a:b])
                name = int(mix(np.cumsum(mix(keys.view(U64) + np.arange(b - a, dtype=U64))))[-1:].view(np.int64)[0])
                out = [(-1 - name % n_buckets, name, b"", b"", _squeeze(keys), b"", b"")]
                raw = text.tobytes()
                for k in range(len(edges) - 1):
                    t0, t1, p0, p1 = edges[k], edges[k + 1], at[k], at[k + 1]
                    joined = b"".join(raw[starts[i] : ends[i]] for i in some[by[t0:t1]])
                    out.append((int(bucket[by[t0]]), name, joined, _squeeze(np.cumsum(size[t0:t1]).astype(np.int32)), _squeeze(rows[p0:p1].astype(np.int32)), _squeeze(np.diff(new[p0:p1] - t0, prepend=0).astype(np.int32)), _squeeze(freq[p0:p1].astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *(pa.binary(),) * 5), strict=True)], names=_NAMES)

    def count(key, batch):
        from sentencepiece import SentencePieceProcessor

        if key[0].as_py() < 0:  # the texts of the slices
            return batch.select(["bucket", "slice", "rows"])
        processor = SentencePieceProcessor(model_proto=model)
        seen: dict[bytes, int] = {}
        parsed, fresh = [], []
        for tokens, ends in zip(batch.column("tokens").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            stop = _expand(ends, np.int32)
            words = [tokens[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
            for w in words:
                if w not in seen:
                    seen[w] = len(seen)
                    fresh.append(w[1:].decode("utf-8", "replace"))  # the library puts the first space back
            parsed.append(np.array([seen[w] for w in words], np.int64))
        pieces = np.array([len(processor.encode(w)) if w else 1 for w in fresh], np.int64)
        out = []
        for ids, rows, which, freq in zip(parsed, *(batch.column(c).to_pylist() for c in ("rows", "which", "freq")), strict=True):
            row = _expand(rows, np.int32)
            out.append(_squeeze(np.bincount(row, _expand(freq, np.int32) * pieces[ids[np.cumsum(_expand(which, np.int32))]]).astype(np.int64)))
        return pa.table({"bucket": batch.column("bucket"), "slice": batch.column("slice"), "rows": pa.array(out, pa.binary())})

    def add(key, batch):
        part = dict(zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True))  # equal slices are counted once
        keys = next(_expand(x, np.int64) for b, x in part.items() if b < 0)
        total = np.zeros(len(keys), np.int64)
        for x in (x for b, x in part.items() if b >= 0):
            sums = _expand(x, np.int64)
            total[: len(sums)] += sums
        return pa.table({"__key": keys, "n_tokens": total})

    # A text's count depends on the text alone, so texts are known by digest and equal ones share a count.
    clash = [c for c in docs.columns if c.lower() in ("n_bytes", "n_tokens", "over_limit")]
    keyed = docs.drop(*clash).withColumn("__key", F.xxhash64(F.col(text_col), F.octet_length(F.col(text_col))))
    met = keyed.select("__key", text_col).mapInArrow(blocks, _BLOCK).repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, "bucket int, slice long, rows binary")
    sums = met.repartition(parts, "slice").groupBy("slice").applyInArrow(add, "__key long, n_tokens long").groupBy("__key").agg(F.max("n_tokens").alias("n_tokens"))
    sums = written(sums, "sums")  # so that Spark can split a text that has very many copies
    sized = keyed.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0).cast("long"))).drop(text_col)
    out = sized.join(sums, "__key", "left").drop("__key").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
