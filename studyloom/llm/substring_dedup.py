"""1. Substring dedup: Rabin-Karp hashes of every window of tokens, counted in Spark.

Each task hashes every ``width``-word window of its documents, keeps for a hash that repeats within
a slice of documents the windows of the least document (the others are hits already) and packs the
rest into blocks by bucket of the hash. One shuffle brings equal hashes together, where the least
document is found and all windows of other documents are hits; a second, small one brings the hits
of a document together, where they merge into maximal intervals. The last joins them to the texts.

Windows count as equal if their hashes do: 56 bits and the bucket, for well-mixed 64-bit word hashes.
The expected number of false matches is the number of windows times 6e-12 at any size, as buckets
(of some 400,000 windows) grow in number with the text.

Defined results: null or blank text has no words; a null id neither removes nor loses words; rows
that share an id do not remove each other's words and, if their texts differ, keep their own
intervals (a 16-bit digest of the text tells them apart); columns beyond the id and the text pass
through, and a column with the name of a result gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import bounded_batches, with_computed
from . import kernels
from .kernels import BLOCK, BLOCK_DDL, NON_SPACE, U64, bucket_of, buffers, by_range, byte_table, mix, pack, row_of, slices, span_hashes, spans, unpack, window_hashes, words
from .shared import bucket_keys, n_partitions, table

WIDTH = 50
_TAG = "__text_tag"


def _pack_hits(doc: np.ndarray, at: np.ndarray, ids: np.ndarray, tags: np.ndarray, keys: np.ndarray) -> pa.RecordBatch | None:
    """Hits (document, position) in blocks by group of documents; their bucket is -1 - key."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    return pack(-1 - keys[(mix(ids.astype(U64)) % U64(len(keys))).astype(np.int64)][doc], doc, at, ids, tags)


def _later(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window repeats one of a lesser id, and whether it belongs to the least of its hash."""
    order = np.argsort(hashes, kind="stable")
    heads = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(heads))[np.cumsum(heads) - 1]
    later = np.empty(len(ids), bool)
    later[order] = ids[order] > least
    return later, ~later


def removal_intervals(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, tag, starts, ends): maximal intervals of words covered by windows of documents with a lesser id."""
    bounded_batches(docs)
    parts = n_partitions(docs, text_col)
    keys = np.array(bucket_keys(docs.sparkSession, parts))
    limit = kernels.SLICE_BYTES
    table64 = byte_table()

    def blocks(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids_all, tags_all = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            for a, b in slices(offsets, limit):
                text, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = words(text, off, NON_SPACE)
                hashes, at = window_hashes(span_hashes(text, starts, ends, table64), first, width)
                if not len(hashes):
                    continue
                row = row_of(at, first)
                ids, tags = ids_all[a:b], tags_all[a:b]
                later, least = _later(hashes, ids[row])
                pos = at - first[row]
                for out in (_pack_hits(row[later], pos[later], ids, tags, keys), pack(bucket_of(hashes[least], keys), row[least], pos[least], ids, tags, hashes[least])):
                    if out is not None:
                        yield out

    def resolve(key, batch):
        if key[0].as_py() < 0:  # hits already: on to their group of documents
            return batch.set_column(0, "bucket", pa.array([-1 - key[0].as_py()] * len(batch), pa.int32()))
        hashes, doc, at, ids, tags = unpack(batch)
        later = np.zeros(len(hashes), bool)
        for some in by_range(hashes):
            if len(some):
                later[some] = _later(hashes[some], ids[doc[some]])[0]
        out = _pack_hits(doc[later], at[later], ids, tags, keys)
        found = pa.Table.from_batches([out] if out is not None else [], BLOCK)
        return found.set_column(0, "bucket", pa.array([-1 - b for b in found.column("bucket").to_pylist()], pa.int32()))

    def merge(key, batch):
        _, doc, at, ids, tags = unpack(batch, with_hashes=False)
        ids, tags = ids[doc], tags[doc]
        order = np.lexsort((at, tags, ids))
        ids, tags, at = ids[order], tags[order], at[order]
        new_doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
        new_run = new_doc | np.concatenate([[True], at[1:] > at[:-1] + width])
        run = np.flatnonzero(new_run)
        last = np.concatenate([run[1:], [len(at)]]) - 1
        docs_at = np.flatnonzero(new_doc)
        off = np.searchsorted(run, np.concatenate([docs_at, [len(at)]]))
        return pa.table({"id": ids[docs_at], "tag": tags[docs_at].astype(np.int32), "starts": spans(off, at[run], pa.int32()), "ends": spans(off, at[last] + width, pa.int32())})

    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(_TAG).alias("tag"))
    hits = known.mapInArrow(blocks, BLOCK_DDL).repartition(parts, "bucket").groupBy("bucket").applyInArrow(resolve, BLOCK_DDL)
    return hits.repartition(parts, "bucket").groupBy("bucket").applyInArrow(merge, "id long, tag int, starts array<int>, ends array<int>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, n_removed, removed_starts, removed_ends (word intervals) and kept_text."""
    tagged = docs.withColumn(_TAG, F.xxhash64(F.col(text_col)).bitwiseAND(0xFFFF).cast("int"))
    cuts = removal_intervals(tagged, id_col, text_col, width).select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    joined = tagged.join(cuts, (F.col(id_col).cast("long") == F.col("__id")) & (F.col(_TAG) == F.col("__tag")), "left").drop("__id", "__tag", _TAG)

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        starts, ends, first = words(data, off, NON_SPACE)
        gone = np.zeros(len(starts) + 1, np.int32)
        for name, sign in (("__starts", 1), ("__ends", -1)):
            column = batch.column(name)
            row = np.repeat(np.arange(len(column)), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            np.add.at(gone, first[row] + column.flatten().to_numpy(), sign)
        keep = np.cumsum(gone)[:-1] == 0
        # the bytes of kept words, and after each but a document's last the byte that follows it, as a space
        row = row_of(np.arange(len(starts)), first)
        kept_row = row[keep]
        text, take = data.copy(), np.zeros(len(data) + 1, np.int32)
        np.add.at(take, starts[keep], 1)
        np.add.at(take, ends[keep], -1)
        mask = np.cumsum(take)[:-1] > 0
        between = ends[keep][:-1][kept_row[1:] == kept_row[:-1]] if len(kept_row) else np.zeros(0, np.int64)
        text[between], mask[between] = 0x20, True
        size = np.concatenate([[0], np.cumsum(mask)])[off].astype(np.int32)
        n_words = np.diff(first)
        kept = np.bincount(kept_row, minlength=len(n_words))
        return {
            "n_words": pa.array(n_words), "n_removed": pa.array(n_words - kept), "removed_starts": batch.column("__starts"), "removed_ends": batch.column("__ends"),
            "kept_text": pa.StringArray.from_buffers(len(n_words), pa.py_buffer(size.tobytes()), pa.py_buffer(text[mask].tobytes())),
        }

    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_starts", ints), T.StructField("removed_ends", ints), T.StructField("kept_text", T.StringType())]
    return with_computed(joined, text_col, cut, fields).drop("__starts", "__ends")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN least USING (h) WHERE win.doc_id > m)),
word_at AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word_at ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
