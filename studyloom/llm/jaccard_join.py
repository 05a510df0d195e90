"""9. N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles, hashed. Equal sets are one node from the start.

1. Counting. Packed blocks of (shingle, set) meet by shingle; a shingle of one set only cannot join
   anything, so what comes back to a set are its shared shingles with their exact frequencies. The
   others are counted, not stored: overlaps never need them. Sets that share too few are dropped.
2. Index. A set lists its shingles rarest first; with ``s`` shingles the first ``s - need(s) + 1``
   hold a shingle in common with any set it links with. Index lists are grouped into blocks of equal
   (set size, position), and whole blocks are skipped by the size and position bounds.
3. Leaders. Each list's members are verified against one leader only, the set with the fewest shingles
   of its own (of near copies the least changed one); a member's verified leader with the largest
   overlap is its anchor, and its slack the shared shingles that the anchor lacks.
4. Answers from similar sets. What is left are pairs in different components. For such pairs only
   their anchors' overlap is computed; anchors that link join their components, |A & B| <=
   |anchor(A) & anchor(B)| + slack(A) + slack(B) rules out most others, and the rest are verified. So a group of near copies costs one verification
   a member, and no link between different components is lost.

Defined results: null or blank texts have an empty set, link with nothing and are their own
component; a null id takes part (its component is the least non-null id reached, null if there is
none); repeated rows have equal sets; extra columns pass through, those named as a result give way.
Shingles count as equal if their 56 hash bits and bucket do, sets if their 64-bit digests do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import bounded_batches, with_computed
from .components import components
from . import kernels
from .kernels import BLOCK_DDL, NON_SPACE, U64, _expand, _squeeze, bucket_of, buffers, by_range, byte_table, mix, pack, row_of, slices, span_hashes, unpack, window_hashes, words
from .shared import bucket_keys, n_partitions, table, written

SHINGLE, NUM, DEN = 5, 80, 100


def _sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every row's distinct shingles, by row and hash."""
    starts, ends, first = words(data, off, NON_SPACE)
    word = span_hashes(data, starts, ends, byte_table(lower=True))
    hashes, at = window_hashes(word, first, width)
    row = row_of(at, first)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < width))  # fewer words: the whole sequence is one shingle
    whole = [window_hashes(word[first[r] : first[r + 1]], np.array([0, n[r]]), int(n[r]))[0] ^ U64(n[r]) for r in short]
    hashes, row = np.concatenate([hashes, *whole]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if len(hashes):
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
        hashes, row = hashes[fresh], row[fresh]
    return hashes, row


def _digests(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set size and a digest of its set (a sum of mixed hashes, so order doesn't matter)."""
    sizes = np.bincount(row, minlength=n_rows)
    sums = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ U64(0xA5A5A5A55A5A5A5A)))])
    edge = np.searchsorted(row, np.arange(n_rows + 1))
    return sizes, mix(sums[edge[1:]] - sums[edge[:-1]] + sizes.astype(U64)).view(np.int64)


def with_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with n_shingles and set_id, the digest of the set (null if it is empty)."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        hashes, row = _sets(data, off, width)
        sizes, digests = _digests(hashes, row, len(off) - 1)
        return {"n_shingles": pa.array(sizes, pa.int64()), "set_id": pa.array(digests, pa.int64(), mask=sizes == 0)}

    return with_computed(docs, text_col, compute, [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType())])


def shared_shingles(docs: DataFrame, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(sid, n, lone, tokens): sets that can have a partner, with the shingles they share, rarest first.

    lone: how many of the set's n shingles occur in no other set."""
    bounded_batches(docs)
    parts = n_partitions(docs, text_col)
    keys = np.array(bucket_keys(docs.sparkSession, parts))
    limit_bytes = kernels.SLICE_BYTES

    def blocks(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in slices(offsets, limit_bytes):
                text, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, row = _sets(text, off, width)
                sizes, digests = _digests(hashes, row, b - a)
                _, kept = np.unique(digests, return_index=True)  # equal sets of a slice are one
                mask = np.zeros(b - a, bool)
                mask[kept] = True
                mask &= sizes > 0
                take = mask[row]
                out = pack(bucket_of(hashes[take], keys), row[take], np.zeros(int(take.sum()), np.int32), digests, sizes.astype(np.int64), hashes[take])
                if out is not None:
                    yield out

    def count(key, batch):
        hashes, doc, _, sids, n_of = unpack(batch, with_pos=False)
        found, base = [], key[0].as_py() << 40
        for some in by_range(hashes):
            h, d = hashes[some], doc[some]
            order = np.lexsort((sids[d], h))
            h, d = h[order], d[order]
            i = sids[d]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])  # one set in several slices
            h, d = h[fresh], d[fresh]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            freq = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
            keep = freq > 1
            # a shared shingle is from now on its number in the bucket, which packs better than its hash
            found.append((d[keep], base + (np.cumsum(head & keep) - 1)[keep], freq[keep]))
            base += int((head & keep).sum())
        d, rank, freq = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, sizes = sids[d], n_of[d]
        group = keys[(mix(ids.astype(U64)) % U64(parts)).astype(np.int64)]
        order = np.lexsort((rank, ids, group))
        group, ids, sizes, rank, freq = (x[order] for x in (group, ids, sizes, rank, freq))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else [0]
        rows = [(int(group[a]), _squeeze(np.concatenate([x[a:b] for x in (ids, sizes, rank, freq)]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "found": pa.array([x for _, x in rows], pa.binary())})

    def assemble(key, batch):
        parts_of = [_expand(x.as_py(), np.int64).reshape(4, -1) for x in batch.column("found")]
        ids, sizes, hashes, freq = np.concatenate(parts_of, axis=1)
        del parts_of
        order = np.lexsort((hashes, freq, ids))
        ids, sizes, hashes = ids[order], sizes[order], hashes[order]
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        have = np.diff(np.concatenate([start, [len(ids)]]))
        n = sizes[start]
        possible = den * have >= num * n  # |A & B| >= t |A | B| >= t |A|
        token = np.repeat(possible, have)
        off = np.concatenate([[0], np.cumsum(have[possible])])
        return pa.table({"sid": ids[start][possible], "n": n[possible], "lone": (n - have)[possible], "tokens": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(hashes[token], pa.int64()))})

    met = docs.select(text_col).mapInArrow(blocks, BLOCK_DDL).repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, "g int, found binary")
    return met.repartition(parts, "g").groupBy("g").applyInArrow(assemble, "sid long, n long, lone long, tokens array<long>")


def _need(a: str, b: str, num: int, den: int):
    """Least overlap of sets of sizes a and b that link: o >= t (a + b) / (1 + t)."""
    return F.ceil(F.lit(num) * (F.col(a) + F.col(b)) / F.lit(num + den))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with sizes na, nb and the exact overlap o."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))


def linked_components(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) for every set that links with another one; sets: a written table of shared_shingles."""
    size_ok = "{den} * least({x}, {y}) >= {num} * greatest({x}, {y})"
    cut = F.expr(f"slice(tokens, 1, cast(greatest(0, n - ceil(n * {num} / {den}) + 1 - lone) as int))")
    listed = sets.select("sid", "n", "lone", F.posexplode(cut).alias("p", "token"))
    index = written(listed.select("token", "sid", "n", "lone", (F.col("p") + F.col("lone")).alias("pos")), "index")
    # leaders: in each list the set with the fewest shingles of its own
    lead = index.groupBy("token").agg(F.min(F.struct("lone", "n", "sid", "pos")).alias("l"), F.count("*").alias("c")).where("c > 1").select("token", F.col("l.n").alias("ln"), F.col("l.sid").alias("b"), F.col("l.pos").alias("lpos"))
    near = index.join(lead, "token").where("sid != b").where(size_ok.format(x="n", y="ln", num=num, den=den)).where(F.least(F.col("n") - F.col("pos"), F.col("ln") - F.col("lpos")) >= _need("n", "ln", num, den))
    first = written(_overlaps(near.select(F.col("sid").alias("a"), "b").distinct(), sets).where(F.col("o") >= _need("na", "nb", num, den)), "links")
    comps = written(components(first.select("a", "b")), "components")

    # each member's anchor: its verified leader with the largest overlap; a set without one is its own.
    # Shingles of one set only are in no overlap, so they don't count as slack.
    anchor = first.groupBy("a").agg(F.max(F.struct("o", "b")).alias("x")).select(F.col("a").alias("sid"), F.col("x.b").alias("anchor"), F.col("x.o").alias("o"))
    known = index.join(comps.select(F.col("node").alias("sid"), "root"), "sid", "left").join(anchor, "sid", "left")
    slack = F.coalesce(F.col("n") - F.col("lone") - F.col("o"), F.lit(0))
    known = written(known.select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("comp"), F.coalesce("anchor", "sid").alias("anchor"), slack.alias("slack")), "known")
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    blocks = written(known.join(mixed, "token").select("token", "comp", "anchor", "n", "pos").distinct(), "blocks")
    x, y = (blocks.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("comp", "anchor", "n", "pos"))) for s in "xy")
    met = x.join(y, "token").where("comp_x < comp_y").where(size_ok.format(x="n_x", y="n_y", num=num, den=den)).where(F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= _need("n_x", "n_y", num, den))
    anchors = written(_overlaps(met.select(F.col("anchor_x").alias("a"), F.col("anchor_y").alias("b")).distinct(), sets), "anchors")
    more = anchors.where(F.col("o") >= _need("na", "nb", num, den)).select("a", "b")
    joined = written(components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "components")

    # members of anchors that didn't link, in different components still, unless the bound rules them out
    member = known.select("sid", "n", "anchor", "slack").distinct().join(joined.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    member = written(member, "members")
    mx, my = (member.select(*(F.col(c).alias(f"{c}_{s}") for c in member.columns)) for s in "xy")
    slackest = member.groupBy("anchor").agg(F.max("slack").alias("most"), F.min("n").alias("least_n"))
    sx, sy = (slackest.select(F.col("anchor").alias(k), F.col("most").alias(f"most_{k}"), F.col("least_n").alias(f"n_{k}")) for k in "ab")
    open_pairs = anchors.join(sx, "a").join(sy, "b").where(F.col("o") + F.col("most_a") + F.col("most_b") >= _need("n_a", "n_b", num, den)).select("a", "b", "o")
    bound = F.col("o") + F.col("slack_x") + F.col("slack_y") >= _need("n_x", "n_y", num, den)
    rest = open_pairs.join(mx, F.col("a") == F.col("anchor_x")).join(my, (F.col("b") == F.col("anchor_y")) & (F.col("root_x") != F.col("root_y")) & F.expr(size_ok.format(x="n_x", y="n_y", num=num, den=den)) & bound)
    last = _overlaps(rest.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct(), sets).where(F.col("o") >= _need("na", "nb", num, den)).select("a", "b")
    return components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with n_shingles, set_id, component_key (equal within a component), is_first and component_id.

    Rows link if den * |A & B| >= num * |A | B|; component_id is the least id of a row's component."""
    sets = written(shared_shingles(docs, text_col, shingle, num, den), "sets")
    roots = written(linked_components(sets, num, den), "roots")
    placed = with_sets(docs, text_col, shingle)
    ids = with_sets(docs.select(F.col(id_col).alias("__id"), F.col(text_col)), text_col, shingle).where("set_id is not null").groupBy("set_id").agg(F.min("__id").alias("least"))
    known = ids.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("key"), "least")
    grouped = known.groupBy("key").agg(F.min(F.struct(F.isnull("least").alias("none"), "least", "set_id")).alias("first"))
    final = known.join(grouped, "key").select(F.col("set_id").alias("__set"), F.col("key").alias("component_key"), F.col("first.least").alias("component_id"), (F.col("set_id") == F.col("first.set_id")).alias("is_first"))
    clash = [c for c in placed.columns if c.lower() in ("component_key", "component_id", "is_first")]
    # empty sets are spread by id: they match nothing and may be many
    placed = placed.drop(*clash).withColumn("__key", F.coalesce("set_id", F.xxhash64(F.lit("empty"), F.col(id_col), F.rand(9))))
    out = placed.join(final, F.col("__key") == F.col("__set"), "left").drop("__set")
    return out.withColumn("component_id", F.when(F.col("set_id").isNull(), F.col(id_col)).otherwise(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The columns of ``docs``: of each component one row, with the least id; all rows without shingles stay.

    Rows that repeat both the id and the set of a kept row go."""
    joined = jaccard_join(docs, id_col, **options)
    kept = joined.where(F.col("set_id").isNull() | (F.col("is_first") & F.col(id_col).eqNullSafe(F.col("component_id"))))
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 2), ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (h) WHERE x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.c + q.c - o)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.node WHERE reach.r < e.b)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(r) AS m FROM reach GROUP BY node) k ON k.node = d.doc_id
"""
