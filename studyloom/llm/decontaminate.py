"""2. Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of documents (bounded in bytes; a longer document is a shard of its own). Its
suffix array orders the start of every word by the words that follow, up to the document's end. It is
sorted by the first three words, then refined by doubling where suffixes still tie, as deep as the
longest item. All suffixes of the benchmark are binary-searched at once: the neighbours of the
insertion point give the longest verbatim match of each suffix, and a second search bounds the range
of suffixes that start with a whole window, which are all its occurrences. Windows that several items share
are searched out once. A document lies in one shard, so nothing is shuffled; the benchmark goes out in blocks of at
most ITEM_BYTES of text (one block up to 32 MB). Of several blocks each scans the documents and its hits are
written before the next one is read; then they are put together by document.

Words are compared by 64-bit hashes of their lower-cased bytes. Defined results: null or blank texts
have no words and are clean; items without words match nothing; every text of an id is searched and the id
counts once; items without an id count together as one, a null in hit_items; repeated documents are each
judged; an empty benchmark leaves every document clean;
extra columns pass through, and a column named as a result gives way to it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_computed
from .kernels import ALNUM, buffers, byte_table, row_of, span_hashes, words
from .shared import prefix_for, table, written

WINDOW = 10
#: Text of the benchmark that is sent to the tasks at once.
ITEM_BYTES = 32 << 20


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of their suffixes, compared to ``depth`` symbols at least.

    Symbols are integers; a 0 ends a document, and what follows it doesn't count."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = np.where(codes == 0, 0, rank + 1).astype(np.int64)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    step = max(1, min(3, 62 // bits))
    pad = np.zeros(n + step, np.int64)
    pad[:n] = rank
    key, alive = pad[:n].copy(), pad[:n] > 0
    for k in range(1, step):
        key = (key << bits) | np.where(alive, pad[k : n + k], 0)
        alive = alive & (pad[k : n + k] > 0)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    group = np.empty(n + 1, np.int64)  # where each position's tie begins in the array
    group[sa], group[n] = start, -1
    end_at = np.flatnonzero(codes == 0)
    last = np.searchsorted(end_at, np.arange(n))
    to_end = np.append(end_at, n)[last] - np.arange(n)
    while step < depth:
        size = np.diff(np.append(np.flatnonzero(head), n))
        open_ = np.repeat(size > 1, size) & (to_end[sa] >= step)
        where = np.flatnonzero(open_)
        if not len(where):
            break
        at = sa[where]
        order = np.lexsort((group[np.minimum(at + step, n)], group[at]))
        at = at[order]
        sa[where] = at  # ties are contiguous, so they stay where their group is
        a, b = group[at], group[np.minimum(at + step, n)]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        head[where] = fresh
        start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        group[sa] = start
        step *= 2
    return sa


def _search(codes: np.ndarray, sa: np.ndarray, query: np.ndarray, at: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each query (``length`` symbols from ``at``) the first place in ``sa`` whose suffix is not
    less than it, or with ``upper`` the first that is greater and doesn't start with it."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        right = np.zeros(len(live), bool)  # go right of mid
        todo, d = np.arange(len(live)), 0
        while len(todo):
            q = live[todo]
            ended = length[q] == d
            right[todo[ended]] = upper
            todo = todo[~ended]
            q = live[todo]
            x, y = codes[np.minimum(sa[mid[todo]] + d, len(codes) - 1)], query[at[q] + d]
            right[todo] = x < y
            todo, d = todo[x == y], d + 1
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


def _common(codes: np.ndarray, sa: np.ndarray, place: np.ndarray, query: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many symbols each query shares with the suffix at ``place``."""
    out = np.zeros(len(at), np.int64)
    todo, d = np.flatnonzero((place >= 0) & (place < len(sa))), 0
    while len(todo):
        todo = todo[length[todo] > d]
        todo = todo[codes[np.minimum(sa[place[todo]] + d, len(codes) - 1)] == query[at[todo] + d]]
        out[todo] += 1
        d += 1
    return out


def _items(ids: list, texts: list, window: int) -> dict:
    """The benchmark's words as hashes, its suffixes and its windows; ids as strings, and which id each text has."""
    data, off = buffers(pa.array(texts, pa.string()))
    starts, ends, first = words(data, off, ALNUM)
    n = np.diff(first)
    row = row_of(np.arange(len(starts)), first)
    left = first[row + 1] - np.arange(len(starts))  # words from here to the item's end
    width = np.minimum(window, n)[row]
    names = [None if i is None else str(i) for i in ids]
    at = {name: k for k, name in enumerate(dict.fromkeys(names))}
    return {"ids": list(at), "id_of": np.array([at[name] for name in names], np.int64), "words": span_hashes(data, starts, ends, byte_table(lower=True)), "row": row, "left": left, "width": width, "window": window, "longest": int(n.max(initial=0))}


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges lo to hi, one after another, and the range that each belongs to."""
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    return lo[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which], which


def _shard_hits(data: np.ndarray, off: np.ndarray, items: dict) -> dict:
    """Of a shard: first (the first word of each row), hit (by word), pairs (row, number of the item's id) and best (row, its longest
    match's words, first word and item word).

    Equal windows of several items are one: their occurrences are listed once, not once for each item."""
    starts, ends, first = words(data, off, ALNUM)
    hit = np.zeros(len(starts), bool)
    none = np.zeros(0, np.int64)
    out = {"first": first, "hit": hit, "pairs": (none, none), "best": (none, none, none, none)}
    if not len(starts) or not len(items["words"]):
        return out
    # dense symbols: even for the shard's words, odd for an item's word that the shard lacks; 0 ends a document
    own, inverse = np.unique(span_hashes(data, starts, ends, byte_table(lower=True)), return_inverse=True)
    row = row_of(np.arange(len(starts)), first)
    place = np.arange(len(starts)) + row
    codes = np.zeros(len(starts) + len(off) - 1, np.int64)
    codes[place] = 2 * inverse + 2
    spot = np.searchsorted(own, items["words"])
    found = own[np.minimum(spot, len(own) - 1)] == items["words"]
    query = np.where(found, 2 * spot + 2, 2 * spot + 1)
    sa = suffix_array(codes, items["longest"])
    at, left, width = np.flatnonzero(found), items["left"][found], items["width"][found]
    spot = _search(codes, sa, query, at, left, False)
    longest = np.maximum(_common(codes, sa, spot, query, at, left), _common(codes, sa, spot - 1, query, at, left))
    whole = (longest >= width) & (left >= width)
    at, width = at[whole], width[whole]
    if not len(at):
        return out
    lo, hi = _search(codes, sa, query, at, width, False), _search(codes, sa, query, at, width, True)
    _, some, window = np.unique(np.stack([lo, width]), axis=1, return_index=True, return_inverse=True)
    window = window.ravel()
    where, which = _ranges(lo[some], hi[some])
    occ = sa[where]
    word = occ - np.searchsorted(np.flatnonzero(codes == 0), occ)  # back to word indexes
    wide = width[some][which]
    marks = np.zeros(len(starts) + 1, np.int64)
    np.add.at(marks, word, 1)
    np.add.at(marks, word + wide, -1)
    out["hit"] = np.cumsum(marks)[:-1] > 0

    # each row's windows once, then their items
    seen = np.unique(np.stack([row[word], which]), axis=1)
    names = np.unique(np.stack([window, items["id_of"][items["row"][at]]]), axis=1)
    edge = np.searchsorted(names[0], np.arange(len(some) + 1))
    where, k = _ranges(edge[seen[1]], edge[seen[1] + 1])
    pairs = np.unique(seen[0][k] * len(items["ids"]) + names[1][where])
    out["pairs"] = (pairs // len(items["ids"]), pairs % len(items["ids"]))
    out["best"] = _longest(codes, place, row, word, wide, np.minimum.reduceat(at[np.argsort(window, kind="stable")], np.searchsorted(np.sort(window), np.arange(len(some))))[which], items, query, at)
    return out


def _longest(codes: np.ndarray, place: np.ndarray, row: np.ndarray, word: np.ndarray, wide: np.ndarray, least: np.ndarray, items: dict, query: np.ndarray, at: np.ndarray) -> tuple:
    """(row, words, first word, item word) of each row's longest match, the earliest of several, in the item that comes first.

    From each word at which a window occurs, the neighbours of the document's suffix among the suffixes of the items that have hits
    tell how far an item goes on with it."""
    rows_of_items = np.unique(items["row"][at])
    member = np.flatnonzero(np.isin(items["row"], rows_of_items))
    ends_item = np.append(items["row"][member][1:] != items["row"][member][:-1], True)
    spot = np.arange(len(member)) + np.cumsum(ends_item) - ends_item
    texts = np.zeros(len(member) + len(rows_of_items), np.int64)
    texts[spot] = query[member]
    back = np.zeros(len(texts), np.int64)
    back[spot] = member
    isa = suffix_array(texts, items["longest"] + 1)
    order = np.lexsort((least, -wide, word))
    head = order[np.concatenate([[True], word[order][1:] != word[order][:-1]])]
    word, wide, least = word[head], wide[head], least[head]
    to_end = np.searchsorted(np.flatnonzero(codes == 0), place[word])
    length = np.flatnonzero(codes == 0)[to_end] - place[word]
    near = _search(texts, isa, codes, place[word], length, False)
    common = np.maximum(_common(texts, isa, near, codes, place[word], length), _common(texts, isa, near - 1, codes, place[word], length))
    goes_on = common >= items["window"]  # so many words begin a window of the item that has them
    size = np.where(goes_on, common, wide)
    best = np.lexsort((word, -size, row[word]))
    best = best[np.concatenate([[True], row[word][best][1:] != row[word][best][:-1]])]
    item = least[best]
    far = np.flatnonzero(goes_on[best])
    if len(far):
        w, n = place[word[best][far]], size[best][far]
        lo, hi = _search(texts, isa, codes, w, n, False), _search(texts, isa, codes, w, n, True)
        bounds, same = np.unique(np.stack([lo, hi]), axis=1, return_inverse=True)
        least_of = np.minimum.reduceat(np.append(back[isa], np.iinfo(np.int64).max), bounds.T.ravel())[::2]
        item[far] = least_of[same.ravel()]
    return row[word[best]], size[best], word[best], item


def find_contamination(docs: DataFrame, ids: list, texts: list, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with what one block of items hits: n_words, hit_words, hit_items and the longest verbatim
    match (longest_words, its first word longest_at in the document, longest_item)."""
    items = _items(ids, texts, window)

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        got = _shard_hits(data, off, items)
        first, rows = got["first"], len(off) - 1
        hit_at = np.flatnonzero(got["hit"])
        hit_row = row_of(hit_at, first)
        hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit_row, np.arange(rows + 1)), pa.int32()), pa.array(hit_at - first[hit_row], pa.int32()))
        row, item = got["pairs"]
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(items["ids"], pa.string()).take(pa.array(item)))
        top, size, word, at = got["best"]
        long_n, long_at, long_item = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
        long_n[top], long_at[top], long_item[top] = size, word - first[top], items["id_of"][items["row"][at]]
        named = pa.array(items["ids"], pa.string()).take(pa.array(long_item, mask=long_item < 0))
        return {"n_words": pa.array(np.diff(first)), "hit_words": hits, "hit_items": found, "longest_words": pa.array(long_n), "longest_at": pa.array(long_at), "longest_item": named}

    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("longest_words", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.StringType())]
    return with_computed(docs, text_col, compute, fields)


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Blocks of distinct (id, text) of about ``limit`` bytes of text (or one text), one after another."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= limit:
        blocks = [rows]
    else:
        n = 2 * -(-total // limit)
        rows = rows.withColumn("k", F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(n)))
        blocks = [rows.where(F.col("k") == k) for k in range(n)]
    for block in blocks:
        got = block.orderBy(F.asc_nulls_last("i"), "t").select("i", "t").collect()
        yield [r.i for r in got], [r.t for r in got]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted as strings, null last), contaminated and the longest match's
    longest_words, longest_at and longest_item."""
    new = ("n_words", "n_hit", "hit_items", "longest_words", "longest_at", "longest_item", "contaminated")
    h = prefix_for(docs)
    kept = [c for c in docs.columns if c.lower() not in new]
    parts = [F.col(c) for c in ("n_words", "hit_words", "hit_items", "longest_words", "longest_at", "longest_item")]
    # columns get names that clash with none, and their own again at the end; the text goes along once
    aside = {c: f"{h}text" if c == text_col else f"{h}{k}" for k, c in enumerate(kept)}
    texts = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in aside.items()), *([] if text_col in aside else [F.col(f"`{text_col}`").alias(f"{h}text")]))
    blocks = _item_blocks(benchmark, item_col, item_text, limit)
    ids, some = next(blocks)
    more = next(blocks, None)
    if more is None:
        out = find_contamination(texts, ids, some, f"{h}text", window)
    else:
        # several blocks: each one's hits are written, for the documents that have any, and put together by document
        texts = written(texts.withColumn(f"{h}n", F.monotonically_increasing_id()), "texts")
        found = []
        for ids, some in chain([(ids, some), more], blocks):
            hits = find_contamination(texts.select(f"{h}n", f"{h}text"), ids, some, f"{h}text", window)
            found.append(written(hits.where("size(hit_words) > 0").select(f"{h}n", *parts[1:]), "hits"))
        every = found[0].sparkSession.read.schema(found[0].schema).parquet(*(x._written_path for x in found))
        best = F.max(F.struct("longest_words", (-F.col("longest_at")).alias("later"), "longest_item"))
        merged = every.groupBy(f"{h}n").agg(F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items"), best.alias("best"))
        merged = merged.select(f"{h}n", "hit_words", "hit_items", "best.longest_words", (-F.col("best.later")).alias("longest_at"), "best.longest_item")
        counted = find_contamination(texts, [], [], f"{h}text", window).drop("hit_words", "hit_items", "longest_words", "longest_at", "longest_item")
        out = counted.join(merged, f"{h}n", "left")
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    items = F.array_sort(F.coalesce("hit_items", F.array().cast("array<string>")))
    out = out.select(*aside.values(), "n_words", n_hit.alias("n_hit"), items.alias("hit_items"), F.coalesce("longest_words", F.lit(0)).alias("longest_words"), F.coalesce("longest_at", F.lit(-1)).alias("longest_at"), "longest_item")
    return out.select(*(F.col(name).alias(c) for c, name in aside.items()), "n_words", "n_hit", "hit_items", "longest_words", "longest_at", "longest_item", (F.col("n_hit") > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS s
        FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM iw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM dw, ks WHERE len(ws) >= k)),
occ AS (SELECT doc_id, i, k, item_id FROM dwin JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
