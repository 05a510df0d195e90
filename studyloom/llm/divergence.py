"""11. Source divergence audit: how far the sources of a language differ in their use of its common terms.

Documents are read by ``lang`` and ``source``. A language keeps the terms of MIN_DOCS of its documents or more;
each (lang, source) group, and each language as a whole, gives a kept term the smoothed share
``p = 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V))`` of its N occurrences of the V kept terms.

1. Counting. DuckDB counts the terms of each task's documents, streamed to it in Arrow batches, so that a hot
   source or a common term leaves PIECE bytes of text as one row for each (lang, source, term).
2. Shards. Spark deals these rows to shards by the hash of (lang, term). In each shard DuckDB adds them up, drops
   rare terms and adds a row for the language as a whole. Spark sums N and V over the shards.
3. Divergence. The kept counts, far fewer than the text, are sharded again, and each shard gets the sums of
   all groups. DuckDB forms the sums of absolute differences of the shard's terms for each pair of sources, and the
   shard's TOP most overused terms for each group; Spark adds the sums up and ranks.

All arithmetic is exact (128-bit products). Memory: a shard's pair sums are as many as the pairs of sources of a
language, like the result; its counts are bounded by the number of shards.

Defined results: null text, lang and source count as ''; rows are documents, so repeated rows count again; a
group without terms has count 0 for every kept term; a language without kept terms has pairs of value 0 and
no terms; ties rank by item, by UTF-8 bytes; an empty table gives an empty result; columns that are not named
are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import bounded_batches
from .shared import n_partitions, table, written

MIN_DOCS, TOP, ALPHA, SCALE = 30, 50, 5, 1_000_000_000
#: Runs of letters: A-Z, a-z and all beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a task counts at once.
PIECE = 32 << 20
#: Kept counts in one shard of the divergence step; each shard yields sums for all pairs of sources, so shards are few.
SHARD_ROWS = 1 << 17

#: The empty term, which no text holds, stands for the group itself and keeps groups without terms.
COUNT = f"""
SELECT lang, source, term, sum(k)::BIGINT AS n, count(*) AS docs
FROM (SELECT lang, source, term, row, count(*) AS k
      FROM (SELECT lang, source, row, unnest(list_append(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), '')) AS term
            FROM (SELECT *, row_number() OVER () AS row FROM rows))
      GROUP BY ALL)
GROUP BY ALL"""
ADD = """
WITH added AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM added GROUP BY ALL HAVING sum(docs) >= {min_docs} OR term = '')
SELECT lang, NULL AS source, term, n FROM kept WHERE term <> ''
UNION ALL SELECT a.lang, a.source, a.term, a.n FROM added a JOIN kept k ON k.lang = a.lang AND k.term = a.term"""
#: Differences of a pair are summed over terms that one of the two has; for the others, see ``divergence``.
DIVERGE = """
WITH stats AS (SELECT *, 1 + ({scale}::HUGEINT * {alpha} // (total + {alpha}::HUGEINT * terms))::BIGINT AS zero FROM rows WHERE term IS NULL AND terms > 0),
shares AS (SELECT r.lang, r.source, r.term, r.n, s.zero, 1 + ({scale}::HUGEINT * (r.n + {alpha}) // (s.total + {alpha}::HUGEINT * s.terms))::BIGINT AS p
           FROM rows r JOIN stats s ON s.lang = r.lang AND s.source IS NOT DISTINCT FROM r.source WHERE r.term IS NOT NULL),
alone AS (SELECT lang, source, zero, p, count(*) AS k FROM shares WHERE source IS NOT NULL GROUP BY ALL),
gains AS (
    SELECT a.lang, least(a.source, s.source) AS a, greatest(a.source, s.source) AS b, sum(a.k * (abs(a.p - s.zero) - abs(a.zero - s.zero))) AS v
    FROM alone a JOIN stats s ON s.lang = a.lang AND s.source <> a.source GROUP BY ALL
    UNION ALL
    SELECT x.lang, x.source, y.source, sum(abs(x.p - y.p) - abs(x.p - y.zero) - abs(x.zero - y.p) + abs(x.zero - y.zero))
    FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND x.source < y.source GROUP BY ALL),
over AS (SELECT g.lang, g.source, g.term, g.p - l.p AS v FROM shares g JOIN shares l ON l.lang = g.lang AND l.term = g.term AND l.source IS NULL WHERE g.source IS NOT NULL AND g.p > l.p)
SELECT lang, a AS source, 'pair' AS part, b AS item, sum(v)::BIGINT AS value FROM gains GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, v FROM over QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, term) <= {top}"""


def _connection() -> duckdb.DuckDBPyConnection:
    """One thread, as Spark runs a task on each core, and no folder of its own."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches in runs of ``limit`` bytes or so (one batch at least)."""
    batches = iter(batches)
    for first in batches:

        def run(first=first):
            size = first.nbytes
            yield first
            while size < limit and (more := next(batches, None)) is not None:
                size += more.nbytes
                yield more

        yield run()


def _sql_map(sql: str, schema: pa.Schema, limit: float = float("inf")):
    """An Arrow map that runs ``sql`` over its task's batches, streamed to it as the view ``rows``, ``limit`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, limit):
            first = next(piece)
            with _connection() as db:
                db.register("rows", pa.RecordBatchReader.from_batches(first.schema, chain([first], piece)))
                for batch in db.sql(sql).to_arrow_reader(100_000):
                    yield batch.cast(schema)

    return run


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n) of kept terms, written; a null source is the language, an empty term the group's documents."""
    bounded_batches(docs)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    strings = [pa.field(c, pa.string()) for c in ("lang", "source", "term")]
    counted = rows.mapInArrow(_sql_map(COUNT, pa.schema([*strings, pa.field("n", pa.int64()), pa.field("docs", pa.int64())]), PIECE), "lang string, source string, term string, n long, docs long")
    sharded = counted.repartition(n_partitions(docs, text), "lang", "term")
    return written(sharded.mapInArrow(_sql_map(ADD.format(min_docs=int(min_docs)), pa.schema([*strings, pa.field("n", pa.int64())])), "lang string, source string, term string, n long"), "terms")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, alpha: int = ALPHA, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other one of its language, part
    ``term`` lists the ``top`` terms that it uses more than its language does."""
    kept = term_counts(docs, text, lang, source, min_docs)
    is_term = F.col("term") != ""
    sums = kept.groupBy("lang", "source").agg(F.sum(F.when(is_term, F.col("n")).otherwise(0)).alias("total"), F.count_if(is_term).alias("terms"))
    vocabulary = sums.where("source is null").select(F.col("lang").alias("l"), F.col("terms").alias("v"))
    stats = written(sums.join(vocabulary, F.col("lang") == F.col("l"), "left").select("lang", "source", "total", F.coalesce("v", F.lit(0)).cast("long").alias("terms")), "groups")

    shards = max(1, -(-kept.count() // SHARD_ROWS))
    none = F.lit(None)
    counts = kept.where(is_term).select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", none.cast("long").alias("total"), none.cast("long").alias("terms"))
    to_all = stats.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", none.cast("string").alias("term"), none.cast("long").alias("n"), "total", "terms")
    sql = DIVERGE.format(top=int(top), alpha=int(alpha), scale=int(scale))

    def diverge(shard: pa.Table) -> pa.Table:
        with _connection() as db:
            db.register("rows", shard)
            return db.sql(sql).to_arrow_table()

    parts = written(counts.union(to_all).groupBy("shard").applyInArrow(diverge, "lang string, source string, part string, item string, value long"), "divergence")

    groups = stats.where("source is not null").withColumn("zero", F.when(F.col("terms") > 0, _share(F.lit(0), alpha, scale)))
    x, y = groups.alias("x"), groups.select("lang", "source", "zero").alias("y")
    base = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source")))
    base = base.select("x.lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.coalesce(F.col("x.terms") * F.abs(F.col("x.zero") - F.col("y.zero")), F.lit(0)).alias("value"))
    pairs = base.unionByName(parts.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("side")
    pairs = pairs.select("lang", "value", sides).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _share(count: Column, alpha: int, scale: int) -> Column:
    """The smoothed share of a term by the columns ``total`` and ``terms``; decimals divide exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    over, under = wide(F.lit(scale)) * (count + alpha), wide(F.col("total")) + wide(F.lit(alpha)) * F.col("terms")
    return F.call_function("div", over, under) + 1


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang
         LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
share AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + {ALPHA}) // (sum(n) OVER (PARTITION BY lang, source) + {ALPHA} * count(*) OVER (PARTITION BY lang, source))) AS p FROM cell),
whole AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {ALPHA}) // (sum(n) OVER (PARTITION BY lang) + {ALPHA} * count(*) OVER (PARTITION BY lang))) AS q FROM kept),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
         FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
         LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
         LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT s.lang, s.source, s.term AS item, s.p - h.q AS value FROM share s JOIN whole h ON h.lang = s.lang AND h.term = s.term WHERE s.n > 0 AND s.p > h.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
           UNION ALL SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
