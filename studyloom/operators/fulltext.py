"""Full-text search: an inverted index with positions, conjunctive queries, cover-density ranks and hybrid search.

A term is a run of letters and digits, in lower case; positions count from 1. The index is a table (term, id, positions), and a
query reads only its terms' rows. A cover is a least stretch of a text that holds all terms of the query; a text's rank is
the sum over its covers of WEIGHT / (1 + words of the cover that are none of the query's), so near terms and
many covers rank high. A text that lacks a term has rank 0 and does not match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine
from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: What a term's occurrence weighs; the parts of similarity and rank in a hybrid score; the distance under which a vector matches.
WEIGHT, BY_VECTOR, BY_RANK, NEAR = 0.1, 0.7, 0.3, 0.3
TERM = r"[\p{L}\p{N}]+"


def query_terms(text: str) -> list[str]:
    """A query's distinct terms in order; all of them must be found."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, positions): each text's terms with their places, ascending. Null texts have none.

    Terms shrink to one row for each text before anything is shuffled, if rows of a text stay together."""
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit(TERM), F.lit(0))).alias("at", "term"))
    return words.groupBy("term", "id").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


def covers(index: DataFrame, terms: list[str]) -> DataFrame:
    """(id, p, q, others): the least stretches p to q of texts that hold all ``terms``, with the words in them that are none of these.

    Over a text's occurrences in order, the last place of each term so far tells where the latest stretch that ends here
    begins; a stretch is a cover where that beginning is a new one."""
    if not terms:
        return index.select("id", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("others")).limit(0)
    found = index.where(F.col("term").isin(terms))
    each = found.select("id", "term", F.explode("positions").alias("at"))
    order = Window.partitionBy("id").orderBy("at")
    each = each.withColumn("nth", F.row_number().over(order))
    here = F.struct("at", "nth")
    last = [F.max(F.when(F.col("term") == t, here)).over(order) for t in terms]
    whole = F.lit(True)
    for x in last:
        whole = whole & x.isNotNull()
    began = each.select("id", "at", "nth", F.when(whole, F.least(*last) if len(last) > 1 else last[0]).alias("began"))
    before = F.lag("began.at").over(order)
    fresh = began.where("began is not null").withColumn("before", before).where("before is null or before < began.at")
    return fresh.select("id", F.col("began.at").alias("p"), F.col("at").alias("q"), (F.col("at") - F.col("began.at") - F.col("nth") + F.col("began.nth")).alias("others"))


def ranked(index: DataFrame, text: str) -> DataFrame:
    """(id, rank) of the texts that hold all terms of the query, by cover density."""
    return covers(index, query_terms(text)).groupBy("id").agg(F.sum(F.lit(WEIGHT) / (1 + F.col("others"))).alias("rank"))


def hybrid(docs: DataFrame, vectors: DataFrame, text: str, target, k: int, kept: Column | None = None, id_col: str = "doc_id", text_col: str = "text", vector: str = "embedding") -> DataFrame:
    """(id, similarity, rank, score): the ``k`` best of the documents (and ``kept`` ones only, if given) that match the query or whose vector
    (id, ``vector``) is nearer than NEAR, by BY_VECTOR * similarity + BY_RANK * rank. Documents without a vector are left out."""
    chosen = docs if kept is None else docs.where(kept)
    wanted = F.array(*(F.lit(float(x)) for x in target))
    # only words of the query are indexed here: a whole index is made once and kept, this one serves one query
    terms = query_terms(text)
    index = inverted_index(chosen, id_col, text_col).where(F.col("term").isin(terms)) if terms else inverted_index(chosen.limit(0), id_col, text_col)
    near = chosen.select(F.col(id_col).alias("id")).join(vectors.select("id", cosine(F.col(vector), wanted).alias("similarity")), "id")
    both = near.join(ranked(index, text), "id", "left").where(F.col("rank").isNotNull() | (1 - F.col("similarity") < NEAR))
    rank = F.coalesce("rank", F.lit(0.0))
    scored = both.select("id", "similarity", rank.alias("rank"), (BY_VECTOR * F.col("similarity") + BY_RANK * rank).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _rank_sql(terms: list[str], docs: str = "documents") -> str:
    last = [f"max(CASE WHEN term = '{t}' THEN pos END) OVER w" for t in terms]
    return rf"""w AS (SELECT doc_id, unnest(x) AS term, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS x FROM {docs})),
o AS (SELECT doc_id, pos, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM w WHERE term IN ({', '.join(f"'{t}'" for t in terms)})),
b AS (SELECT *, CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in last)} THEN least({', '.join(last)}) END AS p FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, p, min(pos) AS q FROM b WHERE p IS NOT NULL GROUP BY ALL),
r AS (SELECT f.doc_id, sum({WEIGHT} / (1 + (f.q - f.p) - (SELECT count(*) - 1 FROM o WHERE o.doc_id = f.doc_id AND o.pos BETWEEN f.p AND f.q))) AS rank FROM f GROUP BY ALL)"""


WORDS = "the of and"


@query(f"WITH {_rank_sql(WORDS.split())} SELECT doc_id, round(rank, 6) AS rank FROM r")
def fulltext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every document that holds all words of a query."""
    index = inverted_index(scan(spark, sf_dir, "documents", "doc_id", "text"))
    return ranked(index, WORDS).select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(f"""
WITH {_rank_sql(WORDS.split())}, v AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings)
SELECT d.doc_id, round(sim, 6) AS similarity, round(coalesce(rank, 0), 6) AS rank, round({BY_VECTOR} * sim + {BY_RANK} * coalesce(rank, 0), 6) AS score FROM documents d JOIN v ON vec_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
WHERE d.lang = 'en' AND (rank IS NOT NULL OR 1 - sim < {NEAR}) ORDER BY {BY_VECTOR} * sim + {BY_RANK} * coalesce(rank, 0) DESC, d.doc_id LIMIT 20""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best English documents by vector and words together."""
    v = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    target = v.where("vec_id = 0").first().embedding
    docs = scan(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = hybrid(docs, v.withColumnRenamed("vec_id", "id"), WORDS, target, 20, F.col("lang") == "en")
    return found.select(F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))
