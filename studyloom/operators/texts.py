"""Texts to rows: sentence chunks, windows, markdown sections, outlines, digests, candidate names, recovered JSON."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

from ..functions.columns import by_paragraph, by_row, chunks, first_rule, json_in_text, overlapping, sentences, slug, windows  # noqa: E402


def sentence_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 450, tail: int = 80, least: int = 30) -> DataFrame:
    """(id, chunk_no, chunk): sentences filled up to ``limit`` characters with a carried tail."""
    parts = chunks(sentences(F.coalesce(F.col(text_col), F.lit(""))), limit, tail, least)
    return docs.select(id_col, F.posexplode(parts).alias("chunk_no", "chunk"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-aware chunks of all documents (an order-dependent fold: tests compare with Python)."""
    out = sentence_chunks(scan(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query("""
SELECT doc_id, CAST(i / 1080 AS INTEGER) AS chunk_no, md5(substr(text, CAST(i AS BIGINT) + 1, 1200)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 121, 0), 1080)) AS i FROM documents)""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1200 characters that overlap by 120."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(windows(F.col("text"), 1200, 120)).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def overlapping_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1200, overlap: int = 120) -> DataFrame:
    """(id, chunk_no, chunk): sentences and lines filled up to ``most`` characters, each chunk led by the end of the one before; null texts have none."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t]+", " "), r"^\s+|\s+$", ""))
    units = F.filter(F.transform(F.split(clean, r"(?<=[。！？；\n])"), lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")
    return docs.select(id_col, F.posexplode(overlapping(units, most, overlap)).alias("chunk_no", "chunk"))


@query()
def overlapped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of up to 1200 characters of all documents with an overlap (an order-dependent fold: tests compare with Python)."""
    out = overlapping_chunks(scan(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def markdown_pieces(docs: DataFrame, id_col: str, text_col: str, most: int, least: int = 40) -> DataFrame:
    """(id, section_no, piece_no, h1, h2, h3, body): the sections, those of over ``most`` characters split at paragraphs; pieces of at least ``least``."""
    rows = markdown_sections(docs, id_col, text_col, 1).select(id_col, "section_no", "h1", "h2", "h3", F.posexplode_outer(by_paragraph(F.col("body"), most)).alias("piece_no", "body"))
    return rows.where(F.length(F.trim("body")) >= least).select(id_col, "section_no", "piece_no", "h1", "h2", "h3", "body")


def markdown_sections(docs: DataFrame, id_col: str, text_col: str, least: int = 40) -> DataFrame:
    """(id, section_no, h1, h2, h3, body): text between headings of levels 1 to 3 with the headings above it."""
    from .temporal import carry_headings

    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^(#{1,3})\s+\S", 1)
    marked = lines.withColumns({"level": F.when(mark != "", F.length(mark)), "title": F.trim(F.regexp_replace("line", r"^#{1,3}\s+", ""))})
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = carry_headings(marked, [id_col], "line_no", "level", "title").withColumn("section_no", F.count("level").over(w))
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n"))
    grouped = carried.groupBy(id_col, "section_no").agg(*(F.first(h, ignorenulls=True).alias(h) for h in ("h1", "h2", "h3")), body.alias("body"))
    return grouped.where(F.length("body") >= least)


def numbered_topics(text):
    """The topics 1, 2, 3 ... of a text, each at the first line with the expected number (empty below two)."""
    found = F.split(text, "\n")
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(s, line):
        hit = F.regexp_extract(line, r"^\s*(\d{1,3})[\.、)]\s*(\S.*)$", 1) == s["next"].cast("string")
        title = F.regexp_extract(line, r"^\s*(\d{1,3})[\.、)]\s*(\S.*)$", 2)
        return F.struct(F.when(hit, s["next"] + 1).otherwise(s["next"]).alias("next"), F.when(hit, F.array_append(s["out"], title)).otherwise(s["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda s: F.when(F.size(s["out"]) >= 2, s["out"]).otherwise(F.array().cast("array<string>")))


def _fresh(points: Iterable[str], least: int, most: float, k: int | None = None) -> list[str]:
    """The first ``k`` of ``distinct_points``; a point's pairs of characters are made once, and none are compared beyond ``k``."""
    kept: list[tuple[str, set[str]]] = []
    for x in points:
        if k is not None and len(kept) >= k:
            break
        pairs = {x[i : i + 2] for i in range(len(x) - 1)}

        def like(y: str, others: set[str], x: str = x, pairs: set[str] = pairs) -> float:
            if x and y and (x in y or y in x):
                return min(len(x), len(y)) / max(len(x), len(y))
            return len(pairs & others) / len(pairs | others) if pairs or others else 0.0

        if len(x) >= least and all(like(*y) < most for y in kept):
            kept.append((x, pairs))
    return [x for x, _ in kept]


def distinct_points(points, least: int = 6, most: float = 0.68):
    """Points of at least ``least`` characters that are less than ``most`` similar to every one kept before."""
    return by_row(lambda units: _fresh(units, least, most), points)


#: Words that make a sentence more or less worth a place in a digest, and their weights; fixed values.
DIGEST_TERMS = [("definition", 1.0), ("cause", 1.0), ("result", 1.0), ("because", 1.0), ("history", -3.0)]
_SEPARATORS, _DIGIT = "，,；;、 ", re.compile("[0-9]")


def _score(s: str) -> float:
    low = s.lower()
    return sum(w for t, w in DIGEST_TERMS if t in low) + 0.5 * bool(_DIGIT.search(s)) + 1.0 * (12 <= len(s) <= 78)


def digest(text, k: int = 4):
    """The ``k`` best sentences in their order: the best 2k by score, near repeats dropped, then the first k."""

    def fold(units: list[str]) -> list[str]:
        units = [u.strip(" ") for u in units]
        best = sorted(heapq.nsmallest(2 * k, ((-_score(s), i) for i, s in enumerate(units))), key=lambda x: x[1])
        return _fresh((shortened(units[i]) for _, i in best), 6, 0.68, k)

    return by_row(fold, sentences(text))


def shortened(s: str, most: int = 78, least: int = 48) -> str:
    """Up to ``most`` characters, cut at the last separator from ``least`` on if there is one."""
    if len(s) <= most:
        return s
    cut = max(s.rfind(c, least - 1, most) for c in _SEPARATORS)
    return s[:cut].rstrip(_SEPARATORS) if cut >= 0 else s[:most]


@query()
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four sentences of each document (folds: tests check the bounds)."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("points", digest(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", F.size("points").alias("n_points"), F.array_join("points", " | ").alias("points"))


#: Names of node types by keyword; the first that is found wins.
NODE_TYPES = [("licence", r"(?i)licensed|copyright"), ("contact", r"@"), ("list", r"(?m)^\s*[-*]\s"), ("long", r"(?s)^.{2000,}")]


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed|copyright') THEN 'licence' WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, '(?m)^\s*[-*]\s') THEN 'list' WHEN length(text) >= 2000 THEN 'long' ELSE 'concept' END AS node_type,
  trim(regexp_replace(lower(substr(text, 1, 30)), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM documents""")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", first_rule(F.col("text"), NODE_TYPES, "concept").alias("node_type"), slug(F.substring("text", 1, 30)).alias("slug"))


@query("""
SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE length(line) BETWEEN 1 AND 80 AND regexp_matches(line, '^[A-Z][^.]*\\.$')""")
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that are one sentence."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.where(F.length("line").between(1, 80) & F.col("line").rlike(r"^[A-Z][^.]*\.$")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON that stands in other text."""
    noisy = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nThat is all."))
    return scan(spark, sf_dir, "events", "event_id", "props").select("event_id", F.get_json_object(json_in_text(noisy), "$.k").cast("long").alias("k"))


@query("""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS script, count(*) AS n FROM conversations GROUP BY conv_id""")
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's texts in order as one text."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n\n").alias("script"), F.count("*").alias("n"))
