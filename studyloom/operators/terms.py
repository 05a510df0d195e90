"""Terms in texts: presence under normalisation, answers that a text gives away, items quoted word for word."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bare, bare_array, word_in
from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: Terms are searched by one automaton, sent to all tasks, if they have at most so many bytes; else by a join.
TERM_BYTES = 8 << 20
#: Alphanumeric ASCII terms up to this length count at word bounds only.
SHORT = 4


def _keyed(terms: DataFrame) -> DataFrame:
    """(term, short, key): what is searched of each distinct term; terms without a key are found nowhere."""
    trimmed = F.regexp_replace("term", r"^\s+|\s+$", "")
    short = F.rlike(trimmed, F.lit(rf"^[A-Za-z0-9]{{1,{SHORT}}}$"))
    keyed = terms.where("term is not null").select("term").distinct().select("term", short.alias("short"), F.when(short, F.lower(trimmed)).otherwise(bare(trimmed)).alias("key"))
    return keyed.where("short or length(key) >= 2")


def _by_automaton(texts: DataFrame, terms: list, names: list[str]) -> DataFrame:
    """The pairs by one pass of an automaton over each text, and a look at its short words."""
    keys: dict[str, list[str]] = {}
    words: dict[str, list[str]] = {}
    for t in terms:
        (words if t.short else keys).setdefault(t.key, []).append(t.term)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key in keys:
            automaton.add_word(key, key)
        if keys:
            automaton.make_automaton()
        for batch in batches:
            text = pc.fill_null(batch.column(batch.num_columns - 1), "")
            hits, of = [], []
            runs = pc.split_pattern_regex(pc.ascii_lower(text), "[^a-z0-9]+") if words else None
            for i, whole in enumerate(bare_array(text).to_pylist()):
                found = {key for _, key in automaton.iter(whole)} if keys else set()
                got = [t for key in found for t in keys[key]]
                if words:
                    got += [t for w in set(runs[i].as_py()) & words.keys() for t in words[w]]
                hits += got
                of += [i] * len(got)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of, pa.int64())) for k in range(batch.num_columns - 1)), pa.array(hits, pa.string())], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in [*((f.name, f.dataType.simpleString()) for f in texts.schema.fields[:-1]), ("term", "string")])
    return texts.mapInArrow(find, schema)


def _by_join(texts: DataFrame, keyed: DataFrame, ids: list[str]) -> DataFrame:
    """The same by joins: a text's short words to short terms, its grams to each other term's rarest one, then verified.

    The grams of two and three characters come from one pass of a pattern, so a text costs as many rows as characters."""
    grams_of = lambda c, n: F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
    size = F.least(F.length("key"), F.lit(3))
    long = keyed.where("not short").select("term", "key", F.explode(F.array_distinct(F.when(size == 2, F.array("key")).otherwise(grams_of(F.col("key"), 3)))).alias("gram"))
    often = long.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = long.join(often, "gram").groupBy("term", "key").agg(F.min(F.struct("often", "gram"))["gram"].alias("gram"))
    plain = texts.select(*ids, bare(F.col("text")).alias("whole"), F.col("text"))
    held = plain.select(*ids, "whole", F.explode(F.array_distinct(F.concat(grams_of(F.col("whole"), 2), grams_of(F.col("whole"), 3)))).alias("gram"))
    by_gram = held.join(rarest, "gram").where(F.contains("whole", "key")).select(*ids, "term")
    words = plain.select(*ids, F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("key"))
    return by_gram.unionByName(words.join(keyed.where("short").select("term", "key"), "key").select(*ids, "term"))


def terms_in(texts: DataFrame, terms: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, term) for each text (ids, text) and each distinct term (term) that it holds by ``word_in``.

    A row of ``texts`` gives each of its terms once. A null text or term holds and is found nowhere."""
    keyed = _keyed(terms)
    if (keyed.agg(F.sum(F.octet_length("key") + F.octet_length("term"))).first()[0] or 0) <= TERM_BYTES:
        return _by_automaton(texts.select(*ids, F.col("text").cast("string")), keyed.collect(), [*ids, "term"])
    return _by_join(texts.select(*ids, F.coalesce("text", F.lit("")).alias("text")), keyed, ids)


def longest_terms(texts: DataFrame, terms: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, leak): of the terms that a text holds the longest, of equally long ones the first."""
    return terms_in(texts, terms, ids).groupBy(*ids).agg(F.min_by("term", F.struct(-F.length("term"), "term")).alias("leak"))


_BARE = r"regexp_replace(lower(nfc_normalize({})), '[\s\p{{Z}}\p{{P}}\p{{S}}]', '', 'g')"


@query(f"""
WITH t AS (SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT regexp_extract(text, '^\\S+') FROM benchmark UNION ALL SELECT regexp_extract(text, '^\\S+\\s+\\S+') FROM benchmark UNION ALL
    SELECT regexp_extract(text, '\\S+$') FROM benchmark UNION ALL SELECT unnest(['PE', '肺栓塞', 'COPD'])) WHERE term <> ''),
k AS (SELECT term, lower(trim(term)) AS word, regexp_matches(trim(term), '^[A-Za-z0-9]{{1,4}}$') AS short, {_BARE.format('trim(term)')} AS key FROM t),
c AS (SELECT conv_id, turn, role, {_BARE.format('text')} AS whole, string_split_regex(lower(text), '[^a-z0-9]+') AS words FROM conversations)
SELECT conv_id, turn, role, (SELECT term FROM k WHERE CASE WHEN short THEN list_contains(words, word) ELSE length(key) >= 2 AND contains(whole, key) END ORDER BY length(term) DESC, term LIMIT 1) AS leak FROM c""")
def leak_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of all terms that a text gives away: names of parts, and how benchmark items begin and end."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    text = F.col("text")
    ends = F.array(*(F.regexp_extract(text, p, 0) for p in (r"^\S+", r"^\S+\s+\S+", r"\S+$")), F.lit("PE"), F.lit("肺栓塞"), F.lit("COPD"))
    terms = scan(spark, sf_dir, "part", F.col("p_name").alias("term")).union(scan(spark, sf_dir, "benchmark", "text").select(F.explode(ends)))
    best = longest_terms(c.select("conv_id", "turn", "text"), terms.where("term != ''"), ["conv_id", "turn"])
    return c.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "leak")


def term_method(content: Column, term: Column, synonyms: Column) -> Column:
    """How a text holds a term: ``exact`` (case doesn't count), ``normalized`` (letters, digits and parentheses only),
    ``synonym`` (one of an array of other names, normalised), ``not_found``; ``no_content`` if either is empty."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}()]", "")
    held = lambda t: F.contains(plain(content), plain(t))
    empty = (F.coalesce(content, F.lit("")) == "") | (F.coalesce(term, F.lit("")) == "")
    by_name = F.exists(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: F.coalesce(held(s), F.lit(False)))
    return F.when(empty, "no_content").when(F.contains(F.lower(content), F.lower(term)), "exact").when(held(term), "normalized").when(by_name, "synonym").otherwise("not_found")


def quotes(docs: DataFrame, items: DataFrame, head: int = 5) -> DataFrame:
    """(doc_id, item_id) where the words of a whole item (item_id, text) stand one after another in a document (doc_id, text).

    Items are found by the hash of their first ``head`` words (or fewer) among the documents' windows of as many
    words, then compared whole."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    hashed = lambda k, parts: F.xxhash64(F.lit(k), F.array_join(parts, " "))
    i = items.select("item_id", words(F.col("text")).alias("iw")).where("size(iw) > 0").withColumn("k", F.least(F.size("iw"), F.lit(head)))
    widths = [r.k for r in i.select("k").distinct().collect()]  # at most ``head`` numbers
    x = F.lit(None).cast("long")
    for k in widths:
        x = F.when(F.col("k") == k, hashed(k, F.slice("iw", 1, k))).otherwise(x)
    i = i.select("item_id", F.array_join("iw", " ").alias("item"), x.alias("x"))
    d = docs.select("doc_id", words(F.col("text")).alias("dw"))

    def windows(k: int) -> Column:
        # neighbours zipped, so that each window is made in one step
        joined = F.col("dw")
        for n in range(1, k):
            joined = F.zip_with(joined, F.slice("dw", F.lit(n + 1), F.size("dw")), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.transform(F.filter(joined, lambda w: w.isNotNull()), lambda w: F.xxhash64(F.lit(k), w))

    none = F.array().cast("array<long>")
    seen = d.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(none, *map(windows, widths))))).alias("x"))
    pairs = seen.join(i, "x").select("doc_id", "item_id", "item").distinct()
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    whole = docs.select("doc_id", spaced(F.array_join(words(F.col("text")), " ")).alias("whole"))
    return pairs.join(whole, "doc_id").where(F.contains("whole", spaced(F.col("item")))).select("doc_id", "item_id").distinct()


@query(r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+'), ' ') || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+'), ' ') || ' ' AS t FROM benchmark)
SELECT b.item_id, count(d.doc_id) AS n_docs, min(d.doc_id) AS first_doc FROM b LEFT JOIN d ON contains(d.t, b.t) GROUP BY b.item_id""")
def quoted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold an item's whole text, word for word, and the first of them."""
    b = scan(spark, sf_dir, "benchmark", "item_id", "text")
    found = quotes(scan(spark, sf_dir, "documents", "doc_id", "text"), b)
    return b.select("item_id").join(found, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


__all__ = ["leak_terms", "longest_terms", "quoted_items", "quotes", "term_method", "terms_in", "word_in"]
