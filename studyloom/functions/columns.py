"""Column helpers: rounding, text normalisation, similarity, ids, bit masks, vectors, chunks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Full-width forms and their half-width counterparts.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a lambda computes what it refers to for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def half_up(x: Column) -> Column:
    """Round half toward positive infinity, to a whole number."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage, 0 for an empty whole."""
    return F.when(whole > 0, half_up(part * F.lit(100.0) / whole)).otherwise(F.lit(0)).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def or_else(x: Column, default: str) -> Column:
    """The text, or ``default`` where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def no_space(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


#: Characters that don't count in names, as ranges of a pattern: CJK and typographic punctuation, blanks, - and _.
UNCOUNTED = r"[\u3000-\u303F\uFF5F-\uFF65\u2018-\u201F\u2026\u2014\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\uFEFF_-]+"


def normalised(x: Column) -> Column:
    """Full-width forms folded to half-width, CJK and typographic punctuation, blanks, hyphens and underscores
    removed, lower case."""
    return F.lower(F.regexp_replace(F.translate(x, FULL_WIDTH, HALF_WIDTH), UNCOUNTED, ""))


def title_key(x: Column) -> Column:
    """A heading without blanks, bracketed parts and the ordinal of a chapter, section or part in front, lower case."""
    plain = F.regexp_replace(no_space(x), r"[（(].*?[)）]", "")
    return F.lower(F.regexp_replace(plain, r"^第[一二三四五六七八九十百千万零\d]+[章节篇]", ""))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def fuzzy_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Equal, one inside the other, or similar beyond ``least``; false if either is empty."""
    filled = (F.length(a) > 0) & (F.length(b) > 0)
    longer = F.greatest(F.length(a), F.length(b))
    # edits are counted only as far as they leave the texts similar; beyond that there are -1
    edits = F.call_function("levenshtein", a, b, (F.floor(longer * F.lit(1 - least)) + 1).cast("int"))
    near = let(edits, lambda n: (n >= 0) & (1.0 - n / longer > least))
    return filled & ((a == b) | F.contains(a, b) | F.contains(b, a) | near)


def bigrams(x: Column) -> Column:
    """The distinct pairs of neighbouring characters (none below two characters)."""
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def bigram_similarity(a: Column, b: Column) -> Column:
    """Bigram Jaccard, or the length ratio if one text holds the other."""
    inside = F.contains(a, b) | F.contains(b, a)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when(inside & (F.length(a) > 0) & (F.length(b) > 0), ratio).otherwise(jaccard(bigrams(a), bigrams(b)))


def stable_id(parts: Sequence[Column], prefix: str = "", size: int = 20) -> Column:
    """A prefix and the first hex digits of the SHA-256 of the parts, joined by NUL; null parts are empty."""
    joined = F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, size))


def sentences(x: Column) -> Column:
    """Sentences with their end mark; blank ones dropped."""
    return F.filter(F.split(x, r"(?<=[。！？；\n.!?;])"), lambda s: F.trim(s) != "")


def bare_array(x: pa.Array) -> pa.Array:
    """Texts in compatibility form (NFKC), lower case, without blanks, punctuation and symbols."""
    composed = pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())
    return pc.replace_substring_regex(pc.utf8_lower(composed), r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{FEFF}\p{Z}\p{P}\p{S}]", "")


@F.arrow_udf(T.StringType())
def bare(x: pa.Array) -> pa.Array:
    """``bare_array`` as a column; no built-in function normalises to NFKC."""
    return bare_array(x)


def word_in(text: Column, term: Column) -> Column:
    """ASCII letters and digits up to 4 characters count at word bounds only, in any case; other terms anywhere once both
    are ``bare``, if two characters are left of them."""
    trimmed = F.regexp_replace(term, r"^\s+|\s+$", "")
    bounded = F.concat(F.lit("(?i)(^|[^a-z0-9])"), trimmed, F.lit("($|[^a-z0-9])"))
    key = bare(trimmed)
    return F.when(F.rlike(trimmed, F.lit("^[A-Za-z0-9]{1,4}$")), F.rlike(text, bounded)).otherwise((F.length(key) >= 2) & F.contains(bare(text), key))


def json_number(text: Column, path: str) -> Column:
    """A JSON field as a number, null if it is none."""
    return F.get_json_object(text, path).try_cast("double")


def json_in_text(text: Column) -> Column:
    """The span from the first brace to the last one, without code fences; null if it is no JSON object."""
    span = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(span, "$").isNotNull(), span)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable_vector(a: Column, size: int) -> Column:
    """Of the right length, finite and not all but zero."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(a) == size) & finite & (norm(a) >= 1e-6)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first (name, pattern) whose pattern is found in the text."""
    out = F.lit(None).cast("string") if default is None else F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(text, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def by_row(fold: Callable[[list[str]], list[str]], units: Column) -> Column:
    """An array of texts made from another by an order-dependent fold in plain Python, for a batch of rows at once."""

    def apply(column: pa.Array) -> pa.Array:
        return pa.array([None if u is None else fold([x for x in u if x is not None]) for u in column.to_pylist()], pa.list_(pa.string()))

    apply.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(apply, T.ArrayType(T.StringType()))(units)


def chunks(units: Column, limit: int, tail: int, least: int) -> Column:
    """Texts filled from ``units`` up to ``limit`` characters; each next one starts with the last ``tail``
    characters of the one before; those below ``least`` are dropped. Linear in the text."""

    def fold(parts: list[str]) -> list[str]:
        now, done = "", []
        for unit in parts:
            if now and len(now) + len(unit) > limit:
                done.append(now.strip(" "))
                now = (now[-tail:] if tail else "") + unit
            else:
                now += unit
        return [x for x in [*done, now.strip(" ")] if len(x) >= least]

    return by_row(fold, units)


def overlapping(units: Column, most: int, overlap: int) -> Column:
    """Texts filled from ``units`` up to ``most`` characters, each with the last ``overlap`` characters of the one before in front
    if that fits; a unit of over ``most`` is cut into pieces of as many that overlap as much."""

    def fold(parts: list[str]) -> list[str]:
        now, done = "", []
        for unit in parts:
            if len(unit) > most:
                done += [now] * bool(now)
                done += [p for i in range(0, len(unit), most - overlap) if (p := unit[i : i + most].strip())]
                now = ""
            elif now and len(now) + len(unit) > most:
                done.append(now)
                led = ((now[-overlap:] if overlap else "") + unit).strip()
                now = led if len(led) <= most else unit
            else:
                now += unit
        return [*done, now] if now else done

    return by_row(fold, units)


def by_paragraph(text: Column, most: int) -> Column:
    """A text, if it has over ``most`` characters its paragraphs filled up to as many, a longer paragraph in pieces."""

    def fold(parts: list[str]) -> list[str]:
        now, size, done = [], 0, []
        for p in parts:
            if now and (len(p) > most or size + 2 + len(p) > most):
                done.append("\n\n".join(now))
                now, size = [], 0
            if len(p) > most:
                done += [p[i : i + most] for i in range(0, len(p), most)]
            else:
                size += len(p) + 2 * bool(now)
                now.append(p)
        return [*done, "\n\n".join(now)] if now else done

    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.when(F.length(text) <= most, F.array(text)).otherwise(by_row(fold, paragraphs))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
