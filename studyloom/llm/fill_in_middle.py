r"""13. Fill-in-the-middle: texts cut into prefix, middle and suffix and rearranged, with DataFrame and SQL functions only.

``regexp_extract_all`` makes the array of a text's units (code points, or what ``unit`` matches left to right). So
that an array does not hold a long text unit by unit, it is made in two steps: the text into pieces of BLOCK
units, and the two pieces in which a cut falls into units. ``slice`` and ``array_join`` build the three parts from
pieces and units. Cuts and form come from the digest of ``<seed>:<id>``, so they don't depend on the order of rows, and
no shuffle is needed.

With n units the prefix ends after the smaller and the middle after the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)``.
Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``, ``plain`` the text itself. A text is plain
if it is empty or holds one of the sentinels, or for PLAIN percent of ids; of the others SPM percent are spm.
``restore`` parses the sentinels and rebuilds the text. No text of a rearranged form holds a sentinel, and
a sentinel cannot begin in one part and end in the next, so the parse is exact.

Defined results: null text counts as empty, so it is plain and its output is empty; rows with a null id are hashed
as ``<seed>:``; repeated ids are cut by the same hashes; a text in which ``unit`` leaves gaps is plain, so that nothing is
lost, and its n null; an empty table gives an empty result; other columns pass through, those named as a result give way, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prefix_for, table

SEED, PLAIN, SPM = "1", 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A code point.
UNIT = "(?s)."
#: Units in one piece.
BLOCK = 1024


def _units(text: Column, unit: str) -> Column:
    return F.regexp_extract_all(text, F.lit(unit), F.lit(0))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output."""
    h = prefix_for(docs)
    new = {"n", "form", "prefix_chars", "middle_chars", "output"}
    kept = [c for c in docs.columns if c.lower() not in new]
    col = lambda c: F.col(f"`{h}{c}`")

    def add(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({h + k: v for k, v in columns.items()})

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(col("sha"), 8 * k + 1, 8), 16, 10).cast("long")
    out = add(docs, text=F.coalesce(F.col(text_col), F.lit("")), sha=digest)
    out = add(out, pieces=_units(col("text"), f"(?:{unit}){{1,{BLOCK}}}"))
    full = F.greatest(F.size(col("pieces")) - 1, F.lit(0))
    out = add(out, n=(full * BLOCK + F.size(_units(F.coalesce(F.get(col("pieces"), full), F.lit("")), unit))).cast("long"))
    out = add(out, x=group(0) % (col("n") + 1), y=group(1) % (col("n") + 1))
    out = add(out, a=F.least(col("x"), col("y")), b=F.greatest(col("x"), col("y")))
    spoken = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        spoken = spoken | F.contains(col("text"), F.lit(mark))
    whole = F.lit(True) if unit == UNIT else F.array_join(col("pieces"), "") == col("text")
    is_plain = (col("text") == "") | spoken | (group(2) % 100 >= 100 - plain) | ~whole
    out = add(out, form=F.when(is_plain, "plain").when(group(3) % 100 < spm, "spm").otherwise("psm"))

    # piece and unit in it of each cut, and that piece's units
    at = lambda c: (col(c) / F.lit(BLOCK)).cast("int")
    out = add(out, pa=at("a"), pb=at("b"), ua=(col("a") % BLOCK).cast("int"), ub=(col("b") % BLOCK).cast("int"))
    out = add(out, **{f"in{c}": _units(F.coalesce(F.get(col("pieces"), col(f"p{c}")), F.lit("")), unit) for c in "ab"})
    joined = lambda array, start, length: F.array_join(F.slice(array, start, length), "")
    after = lambda array, place: joined(col(array), place + 1, F.size(col(array)))
    same = col("pa") == col("pb")
    out = add(
        out,
        prefix=F.concat(joined(col("pieces"), F.lit(1), col("pa")), joined(col("ina"), F.lit(1), col("ua"))),
        middle=F.when(same, joined(col("ina"), col("ua") + 1, col("ub") - col("ua"))).otherwise(
            F.concat(after("ina", col("ua")), joined(col("pieces"), col("pa") + 2, F.greatest(col("pb") - col("pa") - 1, F.lit(0))), joined(col("inb"), F.lit(1), col("ub")))
        ),
        suffix=F.concat(after("inb", col("ub")), after("pieces", col("pb") + 1)),
    )
    parts = {"psm": ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")), "spm": ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle"))}
    output = F.when(col("form") == "plain", col("text"))
    for form, order in parts.items():
        output = output.when(col("form") == form, F.concat(*(x for mark, part in order for x in (F.lit(mark), col(part)))))
    chars = lambda part: F.when(col("form") != "plain", F.char_length(col(part)).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in kept), F.when(whole, col("n")).alias("n"), col("form").alias("form"), chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    first = lambda text, mark: F.substring_index(text, mark, 1)
    last = lambda text, mark: F.substring_index(text, mark, -1)
    head, middle = first(output, MIDDLE), last(output, MIDDLE)
    prefix = F.when(form == "psm", last(first(head, SUFFIX), PREFIX)).otherwise(last(head, PREFIX))
    suffix = F.when(form == "psm", last(head, SUFFIX)).otherwise(last(first(head, PREFIX), SUFFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
c AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS x, ('0x' || s[9:16])::BIGINT % (n + 1) AS y, ('0x' || s[17:24])::BIGINT % 100 AS r, ('0x' || s[25:32])::BIGINT % 100 AS o FROM h),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r >= {100 - PLAIN} THEN 'plain' WHEN o < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p"""
