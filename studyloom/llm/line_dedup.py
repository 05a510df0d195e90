"""8. Line dedup: fuzzy lines by MinHash, with DataFrame and SQL functions only.

A line is compared trimmed and lower-cased, by the set of its shingles: SHINGLE characters from every
character on (a shorter line is one shingle). Two lines are near copies if the Jaccard similarity of their
sets is NUM / DEN or more.

1. Signatures. Lines explode to shingles and shrink again by hash aggregation to 9 minima per distinct
   line (minima don't mind repeats, so equal lines merge before the shuffle).
2. Banding. The 9 minima are the points of the affine plane of order 3, its 12 lines of 3 points each are
   the bands: lines of similarity 0.8 meet in one with probability 0.99, of 0.9 with 0.9995. Near copies share
   most of their bands, so buckets of the same members are one: a bucket's name is a digest of its members.
3. Verification. A line's sketch has a bit for each value of 11 bits of its shingles' hashes. Each bit in which
   two sketches differ stands for another shingle that one line has alone, so pairs with too many such bits
   are no links; the others are verified by exact Jaccard. In each bucket members are compared with one
   leader, the line that is most frequent (of near copies the least changed one). Where a bucket then still
   holds several components, first one line for each component is compared, then what is still apart.
4. Union-find as alternating star joins, then one line per component stays: its first occurrence by
   (id, line number).

Lines are shuffled to their buckets once, as two numbers each; a window that can spill counts a bucket's members. Shingles are compared by 64-bit hashes within a pair of lines, lines by 64-bit digests.

Defined results: blank lines stay and are compared with nothing; null text stays null; rows with a null id
keep all lines and cause no removal; rows equal in id and text are one document and keep the same lines;
rows that share an id but not the text are told apart by the text's digest; extra columns pass through
and those named as a result give way; no documents, no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_BYTES, hinted, small, table, written

SHINGLE, NUM, DEN = 8, 80, 100
#: 64-bit words of a sketch.
WORDS = 32
#: Shingles to a row where they are hashed.
STEP = 4
_BLANKS = " \t\r\f\u000b "
#: Bytes of a character in the encoding whose characters are all of one size.
_WIDE = 4


def _planes() -> list[list[int]]:
    """The 12 lines of the affine plane over the field of 3 elements, as points 3 x + y."""
    return [[3 * x + (m * x + c) % 3 for x in range(3)] for m in range(3) for c in range(3)] + [[3 * c + y for y in range(3)] for c in range(3)]


def _shingles(key) -> F.Column:
    """The distinct shingles' hashes of one line. The encoded line is bound to a variable, else it would be made for each shingle."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(key) - SHINGLE))
    of = lambda u: F.transform(places, lambda i: F.xxhash64(F.substring(u, _WIDE * i + 1, F.lit(_WIDE * SHINGLE))))
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(key, "UTF-32")), of)))


def _trimmed(line) -> F.Column:
    """The line without blanks around it. Trimming at the right walks through the whole line, so only lines that end in a blank are."""
    blank_end = reduce(lambda x, y: x | y, (F.endswith(line, F.lit(c)) for c in sorted(set(_BLANKS))))
    return F.ltrim(F.when(blank_end, F.rtrim(line, F.lit(_BLANKS))).otherwise(line), F.lit(_BLANKS))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, key, h): the non-blank lines of documents with an id; th and h digest the text and the key."""
    text = F.col(text_col)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))
    rows = texts.select("id", "th", F.posexplode("lines").alias("no", "line"))
    # blank lines go by their beginning: a filter on the key would make each key twice, once to test it
    keyed = rows.where(F.ltrim("line", F.lit(_BLANKS)) != "").select("id", "th", "no", F.lower(_trimmed(F.col("line"))).alias("key"))
    return keyed.withColumn("h", F.xxhash64("key"))


def _mask(i: int) -> int:
    """Multiples of the golden ratio as 31-bit integers, which spread over the whole range."""
    return (i * 0x9E3779B9 & 0xFFFFFFFF) >> 1


def _hashed(lines: DataFrame) -> DataFrame:
    """(h, places, first, x0 ...): for every STEP-th character of lines (h, key) the hashes of the shingles there and at the next ones."""
    wide = lines.select("h", F.encode("key", "UTF-32").alias("u"))
    wide = wide.select("h", "u", F.greatest(F.lit(0), (F.octet_length("u") / _WIDE).cast("int") - SHINGLE).alias("last"))
    each = wide.select("h", "u", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(STEP))).alias("i"))
    x = [F.xxhash64(F.substring("u", _WIDE * (F.least(F.col("i") + k, F.col("last")) if k else F.col("i")) + 1, F.lit(_WIDE * SHINGLE))) for k in range(STEP)]
    return each.select("h", (F.col("last") + 1).alias("places"), (F.col("i") == 0).alias("first"), *(x[k].alias(f"x{k}") for k in range(STEP)))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, n, p, m0 ...): distinct lines with their occurrences, minima and rank p as a leader: first by
    occurrences times length, then by hash."""
    # 5 permutations of one half of the hash and 4 of the other: exclusive or with masks
    halves = _hashed(lines).select("h", "first", *(f(F.col(f"x{k}")).cast("int").alias(f"{name}{k}") for k in range(STEP) for name, f in (("a", lambda x: x.bitwiseAND(0x7FFFFFFF)), ("b", lambda x: F.shiftrightunsigned(x, 33)))))
    least = [F.least(*(F.col(f"{'ab'[i % 2]}{k}").bitwiseXOR(_mask(i // 2)) for k in range(STEP))) for i in range(9)]
    minima = halves.groupBy("h").agg(F.count_if("first").alias("n"), F.count("*").alias("weight"), *(F.min(x).alias(f"m{i}") for i, x in enumerate(least)))
    rank = F.shiftleft(F.least("weight", F.lit((1 << 19) - 1)), 44).bitwiseOR(F.col("h").bitwiseAND((1 << 44) - 1))
    return minima.select("h", "n", rank.alias("p"), *(f"m{i}" for i in range(9)))


def sketches(keys: DataFrame) -> DataFrame:
    """(h, size, ones, words): of distinct lines (h, key) the sketch as an array of 64-bit words, its set bits, and the shingles' number or, as repeats
    don't show in a sketch, a bit more; where its bits are too few for that number, the exact one."""
    bits = _hashed(keys).select("h", "places", *(e for k in range(STEP) for e in (F.shiftrightunsigned(f"x{k}", 6).bitwiseAND(WORDS - 1).alias(f"word{k}"), F.expr(f"shiftleft(1L, cast(x{k} & 63 as int))").alias(f"bit{k}"))))
    word = lambda j: F.bit_or(reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col(f"word{k}") == j, F.col(f"bit{k}")).otherwise(0) for k in range(STEP))))
    drawn = bits.groupBy("h").agg(F.max("places").alias("places"), *(word(j).alias(f"w{j}") for j in range(WORDS)))
    drawn_bits = sum((F.bit_count(f"w{j}") for j in range(WORDS)), F.lit(0))
    expected = 64 * WORDS * (1 - F.exp(-F.col("places") / (64 * WORDS)))
    drawn = written(drawn.select("h", "places", (drawn_bits < 0.9 * expected).alias("few"), drawn_bits.alias("ones"), F.array(*(f"w{j}" for j in range(WORDS))).alias("words")), "drawn")
    few = drawn.where("few").select("h")
    light = F.broadcast if small(few, 64) else lambda df: df
    exact = keys.join(light(few), "h").select("h", F.size(_shingles(F.col("key"))).alias("exact"))
    return drawn.join(light(exact), "h", "left").select("h", F.coalesce("exact", "places").alias("size"), "ones", "words")


def banded(minima: DataFrame) -> DataFrame:
    """(b, h): each line in its bands' buckets. 48 bits tell buckets apart; where two fall together, more lines are compared."""
    keys = [F.xxhash64(F.lit(k), *(f"m{i}" for i in plane)).bitwiseAND((1 << 48) - 1) for k, plane in enumerate(_planes())]
    return minima.select("h", F.explode(F.array(*keys)).alias("b"))


def shared_buckets(minima: DataFrame) -> DataFrame:
    """(b, h): lines that share a bucket with another one. Buckets of the same members are one, b is their members' digest."""
    inside = Window.partitionBy("b")
    met = banded(minima).select("h", F.count("*").over(inside).alias("k"), F.bit_xor("h").over(inside).alias("members")).where("k > 1")
    return met.select(F.xxhash64("k", "members").alias("b"), "h").distinct()


def _met(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, near, many): the lines that matter, those in a bucket with another one or in several places;
    (b, h, p, buckets): the lines that share a bucket with another one, with their ranks and all such buckets."""
    minima = written(signatures(lines), "minima")
    shared = written(shared_buckets(minima), "shared")
    watch = minima.select("h", "n", "p").join(shared.select("h", F.lit(True).alias("near")).distinct(), "h", "left").where("near or n > 1")
    watch = written(watch.select("h", "p", F.coalesce("near", F.lit(False)).alias("near"), (F.col("n") > 1).alias("many")), "watch")
    met = shared.join(watch.where("near").select("h", "p"), "h").withColumn("buckets", F.collect_list("b").over(Window.partitionBy("h")))
    return watch.select("h", "near", "many"), written(met, "met")


def _fits(o, x, y, num: int, den: int) -> F.Column:
    """Whether an overlap o of sets of sizes x and y makes their similarity num / den or more."""
    return F.lit(den) * o >= F.lit(num) * (x + y - o)


def _similar(pairs: DataFrame, keys: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b), a written table, whose exact Jaccard similarity reaches num / den; keys: (h, key) of distinct lines."""
    light = F.broadcast if small(pairs, 128) else lambda df: df
    x = keys.select(F.col("h").alias("a"), "key").join(light(pairs), "a").select("a", "b", "key")
    # dealt out before the shingles are made, as these are larger than their line
    y = keys.join(light(pairs.select(F.col("b").alias("h")).distinct()), "h").repartition("h").select(F.col("h").alias("b"), _shingles(F.col("key")).alias("sb"))
    joined = x.join(y, "b").select("a", "b", _shingles(F.col("key")).alias("sa"), "sb")
    return joined.where(_fits(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), num, den)).select("a", "b")


def _able(x: str, y: str, num: int, den: int) -> F.Column:
    """Whether sketches leave it open that lines link: of sets of sizes a and b that do, at most
    (a + b) (den - num) / (den + num) elements are in one only. The numbers of set bits, which differ by no more than that, are compared first."""
    unlike = F.zip_with(f"{x}words", f"{y}words", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    apart = F.aggregate(unlike, F.lit(0), lambda n, k: n + k)
    most = F.lit(den - num) * (F.col(f"{x}size") + F.col(f"{y}size"))
    return (F.lit(den + num) * F.abs(F.col(f"{x}ones") - F.col(f"{y}ones")) <= most) & (F.lit(den + num) * apart <= most)


def _drawn(marks: DataFrame, k: str) -> DataFrame:
    """``marks`` with its columns named for one side of a pair."""
    return marks.select(*(F.col(c).alias(f"{k}{c}") for c in marks.columns))


def _apart(placed: DataFrame, done: F.Column) -> DataFrame:
    """The rows of buckets b that hold more than one component c and not only lines that are done."""
    split = placed.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_and(done).alias("all")).where("lo < hi and not all").select("b")
    return placed.join(split, "b")


def _between(placed: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of lines of one bucket and different components that their sketches allow, without those
    of two lines that are ``done`` (compared already in this bucket). Lines that share several buckets meet in the first of these."""
    full = placed.join(marks, "h")
    here = F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("x_b")
    met = _drawn(full, "x_").join(_drawn(full, "y_"), (F.col("x_b") == F.col("y_b")) & (F.col("x_c") < F.col("y_c")) & ~(F.col("x_done") & F.col("y_done")) & _able("x_", "y_", num, den) & here)
    return met.select(F.col("x_h").alias("a"), F.col("y_h").alias("b"))


def line_components(met: DataFrame, keys: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, root) of the distinct lines that are similar to another one, by digest.

    met: (b, h, p, buckets), a written table as _met gives it; keys: its lines' (h, key). A bucket's leader has met all
    others there in the first step, so that it is not compared in the later ones."""
    marks = written(sketches(keys), "sketches")
    led = written(met.join(met.groupBy("b").agg(F.max_by("h", "p").alias("lead")), "b").where("h != lead"), "led")
    near = led.select(F.col("h").alias("a"), F.col("lead").alias("b")).distinct()
    near = near.join(_drawn(marks, "x_"), F.col("a") == F.col("x_h")).join(_drawn(marks, "y_"), F.col("b") == F.col("y_h")).where(_able("x_", "y_", num, den)).select("a", "b")
    near = written(near, "near")
    tried = near.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    roots = written(components(_similar(near, keys, num, den)), "roots")
    placed = _apart(led.join(roots.withColumnRenamed("node", "h"), "h", "left").select("b", "h", "p", "buckets", F.coalesce("root", "h").alias("c")), F.lit(False))
    one = placed.groupBy("b", "c").agg(F.max("p").alias("most"))
    placed = written(placed.join(one, ["b", "c"]).select("b", "h", "buckets", "c", (F.col("p") == F.col("most")).alias("done")), "placed")
    for one_each in (True, False):
        some = placed.where("done").withColumn("done", F.lit(False)) if one_each else _apart(placed, F.col("done"))
        fresh = _between(some, marks, num, den).join(tried, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
        links = written(_similar(written(fresh, "between"), keys, num, den), "links")
        if links.isEmpty():
            continue
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(known.union(links)), "roots")
        again = roots.select(F.col("node").alias("h"), "root")
        placed = placed.join(again, "h", "left").select("b", "h", "buckets", F.coalesce("root", "c").alias("c"), "done")
    return roots


def components_of(lines: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, root) of the distinct lines (h, key) that are similar to another one, by digest."""
    return line_components(_met(lines)[1], lines.select("h", "key").dropDuplicates(["h"]), num, den)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, with n_lines (non-blank, before) and n_removed_lines."""
    lines = lines_of(docs, id_col, text_col)
    watch, met = _met(lines)
    places = lines.join(hinted(watch, 64), "h").withColumn("key", F.when(F.col("near"), F.col("key")))
    places = written(places, "places")
    keys = written(places.where("near").select("h", "key").dropDuplicates(["h"]), "keys")
    roots = line_components(met, keys, num, den)
    placed = places.select("h", "many", F.struct("id", "no", "th").alias("place")).join(roots.withColumnRenamed("node", "h"), "h", "left").where("many or root is not null")
    placed = placed.select("place", F.coalesce("root", "h").alias("root"))
    keep = placed.groupBy("root").agg(F.min("place").alias("keep"))
    repeats = placed.join(keep, "root").where("place != keep").select("place.id", "place.th", "place.no")
    drops = written(repeats.groupBy("id", "th").agg(F.collect_set("no").alias("gone")), "drops")
    size = drops.agg(F.sum(F.lit(64) + 4 * F.size("gone"))).first()[0] or 0
    drops = drops.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    if size <= BROADCAST_BYTES:
        drops = F.broadcast(drops)
    rows = docs.drop(*(c for c in docs.columns if c.lower() in ("n_lines", "n_removed_lines")))
    joined = rows.join(drops, (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__th")), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text_col), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    n_lines = F.size(F.filter(F.coalesce("__lines", F.array()), lambda x: F.ltrim(x, F.lit(_BLANKS)) != "")).cast("long")
    new = {"n_lines": n_lines, "n_removed_lines": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)}
    return joined.withColumns(new).drop("__id", "__th", "__gone", "__lines")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
