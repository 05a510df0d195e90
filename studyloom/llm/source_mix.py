"""6. Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of a seeded hash, form blocks of ``block_chars`` characters. With
weight w = share / period, block j (from 1) of a source is released at floor((j - 1) / w) and due at
ceil(j / w); in every slot the released block with the earliest deadline goes next (ties: the source with
the larger share, then by name). The shares add up to the period, so every deadline is met and each
source is at any time less than one block from its target.

Releases and deadlines repeat every period, so the order of one period's slots, a table of ``period``
rows that does not depend on the data's size, gives every block's slot by a join. Cumulative sizes within a
source are prefix sums in two steps, over ranges of the hash of bounded size and over the ranges' totals,
so no task holds a source, however large.

Every document is placed: slots go on after a source ends, so the remaining ones keep their relative
order. ``on_target`` is true in the slots before the first source ends, where the targets hold.

A document belongs to the block in which its first character falls. One longer than a block covers those that follow
without a document of their own: their slots are empty, and the source is ahead of its target by the document's
length until they have passed, so the bound in characters is one block and one document.

Defined results: a null source is a source of its own; null text has size 0; rows that repeat
id, text and source share a place; extra columns pass through and those named as a result give way; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

BLOCK_CHARS, PERIOD, TEMPERATURE, RANGE_ROWS = 20_000, 1000, 0.5, 2_000
MAX_SOURCES = 100_000


def shares(sizes: dict, period: int = PERIOD, temperature: float = TEMPERATURE, weights: dict | None = None) -> dict:
    """Whole shares of the period, at least 1 each, by largest remainders: of ``weights`` or of size ** temperature."""
    missing = [s for s in sizes if weights and s not in weights]
    if missing:
        raise ValueError(f"no weight for {len(missing)} sources, such as {missing[0]!r}")
    raw = {s: float(weights[s] if weights else max(1, n) ** temperature) for s, n in sizes.items()}
    if any(w <= 0 for w in raw.values()):
        raise ValueError("weights must be positive")
    total, room = sum(raw.values()), period - len(raw)
    if room < 0:
        raise ValueError(f"more sources than the {period} slots of a period")
    exact = {s: room * w / total for s, w in raw.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(share: dict) -> list[tuple[int, object, int, int, int]]:
    """(slot, source, j, release, deadline) of one period: earliest deadline first among released blocks."""
    import heapq

    period = sum(share.values())
    rank = {s: i for i, s in enumerate(sorted(share, key=lambda s: (-share[s], s is not None, str(s))))}
    waiting = [[] for _ in range(period)]
    for s, w in share.items():
        for j in range(1, w + 1):
            waiting[(j - 1) * period // w].append((-(-j * period // w), rank[s], j, s))
    ready, out = [], []
    for slot in range(period):
        for x in waiting[slot]:
            heapq.heappush(ready, x)
        deadline, _, j, s = heapq.heappop(ready)
        out.append((slot, s, j, (j - 1) * period // share[s], deadline))
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, period: int = PERIOD, temperature: float = TEMPERATURE, block_chars: int = BLOCK_CHARS, seed: int = 17) -> DataFrame:
    """``docs`` with block (from 1), slot, release, deadline, position (order within the slot) and on_target."""
    spark = docs.sparkSession
    new = ("block", "slot", "release", "deadline", "position", "on_target")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    sized = docs.select(F.col(source_col).alias("s"), key.alias("h"), F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("c"))
    totals = {r.s: r for r in sized.groupBy("s").agg(F.count("*").alias("n"), F.sum("c").alias("c")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError("too many sources")
    period = max(period, 4 * len(totals))
    share = shares({s: r.c for s, r in totals.items()}, period, temperature, weights) if totals else {}
    plan = [(s, int(r.n), max(1, -(-r.n // RANGE_ROWS)), share[s]) for s, r in totals.items()]
    sources = F.broadcast(spark.createDataFrame(plan, f"s1 {docs.schema[source_col].dataType.simpleString()}, n long, ranges long, share long"))

    # prefix sums: (source, range of the hash) first, then the ranges' totals
    slices = F.floor((F.col("h") / F.lit(2.0**63)) * F.col("ranges")).cast("long")
    ranged = sized.groupBy("s", "h").agg(F.sum("c").alias("c"), F.count("*").alias("k")).join(sources, F.col("s").eqNullSafe(F.col("s1"))).select("s", "h", "c", "k", slices.alias("g"))
    ranged = written(ranged, "ranged")
    by_range = ranged.groupBy("s", "g").agg(F.sum("c").alias("gc"), F.sum("k").alias("gk"))
    before = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select(F.col("s").alias("s2"), F.col("g").alias("g2"), F.coalesce(F.sum("gc").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "g").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("s", "g", "h", F.coalesce(F.sum("c").over(inside), F.lit(0)).alias("local"))
    placed = placed.join(offsets, F.col("s").eqNullSafe(F.col("s2")) & (F.col("g") == F.col("g2"))).select("s", "h", (F.col("base") + F.col("local")).alias("at"))

    kind = docs.schema[source_col].dataType.simpleString()
    cycle = one_period(share) if share else []
    slot_of = {(s, j): slot for slot, s, j, _, _ in cycle}
    slots = F.broadcast(spark.createDataFrame([(s, j, slot, r, d) for slot, s, j, r, d in cycle], f"s3 {kind}, j3 long, at_slot long, r long, d long"))
    weights_of = F.broadcast(spark.createDataFrame(list(share.items()), f"s4 {kind}, share long"))
    numbered = placed.withColumn("block", F.floor(F.col("at") / block_chars) + 1).join(weights_of, F.col("s").eqNullSafe(F.col("s4")))
    numbered = numbered.withColumn("round", F.floor((F.col("block") - 1) / F.col("share"))).withColumn("j", F.col("block") - F.col("round") * F.col("share"))
    ends = []
    for s, r in totals.items():  # the slot of each source's last block
        rounds, j = divmod(max(0, r.c - 1) // block_chars, share[s])
        ends.append(rounds * period + slot_of[s, j + 1])
    horizon = min(ends, default=0)
    scheduled = numbered.join(slots, F.col("s").eqNullSafe(F.col("s3")) & (F.col("j") == F.col("j3")))
    when = F.col("round") * F.lit(period)
    scheduled = scheduled.select(
        F.col("s").alias("__s"), F.col("h").alias("__h"), "block", (when + F.col("at_slot")).alias("slot"), (when + F.col("r")).alias("release"), (when + F.col("d")).alias("deadline"),
        (F.col("at") - (F.col("block") - 1) * block_chars).alias("position"), (when + F.col("at_slot") <= horizon).alias("on_target"),
    )
    keyed = docs.withColumn("__k", key)
    return keyed.join(scheduled, (F.col("__k") == F.col("__h")) & F.col(source_col).eqNullSafe(F.col("__s"))).drop("__k", "__h", "__s")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "block", "slot", "release", "deadline", "position", "on_target")
