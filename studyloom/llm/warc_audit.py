"""4. WARC: Merkle fixity audit of replicas.

A record's leaf is the SHA-256 of its offset, length and bytes. Above the leaves, a file's records are
grouped by ordered offset ranges (64 KiB, 1 MiB, 16 MiB, 256 MiB by the record's start, then the file), and files
by ranges of their numbers up to the root; a node is the SHA-256 of its children's keys and digests in
order. Replicas are compared at the root, and each level below is read only under nodes that differ,
so what is compared follows the damage and not the archive.

All levels are grouped aggregations of bounded groups: a range holds the records that start in it, a
node above has at most FANOUT children. Layout (offsets) is a running sum within a file; files are
filled by a hash of the id, so that none is larger than its share.

Defined results: a null body is a record with an empty block; a null id is a record like others; repeated
rows are records of their own, in a fixed order (equal ones can't be told apart); records missing
from or added to a replica are reported as such; no records, no rows; two empty replicas are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, table, written

#: Bytes of the offset ranges, each a multiple of the one before.
RANGES = (1 << 16, 1 << 20, 1 << 24, 1 << 28)
FANOUT = 64
FILE_BYTES = 16 << 20


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, record): each row as the bytes of a WARC/1.1 resource record."""
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(id_col).alias("id"), F.concat(F.encode(head, "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def layout(records: DataFrame, n_files: int, copy: str | None = None) -> DataFrame:
    """(file, offset, length, digest, id) of the records as ``n_files`` files hold them; the bytes aren't moved.

    With ``copy``, a column of a second replica's bytes at the same places, also copy_length and copy_digest."""
    digests = [("length", F.octet_length("record").cast("long")), ("digest", F.sha2("record", 256))]
    if copy:
        digests += [("copy_length", F.octet_length(copy).cast("long")), ("copy_digest", F.sha2(copy, 256))]
    small = records.select("id", *(c.alias(name) for name, c in digests))
    filed = small.withColumn("file", F.pmod(F.xxhash64("id", "digest"), F.lit(n_files)))
    order = Window.partitionBy("file").orderBy("id", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def file_count(records: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files of about ``file_bytes`` for all records."""
    return max(1, -(-(records.agg(F.sum(F.octet_length("record").cast("long"))).first()[0] or 0) // file_bytes))


def _node():
    child = F.transform(F.array_sort(F.collect_list(F.struct("child", "digest"))), lambda x: F.concat_ws(":", x["child"].cast("string"), x["digest"]))
    return F.sha2(F.array_join(child, "\n"), 256).alias("digest")


def merkle_levels(laid: DataFrame, n_files: int) -> list[DataFrame]:
    """The tree's levels from the leaves up, each (file, child, digest): ``child`` is the node's number in its file.

    Levels above the files have ``file`` as the group's number and child = 0."""
    leaves = laid.groupBy("file", F.col("offset").alias("child")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("length").cast("string"), "digest"))), ","), 256).alias("digest"))
    out, below = [leaves], 1
    for size in RANGES:
        out.append(out[-1].groupBy("file", F.floor(F.col("child") / (size // below)).alias("parent")).agg(_node()).withColumnRenamed("parent", "child"))
        below = size
    out.append(out[-1].groupBy("file").agg(_node()).select("file", F.lit(0).cast("long").alias("child"), "digest"))
    groups = n_files
    while groups > 1:
        groups = -(-groups // FANOUT)
        up = out[-1].select(F.floor(F.col("file") / FANOUT).alias("up"), F.col("file").alias("child"), "digest")
        out.append(up.groupBy("up").agg(_node()).select(F.col("up").alias("file"), F.lit(0).cast("long").alias("child"), "digest"))
    return out


def _parent(level: int) -> list:
    """Columns (file, child) of a node's parent, by the number of the node's level."""
    if level == 0:
        return [F.col("file"), F.floor(F.col("child") / RANGES[0]).alias("child")]
    if level < len(RANGES):
        return [F.col("file"), F.floor(F.col("child") / (RANGES[level] // RANGES[level - 1])).alias("child")]
    if level == len(RANGES):
        return [F.col("file"), F.lit(0).cast("long").alias("child")]
    return [F.floor(F.col("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("child")]


def audit(a: DataFrame, b: DataFrame, n_files: int) -> tuple[DataFrame, list[int]]:
    """Differences of two laid-out replicas: (file, offset, status), and how many nodes differ by level, root first.

    status: damaged, missing (from b) or added (in b)."""
    ta, tb = merkle_levels(a, n_files), merkle_levels(b, n_files)
    ta, tb = ([written(x, "merkle") for x in t] for t in (ta, tb))
    found, counts = None, []
    for level in range(len(ta) - 1, -1, -1):
        x, y = ta[level], tb[level]
        if found is not None:
            parents = found.select(F.col("file").alias("pf"), F.col("child").alias("pc"))
            pf, pc = _parent(level)
            x, y = (t.withColumn("f_", pf).withColumn("c_", pc).join(parents, (F.col("f_") == F.col("pf")) & (F.col("c_") == F.col("pc")), "left_semi").drop("f_", "c_") for t in (x, y))
        diff = x.withColumnRenamed("digest", "da").join(y.withColumnRenamed("digest", "db"), ["file", "child"], "full_outer").where(~F.col("da").eqNullSafe(F.col("db")))
        status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "added").otherwise("damaged")
        found = written(diff.select("file", "child", status.alias("status")), "differing")
        counts.append(found.count())
        if not counts[-1]:
            break
    for t in ta + tb:
        forget(t)
    return found.select("file", F.col("child").alias("offset"), "status"), counts


def damaged(every: int = 97) -> F.Column:
    """The bytes of a replica in which records whose id is divisible by ``every`` have their last body byte replaced (a test's damage)."""
    flipped = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit(b"\x00"), F.expr("substring(record, length(record) - 3, 4)"))
    return F.when((F.col("id") % every == 0) & (F.octet_length("record") > 5), flipped).otherwise(F.col("record"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record with its place in the archive and what an audit of a damaged copy finds there."""
    records = warc_records(table(spark, sf_dir, "pages"))
    n_files = file_count(records)
    laid = written(layout(records.withColumn("copy", damaged()), n_files, "copy"), "laid")
    replica = laid.select("file", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    found, _ = audit(laid, replica, n_files)
    out = laid.join(found, ["file", "offset"], "left")
    return out.select(F.col("id").alias("page_id"), F.col("length").alias("record_bytes"), F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages)
SELECT page_id, CAST(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256, CASE WHEN page_id % 97 = 0 THEN 'damaged' ELSE 'intact' END AS status FROM r
"""
