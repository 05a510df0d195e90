import hashlib

import pytest
from pyspark.sql import functions as F

from studyloom.llm import warc_audit
from studyloom.llm.warc_audit import FANOUT, RANGES, audit, damaged, file_count, layout, merkle_levels, warc_records

PAGES = "page_id long, url string, html string"


def pages(n=300):
    return [(i, f"http://h{i % 7}.org/{i}", f"<p>{'é' * (i % 50)} body {i}</p>" * (1 + i % 40)) for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_root(rows, n_files):
    """The root of rows of (file, offset, length, digest), built bottom-up on the driver."""
    leaves = {}
    for f, at, n, d in rows:
        leaves.setdefault((f, at), []).append(f"{n}:{d}")
    level, below = {k: sha(",".join(sorted(v))) for k, v in leaves.items()}, 1

    def up(level, parent):
        groups = {}
        for k, d in level.items():
            groups.setdefault(parent(k)[0], []).append((parent(k)[1], d))
        return {k: sha("\n".join(f"{c}:{d}" for c, d in sorted(v))) for k, v in groups.items()}

    for size in RANGES:
        step = size // below
        level, below = up(level, lambda k: ((k[0], k[1] // step), k[1])), size
    level = up(level, lambda k: ((k[0], 0), k[1]))
    while n_files > 1:
        n_files = -(-n_files // FANOUT)
        level = up(level, lambda k: ((k[0] // FANOUT, 0), k[0]))
    return level


@pytest.mark.parametrize("n_files", [1, 5, 70])
def test_tree_matches_brute_force(spark, n_files):
    laid = layout(warc_records(spark.createDataFrame(pages(), PAGES)), n_files).cache()
    rows = [(r.file, r.offset, r.length, r.digest) for r in laid.collect()]
    for f in range(n_files):  # a file's records lie one after another
        at = 0
        for _, offset, length, _ in sorted(r for r in rows if r[0] == f):
            assert offset == at
            at += length
    got = {(r.file, r.child): r.digest for r in merkle_levels(laid, n_files)[-1].collect()}
    assert got == brute_root(rows, n_files) and len(got) == 1


def test_records_are_warc_bytes(spark):
    got = {r.id: bytes(r.record) for r in warc_records(spark.createDataFrame([(1, "http://a\r\nX: y", "é\n"), (None, None, None)], PAGES)).collect()}
    assert got[1] == "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: http://a  X: y\r\nContent-Type: text/html\r\nContent-Length: 3\r\n\r\né\n\r\n\r\n".encode()
    assert got[None].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_audit_finds_what_differs_and_descends_only_there(spark):
    records = warc_records(spark.createDataFrame(pages(), PAGES))
    a = layout(records, 9).cache()
    places = {r.id: (r.file, r.offset) for r in a.collect()}
    b = a.where("id != 8").withColumn("digest", F.when(F.col("id").isin(17, 200), F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("digest")))
    b = b.unionByName(a.where("id = 5").withColumn("offset", F.lit(10**7).cast("long")))
    found, counts = audit(a, b, 9)
    got = {(r.file, r.offset): r.status for r in found.collect()}
    assert got == {places[17]: "damaged", places[200]: "damaged", places[8]: "missing", (places[5][0], 10**7): "added"}
    assert counts[0] == 1 and counts[1] <= 4 and counts[-1] == 4


def test_equal_replicas_stop_at_the_root(spark):
    a = layout(warc_records(spark.createDataFrame(pages(40), PAGES)), 3)
    found, counts = audit(a, a, 3)
    assert found.collect() == [] and counts == [0]


def test_edges(spark):
    rows = [(97, "u", "x"), (97, "u", "x"), (97, "v", "x"), (None, None, None), (None, None, None), (1, "", ""), (2, "u", "z" * 2_000_000), (0, None, None)]
    records = warc_records(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as ID", "2 as record", "3 as digest"))
    n = file_count(records, 1 << 20)
    laid = layout(records.withColumn("copy", damaged()), n, "copy").cache()
    assert laid.count() == len(rows)
    found, _ = audit(laid, laid.selectExpr("file", "offset", "copy_length as length", "copy_digest as digest"), n)
    status = laid.join(found, ["file", "offset"], "left").groupBy("id").agg(F.count("status").alias("k")).collect()
    assert {r.id: r.k for r in status} == {97: 3, None: 0, 1: 0, 2: 0, 0: 1}
    none = layout(warc_records(spark.createDataFrame([], PAGES)), file_count(warc_records(spark.createDataFrame([], PAGES))))
    found, counts = audit(none, none, 1)
    assert none.collect() == [] and found.collect() == [] and counts == [0]


def test_query_on_nulls_and_no_rows(spark, tmp_path):
    for name, rows in [("some", [(1, None, None), (97, "u", None), (None, "u", "x")]), ("none", [])]:
        spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = {r.page_id: r.status for r in warc_audit.op4_warc_audit(spark, f"{tmp_path}/{name}").collect()}
        assert got == ({1: "intact", 97: "damaged", None: "intact"} if rows else {})
