"""Items that share an id and items without one, against the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from studyloom.llm.decontaminate import SQL, decontaminate

ITEMS = [
    (1, "zeta the last text of this id has quite a number of words in it"),
    (1, "alpha the first text of this id has other words that nobody repeats at all"),
    (1, "alpha the first text of this id has other words that nobody repeats at all"),
    (2, "an item with another id and one text of its own to be found here"),
    (None, "an item that has no id is found by its words and only counted as one"),
    (None, "a second item without an id stands in the same benchmark with these words"),
]
DOCS = [(1, f"before {ITEMS[0][1]} after"), (2, f"{ITEMS[1][1]} and {ITEMS[0][1]}"), (3, f"{ITEMS[4][1]}. {ITEMS[5][1]}"), (4, f"{ITEMS[5][1]} {ITEMS[3][1]}"), (5, "clean"), (6, None)]


@pytest.mark.parametrize("limit", [1 << 20, 80])
def test_equals_sql(spark, limit):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs, items, limit=limit).select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated", "hit_items", "longest_item")
    got = {r.doc_id: r for r in out.collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", DOCS)
    con.executemany("insert into benchmark values (?, ?)", ITEMS)
    assert sorted(tuple(r)[:6] for r in got.values()) == sorted(con.execute(SQL).fetchall())
    assert [got[i].hit_items for i in range(1, 7)] == [["1"], ["1"], [None], ["2", None], [], []]
    assert got[1].longest_item == "1" and got[3].longest_item is None
