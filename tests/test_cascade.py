"""Deletes that go on to dependent tables."""

import pytest

from studyloom.operators.loads import cascade_delete

REFS = [("b", "a_id", "a", "id"), ("c", "b_id", "b", "id"), ("c", "a_id", "a", "id"), ("d", "c_id", "c", "id")]


def test_rows_that_refer_to_deleted_ones_go(spark):
    tables = {
        "a": spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, bad boolean"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 1)], "id int, a_id int"),
        "c": spark.createDataFrame([(20, 10, 2), (21, 11, 1), (22, 11, 3), (23, None, None), (24, 13, 1), (24, 13, 1)], "id int, b_id int, a_id int"),
        "d": spark.createDataFrame([(30, 20), (31, 22), (32, 99), (33, 24)], "id int, c_id int"),
        "e": spark.createDataFrame([(1,)], "id int"),
    }
    left = {t: sorted(r.id for r in df.collect()) for t, df in cascade_delete(tables, REFS, "a", "bad").items()}
    assert left == {"a": [2, 3], "b": [11, 12], "c": [22, 23], "d": [31, 32], "e": [1]}
    assert {t: df.count() for t, df in cascade_delete(tables, REFS, "b", "id > 12").items()} == {"a": 3, "b": 3, "c": 4, "d": 3, "e": 1}


def test_circles_are_an_error(spark):
    one = spark.createDataFrame([(1, 1)], "id int, p int")
    with pytest.raises(ValueError, match="a > b > a"):
        cascade_delete({"a": one, "b": one}, [("b", "p", "a", "id"), ("a", "p", "b", "id")], "a", "true")
