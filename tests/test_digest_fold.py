"""Digests are folded by row, not by nested lambdas over arrays."""

from studyloom.operators import texts


def test_digest_of_odd_texts(spark):
    long = "the result " + "x" * 50 + ", " + "y" * 40 + " 7."
    rows = [(0, None), (1, ""), (2, "  \n. "), (3, f"Short. {long} {long}! A definition of 1 thing. \U0001f600\U0001f600\U0001f600 because of it!"), (4, "history " * 4 + ". plain words here today." * 9)]
    docs = spark.createDataFrame(rows, "i int, text string")
    out = docs.select("i", texts.digest(docs.text).alias("d"))
    got = {r.i: r.d for r in out.collect()}
    assert got[0] is None and got[1] == got[2] == []
    assert got[3] == ["Short.", "the result " + "x" * 50, "A definition of 1 thing.", "\U0001f600\U0001f600\U0001f600 because of it!"]
    assert got[4] == ["plain words here today."]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "forall(" not in plan and "aggregate(" not in plan


def test_points_beyond_the_last_are_not_compared():
    assert texts._fresh(["abcdefgh", "abcdefgh!", "zzzzyyyy", None], 6, 0.68, 2) == ["abcdefgh", "zzzzyyyy"]
