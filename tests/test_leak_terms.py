"""Terms beyond the first 10,000 are searched too."""

from studyloom.plans.catalog import QUERIES


def test_all_terms_are_searched(spark, tmp_path):
    spark.range(10_100).selectExpr("id as p_partkey", "concat('term number ', id, '.') as p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, 0, "user", f"it says TERM number {k}. here") for k in range(0, 10_100, 300)] + [(20_000, 0, "user", None), (20_001, 0, "user", "nothing")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.leak for r in QUERIES["leak_terms"](spark, str(tmp_path)).collect()}
    assert got == {k: f"term number {k}." if k < 20_000 else None for k, *_ in rows}
