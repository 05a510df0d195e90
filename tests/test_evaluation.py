"""Outputs against a golden set, and names in order, by cases worked out by hand."""

from pyspark.sql import functions as F

from studyloom.operators import evaluation

SHAPE = "title string, must_have array<string>, forbidden array<string>, expected array<string>, synonyms map<string,array<string>>, content map<string,string>, relations array<string>, failed boolean"


def judged(spark, *rows):
    return evaluation.evaluate(spark.createDataFrame(rows, SHAPE))


def test_scores_and_errors(spark):
    full = ("a", ["Beta-Blocker", "ASA", "rest"], ["Opium", "x-ray"], ["r1", "r2"], {"ASA": ["Aspirin"]}, {"f": "betablocker, aspirin", "g": "opium and OPIUM", "h": "opium"}, ["r2"], False)
    empty = ("b", None, None, None, None, None, None, True)
    good = ("c", ["one"], [], ["r"], None, {"f": "has ONE."}, ["r", "s", "t", "u"], None)
    a, b, c = judged(spark, full, empty, good).orderBy("title").collect()
    assert [(d.term, d.found, d.method) for d in a.match_details] == [("Beta-Blocker", True, "normalized"), ("ASA", True, "synonym"), ("rest", False, "not_found")]
    assert (a.completeness, a.hallucination_risk, a.schema_compliance, a.relation_quality) == (66.7, 60.0, 1.0, 33.3)
    assert a.overall_score == round(66.7 * 0.35 + 60 * 0.3 + 0.2 + 33.3 * 0.15, 1)
    assert (a.errors.missing, a.errors.hallucination, a.errors.wrong_relation) == (["rest"], ["Opium"], ["r1"])
    assert (b.completeness, b.hallucination_risk, b.schema_compliance, b.relation_quality, b.overall_score) == (0.0, 100.0, 0.0, 0.0, 30.0)
    assert (c.completeness, c.relation_quality, c.errors.missing) == (100.0, 100.0, []) and c.match_details[0].matched == "has ONE."


def test_means_and_classes(spark):
    rows = [("a", ["x"], ["y"], ["r"], None, {"f": "y"}, [], False), ("b", ["x"], [], [], None, {"f": "x"}, [], False), ("c", ["x"], [], ["r"], None, {"f": "z"}, ["q"], True)]
    scored = judged(spark, *rows)
    assert evaluation.means(scored).first().completeness == 33.3
    assert {r["class"]: (r.n, r.titles) for r in evaluation.error_classes(scored, "title").collect()} == {"low_completeness": (2, ["a", "c"]), "hallucination": (1, ["a"]), "low_relation_quality": (2, ["a", "c"])}


def test_longer_side_is_cut(spark):
    golden = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "place int, title string")
    outputs = spark.createDataFrame([(0, "x"), (1, "y")], "place int, text string")
    assert [r.title for r in evaluation.paired(outputs, golden, ["place"]).orderBy("place").collect()] == ["a", "b"]


def test_names_in_reading_order(spark):
    names = ["第十篇 乙", "第二篇 甲", "第十一篇", "没有", "第一篇", "第二篇 阿", "第二十篇", "北京", "第九篇 x", "安徽"]
    rows = evaluation.in_reading_order(spark.createDataFrame([(n, 1) for n in names], "name string, g int"), "name", ["g"]).orderBy("place").collect()
    assert [(r.name, r.weight) for r in rows] == [("第一篇", 1), ("第二篇 阿", 2), ("第二篇 甲", 2), ("第九篇 x", 9), ("第十篇 乙", 10), ("第十一篇", 11), ("安徽", 999), ("北京", 999), ("第二十篇", 999), ("没有", 999)]
    weights = spark.createDataFrame([(x,) for x in ("第十九篇", "第十篇", "无", None)], "n string").select(evaluation.part_weight(F.col("n")).alias("w")).collect()
    assert [r.w for r in weights] == [19, 10, 999, 999]
