"""Outlines read their texts once, spread by text, and leave out only work that changes nothing."""

from pyspark.sql import functions as F

from studyloom.operators import outline

MORE = "三、其他毒物中毒\n主要表现为意识障碍。【治疗】应尽早使用特效解毒剂。"


def test_texts_are_spread_and_parsed_once(spark):
    docs = spark.createDataFrame([(1, MORE)], "id int, text string").coalesce(1)
    plan = outline.outlines(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("REPARTITION_BY_COL") == 2 and "Union" not in plan
    # texts are shuffled twice, and for the join their ids; no pairs of characters are made of each candidate
    assert plan.count("Exchange hashpartitioning") == 3 and "array_intersect" not in plan


def test_control_characters_cut_no_section(spark):
    given = [("病因", "主要病因是感染，可通过飞沫传播。\u0001\n一、危险因素：常见的是免疫功能低下。\n表9-1 病因 见\u0001表")]
    rows = [(1, "普通疾病内容", given), (2, "普通疾病内容", [(t, c.replace("表9-1 病因 见\u0001表", "")) for t, c in given])]
    got = outline.outlines(spark.createDataFrame(rows, "id int, text string, s array<struct<title:string,content:string>>"), "id", "text", "s").collect()
    for r in got:
        assert r.groups[0].sections[0].digest[:2] == ["主要病因是感染，可通过飞沫传播。", "危险因素：常见的是免疫功能低下。"], r


def test_lines_end_in_no_carriage_return(spark):
    text = "【病因】感染的第一行。\r\n 第二行 \t\r\n\r\n第三行。\r\n治疗：休息。\r\n" + "长" * 40
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r.title, r.content) for r in outline.titled_sections(docs, "id", "text").orderBy("section_no").collect()]
    assert got == [("病因", "感染的第一行。\n第二行\n第三行。"), ("治疗", "休息。\n" + "长" * 40)]


def test_noise_and_blanks_of_any_kind_go(spark):
    cases = {
        "前文 第三章 中毒 总论 12 正文": "前文 正文", "正文\n 12 第四篇 中毒学总论 后文": "正文 后文", "见第二节 | 毒物，后": "见 ，后", "如图 9-1-2 说明。后": "如 。后", "解毒（Abc def）药": "解毒药",
        "　a  b\t\n c﻿": "a b c", "a b": "a b", "第一、图、（二）": "第一、图、（二）", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", outline.digest_text(F.col("t")).alias("d"), outline.stripped(F.concat(F.lit(" \x0b"), "t", F.lit("  "))).alias("s")).collect()
    assert {r.t: r.d for r in rows} == cases
    assert all(r.s == r.t.strip("　﻿") for r in rows)


def test_long_values_are_cut_by_their_beginning(spark):
    long = "治 疗" * 400 + "。：尾"
    frame = spark.createDataFrame([(long,), ("需要注意的是，" + "。：" * 300,), ("截至今日，" + "甲，" * 300,)], "text string")
    got = [r.text for r in outline.shortened(frame, "text").collect()]
    assert got == ["治疗" * 39 + "…", "注意" + "：" * 76 + "…", ("甲，" * 39).rstrip("，") + "…"]


def test_sections_of_one_title_merge_once_in_order(spark):
    given = [("病因", "乙：感染是主要病因。"), ("治疗", "应尽早休息和补液。"), ("病因", "甲：中毒也是主要病因。"), ("病 因", "乙感染，是主要病因！"[:-1]), ("病因：", "甲：中毒也是 主要病因。"), ("病因", "丙：免疫功能低下。")]
    frame = spark.createDataFrame([(1, "普通疾病内容", given)], "id int, text string, s array<struct<title:string,content:string>>")
    (g,) = outline.outlines(frame, "id", "text", "s").first().groups
    assert [(s.title, s.content) for s in g.sections] == [("病因", "乙：感染是主要病因。\n甲：中毒也是主要病因。\n丙：免疫功能低下。"), ("治疗", "应尽早休息和补液。")]


def test_blanks_before_a_starter_may_be_many(spark):
    for blanks in (" ", "\x0b" * 60, " \x0c" * 30):
        (p,) = outline.content_points(spark.createDataFrame([(1, "一、高血压" + blanks + "是指血压升高，常见。")], "id int, text string"), ["id"], "text").collect()
        assert (p.title, p.body) == ("高血压", "是指血压升高，常见。")


def test_alike_texts_go_in_order():
    assert outline._unlike(["abcdefgh", "abcdefgh!", "", "zzzzyyyy", "", "qrstuvwx"], 4) == [0, 2, 3, 4]
    assert outline._unlike(["abcd", "abcdefghijkl", "abcdefghijklm"], 9) == [0, 1] and outline._unlike(["a", "a"], 2) == [0]
