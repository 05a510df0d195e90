"""Sections, points, digests and outlines of textbook prose, by cases worked out by hand and against walks over lines."""

import random
import re

from pyspark.sql import functions as F

from studyloom.operators import outline

TEXT = """
    农药中毒包括多种毒物，处理原则不能混用。
    一、急性有机磷杀虫药中毒
    有机磷抑制胆碱酯酶，可导致胆碱能危象。
    【病因】常见于生产暴露、喷洒污染和误服。
    【临床表现】主要表现为毒蕈碱样、烟碱样和中枢神经系统症状。
    【治疗】应尽快去污，按病情使用阿托品和胆碱酯酶复活剂。
    二、急性百草枯中毒
    百草枯中毒以进行性肺损伤为突出表现。
    【病因和发病机制】氧自由基损伤可导致多器官功能障碍。
    【治疗】目前无特效解毒药，应尽早清除毒物并进行器官支持。
    三、诊断中毒
    这一段不是专题，仍属于百草枯。
    三、灭鼠药中毒
    不同灭鼠药的中毒机制和解毒剂差异明显。
    【治疗】先稳定气道、呼吸和循环，再根据毒物使用特效解毒剂。
"""


def texts(spark, *items):
    return spark.createDataFrame(list(enumerate(items)), "id int, text string")


def test_topics_keep_their_sections(spark):
    got = {r.id: r for r in outline.outlines(texts(spark, TEXT, None, "", "短"), "id", "text").collect()}
    o = got[0]
    assert o.grouped and [g.title for g in o.groups] == ["急性有机磷杀虫药中毒", "急性百草枯中毒", "灭鼠药中毒"]
    assert [[s.title for s in g.sections] for g in o.groups] == [["核心概念", "病因", "临床表现", "治疗"], ["核心概念", "病因与机制", "治疗"], ["核心概念", "治疗"]]
    assert "三、诊断中毒" in o.groups[1].sections[2].content and o.overview == ["农药中毒包括多种毒物，处理原则不能混用。"]
    assert all(0 < len(s.digest) <= 4 and all(6 <= len(p) <= 79 for p in s.digest) for g in o.groups for s in g.sections)
    assert all(not got[i].grouped and got[i].groups == [] and got[i].overview == [] for i in (1, 2, 3))


def test_given_sections_merge_by_title(spark):
    given = [("病因", "主要病因是感染，可通过飞沫传播。"), ("病因：", "常见危险因素包括免疫功能低下。"), ("病 因", "主要病因是感染，可通过飞沫传播。"), ("症状", "主要表现为发热、咳嗽和乏力。"), ("体征", "短"), (None, "没有标题的内容不算。")]
    frame = spark.createDataFrame([(1, "普通疾病内容", given)], "id int, text string, s array<struct<title:string,content:string>>")
    o = outline.outlines(frame, "id", "text", "s").first()
    assert not o.grouped and [s.title for s in o.groups[0].sections] == ["病因", "临床表现"]
    assert o.groups[0].sections[0].content == "主要病因是感染，可通过飞沫传播。\n常见危险因素包括免疫功能低下。"


def test_one_topic_or_a_gap_is_no_group(spark):
    one, gap = "一、甲类农药中毒\n主要表现为呼吸衰竭。", "一、甲类农药中毒\n主要表现为呼吸衰竭。\n三、乙类农药中毒\n应给予特效治疗药物。"
    two = gap.replace("三", "二") + "\n一、丙类农药中毒\n可见意识障碍的表现。"
    rows = outline.outlines(texts(spark, one, gap, two), "id", "text").orderBy("id").collect()
    assert [r.grouped for r in rows] == [False, False, True] and [g.title for g in rows[2].groups] == ["甲类农药中毒", "乙类农药中毒"]


def points(spark, text, most=outline.BODY):
    return [tuple(p) for r in outline.points_of(texts(spark, text), "id", "text", most).collect() for p in r.points]


def test_points_and_levels(spark):
    text = "这里是开头。\n一、定义：指某种情况 1.首先 是指第一步。（1）细节 在此处①最小 点【治疗】应休息\n第二行\n2) 短标题\n（二）没有标点的短行\n3.5倍不算标记"
    assert points(spark, text) == [
        ("", "核心说明", "这里是开头。", 0), ("一、", "定义", "指某种情况", 1), ("1.", "首先", "是指第一步。", 2), ("（1）", "细节", "在此处①最小 点【治疗】应休息\n第二行", 3),
        ("2)", "短标题", "", 3), ("（二）", "没有标点的短行\n3.5倍不算标记".split("\n")[0], "3.5倍不算标记", 2),
    ]


def test_titles_and_bodies(spark):
    cases = {
        "病因：感染": ("病因", "感染"), "：前面的冒号去掉": ("前面的冒号去掉", ""), "高血压 是指血压升高，常见。": ("高血压", "是指血压升高，常见。"), "短行没有标点": ("短行没有标点", ""),
        "词语 后面一句话，有标点。": ("词语", "后面一句话，有标点。"), "从句在前，其余在后。": ("从句在前", "其余在后。"), "啊，太短的从句不作标题。": ("", "啊，太短的从句不作标题。"), "a，b：c": ("", "a，b：c"),
    }
    for rest, (title, body) in cases.items():
        assert points(spark, "一、" + rest) == [("一、", title, body, 1)], rest


def test_long_bodies_split_at_sentences(spark):
    sentence = "这是一个不长不短的句子而已。"
    got = points(spark, "一、标题：" + sentence * 20, 100)
    assert [p[1] for p in got] == ["标题", "标题 · 2", "标题 · 3"] and [p[0] for p in got] == ["一、", "", ""] and "".join(p[2] for p in got) == sentence * 20 and all(len(p[2]) <= 100 for p in got)
    assert [(p[1], len(p[2])) for p in points(spark, "没有句号" * 60, 100)] == [("要点 01", 100), ("要点 02", 100), ("要点 03", 40)]
    assert [p[1] for p in points(spark, sentence * 20 + "\n1. 点", 100)] == ["核心说明", "核心说明 · 2", "核心说明 · 3", "点"]


def walk(text, titles, keep_colon=True):
    """(title, content) line by line, the longest title first."""
    if not text or len(text) < 50:
        return []
    n = "一二三四五六七八九十"
    for p in (r"([。！？；\n])\s*(【)", rf"([。！？；\n])\s*([{n}]+[、.．])", rf"([。！？；\n])\s*([（(][{n}\d]+[）)])", r"([。！？；\n])\s*(\d+[、.．]\s*[^\d])"):
        text = re.sub(p, r"\1\n\2", text)
    out, now = [], None
    for line in filter(None, map(str.strip, text.split("\n"))):
        for t in sorted(titles, key=len, reverse=True):
            hit = re.match(rf"【{t}】\s*{'' if keep_colon else '[：:]*'}\s*(.*)|{t}\s*[：:]\s*(.*)|[{n}\d]+[、.．]\s*{t}\s*[：:]*\s*(.*)|[（(][{n}\d]+[）)]\s*{t}\s*[：:]*\s*(.*)", line)
            if hit:
                now = (t, [x for x in hit.groups() if x])
                out.append(now)
                break
        else:
            if now:
                now[1].append(line)
    return [(t, "\n".join(c)) for t, c in out if c]


def test_titled_sections_match_a_walk_over_lines(spark):
    rng = random.Random(2)
    bits = ["【病因】", "【诊断】：", "病理：", "病理生理 :", "一、治疗原则", "（2）预防 ", "3.诊断标准：", "4、分类", "治疗", "正文一句。", "正文 two；", "\n", "\n\n", " ", "1.5 倍", "【别的】", "病因与发病机制：", "症状", "：", "。"]
    items = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(150)] + [None, "", "【病因】" + "长" * 60]
    for keep in (True, False):
        got = {}
        for r in outline.titled_sections(texts(spark, *items), "id", "text", keep_colon=keep).orderBy("id", "section_no").collect():
            got.setdefault(r.id, []).append((r.title, r.content))
        assert got == {i: w for i, x in enumerate(items) if (w := walk(x, outline.TITLES, keep))}


def test_shortened_texts(spark):
    long = "主要" + "甲" * 60 + "，" + "乙" * 40
    frame = texts(spark, "近年来，2003 年发现该药，主要用于 治 疗", long, "丙" * 100, "需要注意的是，不能停药。", None)
    got = [r.text for r in outline.shortened(frame.withColumn("text", F.coalesce("text", F.lit(""))), "text").orderBy("id").collect()]
    assert got == ["近年来，主要用于治疗", "主要" + "甲" * 60 + "…", "丙" * 78 + "…", "注意：不能停药。", ""]


def test_digest_bounds_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(3).alias("k"))
    rows = outline.digests(d, ["doc_id"], "text").collect()
    assert len(rows) == d.count() and any(r.digest for r in rows) and all(len(r.digest) <= 3 and all(6 <= len(p) <= 79 for p in r.digest) for r in rows)
