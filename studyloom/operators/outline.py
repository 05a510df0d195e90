"""Structure in textbook prose: titled sections, bracketed sections, marked points, digests and outlines.

Headings and markers are found by patterns over whole texts and set off by control characters, at which the texts are split;
so each step is linear in the text and needs no shuffle until the parts of a text are put together again. Arrays are exploded by the outer form, as for
the other one Spark adds a filter that, pushed down, computes all that leads to the array twice. The control characters that serve as
marks are dropped from the texts first. Patterns that need a rare character are tried only on texts that have it, as looking for a
character is much cheaper than a pattern; such functions refer to their text several times and take it as a column or a lambda's variable.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let
from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

BEGIN, END = "\u0001", "\u0002"
_WHITE = r"[\s\p{Z}﻿]"
#: The characters that _WHITE stands for.
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_LINE_WHITE = r"[ \t\x0B\f\r]"
#: A class of characters beyond Latin is a chain of comparisons; before it ASCII letters are ruled out by a table of bits.
_NO_LETTER = f"[^{string.ascii_letters}]"

#: The titles of sections.
TITLES = (
    "定义", "概述", "流行病学", "病因", "发病机制", "病因与发病机制", "病理", "病理生理", "临床表现", "症状", "体征", "检查", "辅助检查", "实验室检查", "影像学检查",
    "诊断", "鉴别诊断", "诊断标准", "治疗", "治疗原则", "药物治疗", "手术治疗", "预后", "预防", "并发症", "分类", "分型",
)
_NUMERAL = "一二三四五六七八九十"


def stripped(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.trim(c, F.lit(_BLANKS))


def _without(c: Column, sign: str) -> Column:
    return F.replace(c, F.lit(sign), F.lit(""))


def _has(c: Column, signs: Sequence[str]) -> Column:
    """Whether one of the ``signs`` is in a text."""
    return reduce(or_, (F.contains(c, F.lit(sign)) for sign in signs))


def _plain(c: Column) -> Column:
    return _without(_without(F.coalesce(c, F.lit("")), BEGIN), END)


def _lines(c: Column) -> Column:
    """Lines without blanks at their ends; empty ones go."""
    return F.regexp_replace(F.trim(c, F.lit(" \t\x0b\x0c\r")), rf"(?=[ \t\n\x0B\f\r]){_LINE_WHITE}*\n\s*", "\n")


def _parts(c: Column, *beside: Column) -> Column:
    """What follows each mark, as structs (no, head, rest); what stands before the first mark is number 0 without a head. Columns ``beside``
    come along with number 0."""
    head = lambda x: F.when(F.contains(x, F.lit(END)), F.substring_index(x, END, 1)).otherwise("")
    return F.transform(F.split(c, BEGIN), lambda x, i: F.struct(i.alias("no"), head(x).alias("head"), F.substring_index(x, END, -1).alias("rest"), *(F.when(i == 0, b).alias("beside") for b in beside)))


def titled_sections(docs: DataFrame, id_col: str, text_col: str, titles: Sequence[str] = TITLES, numbered: bool = True, keep_colon: bool = True, least: int = 50) -> DataFrame:
    """(id, section_no, title, content): the sections that begin with one of the ``titles``.

    A title stands in 【】, before a colon, or after a number or a bracketed number, at the beginning of a line or of a sentence (with
    ``numbered`` also after Arabic numbers there); of titles that fit the longest counts. Content is the rest of the line and all lines up to the next title;
    sections without any are left out, as are texts of under ``least`` characters. After 】 a colon stays unless ``keep_colon`` is false."""
    text = _plain(F.col(text_col))
    breaks = [r"([。！？；\n])\s*(【)", rf"([。！？；\n])\s*([{_NUMERAL}]+[、.．])", rf"([。！？；\n])\s*([（(][{_NUMERAL}\d]+[）)])"]
    for p in breaks + ([r"([。！？；\n])\s*(\d+[、.．]\s*[^\d])"] if numbered else []):
        text = F.regexp_replace(text, p, "$1\n$2")
    names = "|".join(re.escape(t) for t in sorted(titles, key=len, reverse=True))
    w, colon = f"{_LINE_WHITE}*", "[：:]"
    heading = "|".join([f"【({names})】" + ("" if keep_colon else f"{w}{colon}*"), f"({names}){w}{colon}", rf"[{_NUMERAL}\d]+[、.．]{w}({names}){w}{colon}*", rf"[（(][{_NUMERAL}\d]+[）)]{w}({names}){w}{colon}*"])
    marked = F.regexp_replace(_lines(text), f"(?m)^(?:{heading}){w}", f"{BEGIN}$1$2$3$4{END}")
    found = docs.where(F.length(text_col) >= least).select(F.col(id_col), F.explode_outer(_parts(marked)).alias("p")).where("p.no > 0")
    return found.select(id_col, F.col("p.no").alias("section_no"), F.col("p.head").alias("title"), stripped(F.col("p.rest")).alias("content")).where("content != ''")


#: What marks a point, and the levels of the marks (others: 4).
MARKERS = (r"【[^】\n]{1,30}】", r"[一二三四五六七八九十百]+[、.．]", r"[（(][一二三四五六七八九十百]+[）)]", r"[（(]\d{1,2}[）)]", r"\d{1,2}[.．、](?!\d)", r"[①-⑳]", r"\d{1,2}[）)]")
LEVELS = ((r"^【|^[一二三四五六七八九十百]+[、.．]$", 1), (r"^[（(][一二三四五六七八九十百]+[）)]$|^\d{1,2}[.．、]$", 2), (r"^[（(]\d{1,2}[）)]$|^\d{1,2}[）)]$", 3))
#: Words with which a body begins after a title.
BODY_STARTERS = (
    "是", "为", "指", "包括", "主要", "常见", "最", "可", "用于", "通过", "由于", "在", "当", "若", "表现", "目的", "应", "需", "建议", "推荐", "一般", "其", "该", "本", "凡", "对", "有", "由", "采用", "首选",
    "适用于", "临床", "病人", "患者", "大多数", "少数", "目前", "近年来", "通常", "根据", "分为", "以",
)
#: Page headings that stand in running text.
PAGE_HEADS = (
    (r"\n\s*第[一二三四五六七八九十百零〇\d]+章\s+.{1,36}?\s+\d{1,4}\s+(?=[A-Za-z（(【一-鿿])", "\n"),
    (r"\n\s*\d{1,4}\s+第[一二三四五六七八九十百零〇\d]+篇\s+[一-鿿]{2,16}\s+", "\n"),
)
#: The title of a text's beginning, and of its parts where there are no points.
INTRO, ITEM = "核心说明", "要点"
#: Characters of a body beyond which it is split.
BODY = 420


@F.arrow_udf(T.ArrayType(T.StringType()))
def _filled(sentences: pa.Array, limit: pa.Array) -> pa.Array:
    """Sentences put together up to ``limit`` characters; a text of one sentence is cut into pieces of as many."""
    most, out = limit[0].as_py() if len(limit) else 0, []
    for units in sentences.to_pylist():
        units = [u for u in units or [] if u]
        if len(units) == 1 and len(units[0]) > most:
            whole = units[0]
            out.append([p for i in range(0, len(whole), most) if (p := whole[i : i + most].strip())])
            continue
        done, now = [], []
        size = 0
        for u in units:
            if now and size + len(u) > most:
                done.append("".join(now))
                now, size = [], 0
            now.append(u)
            size += len(u)
        out.append([*done, "".join(now)] if now else done)
    return pa.array(out, pa.list_(pa.string()))


#: What ends a sentence.
SENTENCE_ENDS = "。！？；"


def _sentences(c: Column) -> Column:
    """Sentences of a text without blanks at its ends."""
    return F.when(_has(c, SENTENCE_ENDS), F.transform(F.split(c, rf"(?<=[{SENTENCE_ENDS}])\s*"), stripped)).otherwise(F.array(c))


def long_body(body: Column, most: int = BODY) -> Column:
    """A body in pieces of up to ``most`` characters where its sentences allow it; none for an empty one."""
    short = F.when(body == "", F.array().cast("array<string>")).otherwise(F.array(body))
    several = (F.length(body) > most) & _has(body, SENTENCE_ENDS)
    pieces = F.array_remove(F.transform(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{most}}}"), F.lit(0)), stripped), "")
    return F.when(F.length(body) <= most, short).when(several, _filled(F.when(several, _sentences(body)), F.lit(most))).otherwise(pieces)


def _titled(rows: DataFrame, rest: str) -> DataFrame:
    """``rows`` with title and body of a point's first line ``rest``: a short clause before a colon, what stands before a word that
    begins a body, a short line as a whole, a first word, a first clause; else all is body.

    Each step is a column of its own, so that later ones read it and don't compute it again; patterns see no more of a line than they need."""
    value, begin = F.col("value"), F.col("begin")
    out = rows.withColumn("value", stripped(F.col(rest)))
    out = out.withColumn("value", F.when(F.startswith(value, F.lit("：")) | F.startswith(value, F.lit(":")), F.regexp_replace(value, r"^[：:]\s*", "")).otherwise(value))
    out = out.withColumn("begin", F.substring("value", 1, 43))
    shapes = {  # what makes the title, where it is looked for, and the length of the sign after it
        "clause": (r"^[^：:]{1,42}(?=[：:])", begin, 1),
        # of blanks in a row there may be any number
        "starter": (rf"(?s)^.{{1,36}}?(?=\s+(?:{'|'.join(BODY_STARTERS)}))", F.when(F.rlike(begin, F.lit(r"\s\s")), value).otherwise(begin), 0),
        "word": (r"^\S{1,18}(?=\s)", begin, 0),
        "comma": (r"^[^，。；]{2,36}(?=[，。；])", begin, 1),
    }
    out = out.withColumns({name: F.regexp_extract(where, pattern, 0) for name, (pattern, where, _) in shapes.items()})
    out = out.withColumns({f"{name}1": stripped(F.col(name)) for name in shapes})
    held = (F.col("clause1") != "") & ~F.rlike("clause1", F.lit("[，。！？；]")) & ((F.length("clause1") <= 24) | ~F.rlike("clause1", F.lit(r"\s")))
    whole = (F.length("value") <= 42) & ~F.rlike("value", F.lit("[，。！？；：:]"))
    out = out.withColumn("shape", F.when(held, "clause").when(F.col("starter") != "", "starter").when(whole, "whole").when(F.col("word1") != "", "word").when(F.col("comma1") != "", "comma").otherwise("none"))
    title, body = F.when(F.col("shape") == "whole", F.col("value")), F.when(F.col("shape") == "none", F.col("value"))
    for name, (_, _, sign) in shapes.items():
        title, body = title.when(F.col("shape") == name, F.col(f"{name}1")), body.when(F.col("shape") == name, F.ltrim(F.substr("value", F.length(name) + 1 + sign), F.lit(_BLANKS)))
    out = out.withColumns({"title": title.otherwise(""), "body": body.otherwise("")})
    return out.drop("value", "begin", "shape", *shapes, *(f"{name}1" for name in shapes))


def content_points(docs: DataFrame, keys: Sequence[str], text_col: str, most: int = BODY, beside: str | None = None) -> DataFrame:
    """(keys, point_no, part_no, marker, title, body, level): the points of each text in order.

    A point begins with one of the MARKERS at the start of a line or after a blank or the end of a sentence. What stands before the first point is
    level 0. Bodies of over ``most`` characters become several parts, of which the first has the marker. A column ``beside`` comes along with the first
    part of each text, which then stands there even if it is empty."""
    extra = [F.col(beside).alias("beside")] if beside else []
    rows = docs.select(F.struct(*keys).alias("of"), *extra, _without(_plain(F.col(text_col)), "\r").alias("text"))
    text = F.col("text")
    heads = text
    for pattern, by in PAGE_HEADS:
        heads = F.regexp_replace(heads, pattern, by)
    rows = rows.withColumn("text", F.when(_has(text, "第"), heads).otherwise(text))
    rows = rows.withColumn("text", F.when(_has(text, ("  ", "\t")), F.regexp_replace(text, r"[ \t]{2,}", " ")).otherwise(text))
    rows = rows.withColumn("text", F.when(_has(text, ("\n\n\n",)), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text))
    mark = "|".join(MARKERS)
    marked = F.regexp_replace(stripped(text), rf"(?m)(?={_NO_LETTER})(^|[\s。！？；：:])(?={_NO_LETTER})({mark})\s*", "$1\n$2 ")
    marked = F.regexp_replace(_lines(marked), f"(?m)^(?={_NO_LETTER})({mark}){_LINE_WHITE}*", f"{BEGIN}$1{END}")
    # more than blanks and one colon, or a named mark; judged before blanks go, as the filter would strip the text once more
    told = F.rlike(F.col("p.rest"), F.lit(f"[^\\s\\p{{Z}}﻿：:]|[：:]{_WHITE}*[：:]")) | F.rlike(F.col("p.head"), F.lit(r"^【.*[^\s\p{Z}].*】$"))
    rows = rows.select("of", F.explode_outer(_parts(marked, *map(F.col, ["beside"] * len(extra)))).alias("p")).where((F.col("p.no") == 0) | told if beside else told)
    with_it = F.col("p.beside") if beside else F.lit(None).cast("string")
    rows = rows.select("of", F.col("p.no").alias("point_no"), F.col("p.head").alias("marker"), stripped(F.col("p.rest")).alias("rest"), with_it.alias("beside"))
    is_named, inside = F.substring("marker", 1, 1) == "【", F.substr("marker", F.lit(2), F.length("marker") - 2)
    first = F.substring_index("rest", "\n", 1)
    rows = rows.withColumns({"first": first, "more": F.when(F.contains("rest", F.lit("\n")), F.substr("rest", F.length(first) + 2)).otherwise("")})
    rows = _titled(rows, "first")
    intro = F.col("point_no") == 0
    head = F.when(is_named, F.regexp_replace("first", r"^[：:]\s*", "")).when(intro, F.col("first")).otherwise(F.col("body"))
    rows = rows.select("of", "point_no", "marker", "beside", F.when(is_named, stripped(inside)).when(intro, "").otherwise(F.col("title")).alias("title"), stripped(F.concat(head, F.lit("\n"), "more")).alias("body"))
    level = F.when(F.col("point_no") == 0, 0)
    for pattern, n in LEVELS:
        level = level.when(F.rlike("marker", F.lit(pattern)), n)
    pieces = long_body(F.col("body"), most)
    many = F.size("pieces")
    rows = rows.withColumn("pieces", pieces).withColumn("pieces", F.when(many > 0, F.col("pieces")).otherwise(F.array(F.lit(""))))
    parts = F.transform("pieces", lambda b, i: F.struct(b.alias("body"), F.when(i == 0, F.col("beside")).alias("beside")))
    each = rows.select("of", "point_no", "marker", "title", level.otherwise(4).alias("level"), many.alias("many"), F.posexplode_outer(parts).alias("part_no", "p"))
    nth = F.lpad((F.col("part_no") + 1).cast("string"), 2, "0")
    later = F.concat(F.lit(" · "), (F.col("part_no") + 1).cast("string"))
    named = lambda c: F.when(F.col("part_no") == 0, c).otherwise(F.concat(c, later))
    title = F.when((F.col("many") <= 1) | (F.col("point_no") == 0), F.col("title")).when(F.col("title") != "", named(F.col("title"))).otherwise(F.concat(F.lit(ITEM + " "), nth))
    intro = F.when(F.col("point_no") == 0, named(F.lit(INTRO)))
    out = each.select("of.*", "point_no", "part_no", F.when(F.col("part_no") == 0, F.col("marker")).otherwise("").alias("marker"), F.coalesce(intro, title).alias("title"), "p.body", "level", "p.beside")
    return out if beside else out.drop("beside")


def points_of(docs: DataFrame, id_col: str, text_col: str, most: int = BODY) -> DataFrame:
    """(id, points): the points of each text as an array; where a text has no marked point, its parts are items by number."""
    rows = content_points(docs, [id_col], text_col, most)
    listed = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("point_no", "part_no", "marker", "title", "body", "level"))).alias("x"))
    alone = ~F.exists("x", lambda p: p["point_no"] > 0)
    title = lambda p: F.when(alone, F.concat(F.lit(ITEM + " "), F.lpad((p["part_no"] + 1).cast("string"), 2, "0"))).otherwise(p["title"])
    return listed.select(id_col, F.transform("x", lambda p: F.struct(p["marker"].alias("marker"), title(p).alias("title"), p["body"].alias("body"), p["level"].alias("level"))).alias("points"))


#: sections' canonical titles by pattern, the first that is found.
CANONICAL = (
    ("临床.*诊断|诊断.*临床", "临床与诊断"), ("诊断.*鉴别|鉴别.*诊断", "诊断与鉴别"), ("病因.*机制|机制.*病因", "病因与机制"), ("机制.*解救|解救.*机制", "机制与解救"), ("吸收.*代谢|毒物代谢", "吸收与代谢"),
    ("分类", "分类"), ("流行病学", "流行病学"), ("病因", "病因"), ("发病机制|中毒机制", "发病机制"), ("病理生理", "病理生理"), ("病理", "病理"), ("临床表现|症状|体征", "临床表现"), ("实验室检查", "实验室检查"),
    ("影像", "影像学检查"), ("辅助检查|检查", "辅助检查"), ("鉴别诊断", "鉴别诊断"), ("诊断", "诊断"), ("治疗", "治疗"), ("预防", "预防"), ("预后", "预后"), ("并发症", "并发症"), ("定义|概述", "核心概念"),
)
CORE = "核心概念"
#: Headings of topics, those that are too general, and words that no topic has.
TOPIC = rf"(?={_NO_LETTER})(?:^|\s)(?={_NO_LETTER})([{_NUMERAL}]+)[、.．]\s*([^。；\n]{{2,42}}?中毒)(?=\s|。|$)"
GENERAL = ("急性中毒", "慢性中毒", "生产中毒", "使用中毒", "生活中毒", "职业中毒", "食物中毒")
NO_TOPIC = "诊断|治疗|病因|临床|检查|机制|预防|分级|分型"
NUMBERS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二")
#: What makes a sentence worth a place in a digest, what speaks against it, and what says nothing.
IMPORTANT = ("是指", "主要", "表现", "诊断", "首选", "特效", "治疗", "机制", "抑制", "导致", "应", "需", "可", "常见", "分为", "死亡", "预后", "呼吸衰竭", "意识障碍", "解毒", "禁忌", "注意", "毒性")
LOW_VALUE = ("世纪", "截至", "我国于", "年开始", "年生产", "开发", "图9-", "表9-", "如图", "见表", "作者", "研究发现", "近年来", "结构式", "取代基", "烷基")
EMPTY_WORDS = r"(?:诊断)?依据如下[。；：:]?$|(?:主要)?表现如下[。；：:]?$|(?:常见)?原因如下[。；：:]?$|(?:具体)?分类如下[。；：:]?$|^详见表"
FIGURES = r"(?=[0123456789%mCM])(?:[\d%]|mg|mmHg|ChE|CT|MRI)"
HISTORY = r"(?:18|19|20)\d{2}\s*年|20\s*世纪|截至|进入中国|停止生产|禁止生产|禁止销售"
#: Characters without which there is no HISTORY, and no EMPTY_WORDS.
HISTORY_SIGNS, EMPTY_SIGNS = "年世截进停禁", ("如下", "详见表")
#: What is no part of a digest's text, and what stands for it, by the character without which there is none.
DIGEST_NOISE = (
    ("第", ((r"\n?\s*第[一二三四五六七八九十百零〇\d]+章\s+.{1,30}?\s+\d{1,4}\s*", " "), (r"\n?\s*\d{1,4}\s+第[一二三四五六七八九十百零〇\d]+篇\s+[一-鿿]{2,18}\s*", " "), (r"第[一二三四五六七八九十百零〇\d]+节\s*[|｜]\s*[一-鿿]{2,24}", " "))),
    ("图", ((r"图\s*\d+(?:-\d+)+[^\n。]{0,28}", " "),)),
    ("（", ((r"（[A-Za-z][^）\n]{0,80}）", ""),)),
)
#: A digest's longest point, where it may be cut, its shortest point, and when two are one.
LONGEST, CUT, SHORTEST, ALIKE = 78, 48, 6, 0.68


def canonical_title(title: Column) -> Column:
    """The usual title for a section's; an unusual one is cut to 16 characters."""
    value = F.regexp_replace(F.regexp_replace(title, f"{_WHITE}+", ""), "[：:]+$", "")

    def named(value: Column) -> Column:
        out = F.when(F.length(value) > 16, F.concat(F.substring(value, 1, 16), F.lit("…"))).otherwise(value)
        for pattern, name in reversed(CANONICAL):
            out = F.when(F.rlike(value, F.lit(pattern)), name).otherwise(out)
        return out

    return let(value, named)


def bracket_sections(text: Column) -> Column:
    """An array of (no, title, content): the parts after 【headings】, from 8 characters on, under their canonical titles; what stands before the first
    (from 12 on), or a text without headings, is the core."""
    parts = _parts(F.regexp_replace(_plain(text), r"【([^】\n]{1,40})】", f"{BEGIN}$1{END}"))
    shaped = lambda p: F.struct(p["no"].alias("no"), F.when(p["no"] == 0, CORE).otherwise(canonical_title(p["head"])).alias("title"), stripped(p["rest"]).alias("content"))
    # a text without headings is one part
    kept = lambda all_: F.filter(all_, lambda p: (F.size(all_) == 1) | (F.length(p["content"]) >= F.when(p["no"] == 0, 12).otherwise(8)))
    return let(F.transform(parts, shaped), kept)


def topics(text: Column) -> Column:
    """An array of (no, title, content): the topics 一, 二, 三 ... of a text, each at the first heading after the last with the expected number, and
    number 0 for what stands before; empty if there are not two."""
    marked = F.split(F.regexp_replace(_plain(text), TOPIC, f"{BEGIN}$0{END}"), BEGIN)
    pieces = F.transform(marked, lambda x, i: F.struct(i.alias("i"), F.when(F.contains(x, F.lit(END)), F.substring_index(x, END, 1)).otherwise("").alias("head"), F.substring_index(x, END, -1).alias("rest")))
    numbered = F.transform(pieces, lambda p: F.struct(p["i"].alias("i"), p["head"].alias("head"), p["rest"].alias("rest"), F.regexp_extract(p["head"], TOPIC, 1).alias("n"), F.regexp_replace(F.regexp_extract(p["head"], TOPIC, 2), f"{_WHITE}+", "").alias("title")))
    fits = lambda p: (p["head"] != "") & ~p["title"].isin(*GENERAL) & ~F.rlike(p["title"], F.lit(NO_TOPIC))
    numbers = F.array(*map(F.lit, NUMBERS))

    def step(s, p):
        hit = fits(p) & (F.array_position(numbers, p["n"]) == s["next"])
        return F.struct(F.when(hit, s["next"] + 1).otherwise(s["next"]).alias("next"), F.when(hit, F.array_append(s["chosen"], p["i"])).otherwise(s["chosen"]).alias("chosen"))

    # no more are chosen than there are numbers
    choose = lambda all_: F.aggregate(all_, F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<int>").alias("chosen")), step, lambda s: s["chosen"])
    begun = lambda all_, chosen: F.transform(all_, lambda p: F.when(F.array_contains(chosen, p["i"]), F.concat(F.lit(BEGIN), p["title"], F.lit(END), p["rest"])).otherwise(F.concat(p["head"], p["rest"])))
    out = lambda all_, chosen: F.transform(_parts(F.array_join(begun(all_, chosen), "")), lambda p: F.struct(p["no"].alias("no"), p["head"].alias("title"), stripped(p["rest"]).alias("content")))
    none = F.array().cast("array<struct<no:int,title:string,content:string>>")
    return let(numbered, lambda all_: let(choose(all_), lambda chosen: F.when(F.size(chosen) >= 2, out(all_, chosen)).otherwise(none)))


def compared(text: Column) -> Column:
    """A text as it is compared with others."""
    low = F.lower(text)
    return F.regexp_replace(F.when(_has(text, (INTRO, ITEM)), F.regexp_replace(low, rf"{INTRO}|{ITEM}\d*", "")).otherwise(low), rf"""[{_NO_LETTER}&&[\s，。；：、“”‘’（）()【】,.!?;:'"-]]+""", "")


def _unlike(plain: Sequence[str], k: int) -> list[int]:
    """Places of the first ``k`` of compared texts that are not alike an earlier one. Alike is the ratio of lengths if one holds the other,
    else the Jaccard similarity of pairs of characters; empty ones are like none."""
    kept: list[tuple[int, str, set[str]]] = []
    for place, x in enumerate(plain):
        if len(kept) >= k:
            break
        pairs = {x[i : i + 2] for i in range(len(x) - 1)}

        def like(y: str, others: set[str], x: str = x, pairs: set[str] = pairs) -> float:
            if x and y and (x in y or y in x):
                return min(len(x), len(y)) / max(len(x), len(y))
            both = len(pairs & others)
            return both / (len(pairs) + len(others) - both) if both else 0.0

        if all(like(y, others) < ALIKE for _, y, others in kept):
            kept.append((place, x, pairs))
    return [place for place, _, _ in kept]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _first_unlike(plain: pa.Array, k: pa.Array) -> pa.Array:
    """``_unlike`` of each of a row's arrays."""
    out = [None if p is None else [_unlike(x, n) for x, n in zip(p, ks, strict=True)] for p, ks in zip(plain.to_pylist(), k.to_pylist(), strict=True)]
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def digest_text(text: Column) -> Column:
    out = _without(text, "\r")
    for sign, patterns in DIGEST_NOISE:
        cleaned = out
        for pattern, by in patterns:
            cleaned = F.regexp_replace(cleaned, pattern, by)
        out = F.when(_has(text, sign), cleaned).otherwise(out)
    # single blanks stay as they are
    return F.trim(F.regexp_replace(out, f"(?={_NO_LETTER})(?:{_WHITE}{{2,}}|(?! ){_WHITE})", " "))


def _digest_again(text: Column) -> Column:
    """``digest_text`` of what was part of one before, between new lines."""
    return F.when(_has(text, ("\n", *(sign for sign, _ in DIGEST_NOISE))), digest_text(text)).otherwise(text)


def _useful(text: Column) -> Column:
    """A digest's text without clauses of mere history; not more of it than what the next steps may need for LONGEST characters, as they
    make no more than two characters one."""
    clauses = F.when(_has(text, "，；"), F.transform(F.split(text, "[，；]"), stripped)).otherwise(F.array(text))
    useful = F.when(_has(text, HISTORY_SIGNS), F.filter(clauses, lambda c: ~F.rlike(c, F.lit(HISTORY)))).otherwise(clauses)
    parted = _has(text, "，；" + HISTORY_SIGNS)
    return F.substring(F.when(parted, F.array_join(F.array_remove(useful, ""), "，")).otherwise(text), 1, 2 * LONGEST + 16)


def _noted(text: Column) -> Column:
    noted = F.regexp_replace(F.regexp_replace(text, r"^(?:需要|值得)注意的是[，,]?", "注意："), "。[：:]", "：")
    return stripped(F.when(_has(text, ("注意的是", "。")), noted).otherwise(text))


def _cut(text: Column) -> Column:
    """At most LONGEST characters; a longer text is cut at the last separator from CUT on."""
    head = F.substring(text, 1, LONGEST)
    kept = F.regexp_replace(F.regexp_replace(head, rf"(?s)^(.{{{CUT},}})[；，、].*$", "$1"), r"[，；、\s]+$", "")
    return F.when(F.length(text) <= LONGEST, text).otherwise(F.concat(kept, F.lit("…")))


#: The steps that shorten a text; each refers to its text several times.
SHORTENING = (_useful, lambda text: F.regexp_replace(text, r"([一-鿿])\s+(?=[一-鿿])", "$1"), _noted, _cut)


def _shortened(text: Column) -> Column:
    return reduce(let, (_digest_again, *SHORTENING), text)


def shortened(rows: DataFrame, column: str, clean: Callable[[Column], Column] = digest_text) -> DataFrame:
    """``rows`` with a text as a digest has it, without clauses of mere history, up to LONGEST characters."""
    for step in (clean, *SHORTENING):
        rows = rows.withColumn(column, step(F.col(column)))
    return rows


def worth(text: Column, titled: Column) -> Column:
    """What a candidate for a digest is worth."""
    terms = lambda words, w: F.size(F.filter(F.array(*map(F.lit, words)), lambda t: F.contains(text, t))) * F.lit(float(w))
    yes = lambda c, w: F.when(c, float(w)).otherwise(0.0)
    n = F.length(text)
    return yes(titled, 3) + terms(IMPORTANT, 1) + terms(LOW_VALUE, -3) + yes(F.rlike(text, F.lit(FIGURES)), 0.5) + yes(n.between(18, 120), 1) + yes(n < 10, -2) + yes(_has(text, EMPTY_SIGNS) & F.rlike(stripped(text), F.lit(EMPTY_WORDS)), -8)


def digests(rows: DataFrame, keys: Sequence[str], text_col: str, k: str = "k") -> DataFrame:
    """(keys, digest): up to ``k`` (a column) points of each text. Candidates are its points, each with its first whole sentence, and
    where these are fewer than two its sentences; the best 2 k by worth, in their order, without those alike an earlier one.

    Keys must be unique. A text without a point has an empty digest."""
    best = _best(rows, keys, text_col, k).withColumn("fresh", _first_unlike(F.array("best.plain"), F.array("k"))[0])
    return best.select("keys.*", F.transform("fresh", lambda i: F.get(F.col("best.text"), i)).alias("digest"))


def _best(rows: DataFrame, keys: Sequence[str], text_col: str, k: str, others: Sequence[str] = (), by: str | None = None) -> DataFrame:
    """(by, keys, k, text, others, best), ``keys`` and ``others`` as structs: the best candidates (text, plain) of each text in order, as ``digests`` has them.

    A text goes along with its first point, as do the columns ``others``, so that its sentences are looked at only where points are few, and
    nothing is joined. Rows are shuffled by the key ``by``, else by all."""
    held = [F.col(key).alias(f"key{i}") for i, key in enumerate(keys)] + [F.col(k).cast("int").alias("_k")]
    names = [f"key{i}" for i in range(len(keys))] + ["_k"]
    raw = rows.select(*held, F.struct(*others).alias("others") if others else F.lit(0).alias("others"), F.coalesce(text_col, F.lit("")).alias("text"))
    cleaned = raw.withColumns({"clean": digest_text(F.col("text")), "beside": F.struct("text", "others")})
    points = content_points(cleaned, names, "clean", beside="beside")
    bare = F.col("title")
    for pattern in (rf"^{INTRO}(?:\s*·\s*\d+)?$", rf"^{ITEM}\s*\d+$", r"\s*·\s*\d+$"):
        bare = F.regexp_replace(bare, pattern, "")
    points = points.withColumns({"head": stripped(bare), "plain": _digest_again(F.col("body"))})
    figure = lambda s: (F.startswith(s, F.lit("图")) | F.startswith(s, F.lit("表"))) & F.rlike(s, F.lit(r"^(图|表)\s*\d"))
    first = F.get(F.filter(_sentences(F.col("plain")), lambda s: (F.length(s) >= 8) & ~figure(s)), F.lit(0))
    points = shortened(points.withColumn("said", F.coalesce(first, "plain")), "said", _digest_again)
    both = F.when(F.startswith(compared(F.col("said")), compared(F.col("head"))), F.col("said")).otherwise(F.concat("head", F.lit("："), "said"))
    points = points.withColumn("text", F.when((F.col("head") != "") & (F.col("said") != ""), both).when(F.col("head") != "", F.col("head")).otherwise(F.col("said")))
    bonus = F.when(F.col("level") == 0, 3.0).otherwise(0.0)
    # no filter of rows: Spark would push it down and compute all that leads to it twice
    points = shortened(points.withColumn("worth", worth(F.col("text"), F.col("head") != "") + bonus), "text", _digest_again)
    fits = (F.col("worth") > 0) & (F.length("text") >= SHORTEST)
    own = F.array_sort(F.collect_list(F.when(fits, F.struct("point_no", "part_no", "worth", "text"))))
    points = points.repartition(names[keys.index(by)]) if by else points
    listed = points.groupBy(*names).agg(own.alias("own"), F.first("beside", ignorenulls=True).alias("beside")).select(*names, "own", "beside.*")
    listed = listed.withColumn("clean", F.when(F.size("own") <= 1, digest_text(F.col("text"))))
    # points by their place among the points, sentences by their number
    ranked = lambda kind, worth, i, text: F.struct((-worth).alias("less"), i.alias("i"), F.lit(kind).alias("kind"), text.alias("text"))
    units = F.transform(_sentences(F.col("clean")), lambda u, i: ranked(1, worth(u, F.lit(False)), i, _shortened(u)))
    fitting = F.filter(units, lambda x: (x["less"] < 0) & (F.length(x["text"]) >= 8))
    counted = F.transform("own", lambda x, i: ranked(0, x["worth"], i, x["text"]))
    listed = listed.withColumn("c", F.when(F.size("own") <= 1, F.concat(counted, fitting)).otherwise(counted))
    listed = listed.withColumn("best", F.slice(F.array_sort("c"), F.lit(1), 2 * F.col("_k")))
    # shortened once more, as a text may lose more by that
    last = lambda x, r: let(_shortened(x["text"]), lambda t: F.struct(x["i"].alias("i"), r.alias("r"), t.alias("text"), compared(t).alias("plain")))
    listed = listed.withColumn("best", F.filter(F.array_sort(F.transform("best", last)), lambda x: F.length(x["text"]) >= SHORTEST))
    named = [F.col(f"key{i}").alias(key) for i, key in enumerate(keys)]
    return listed.select(*([named[keys.index(by)]] if by else []), F.struct(*named).alias("keys"), F.col("_k").alias("k"), "text", "others", "best")


def _without_tables(title: Column, content: Column) -> Column:
    """Of a content with tables only the prose before them and the tables whose heading fits the section."""
    pieces = F.split(F.regexp_replace(content, r"表\s*\d+(?:-\d+)+\s*", f"{BEGIN}$0"), BEGIN)
    words = F.when(F.contains(title, F.lit("治疗")), F.array(*map(F.lit, ("治疗", "疗法", "解毒")))).when(F.contains(title, F.lit("诊断")), F.array(*map(F.lit, ("诊断", "鉴别")))).when(F.contains(title, F.lit("临床")), F.array(*map(F.lit, ("临床", "症状", "体征")))).otherwise(F.array(title))
    prose = stripped(pieces[0])
    fitting = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.exists(words, lambda w: F.contains(F.substring(p, 1, 80), w)))
    kept = F.array_join(F.concat(F.when(F.length(prose) >= 20, F.array(prose)).otherwise(F.array().cast("array<string>")), fitting), "\n")
    return F.when(F.size(pieces) <= 1, content).when(kept != "", kept).when(prose != "", prose).otherwise(content)


def outlines(docs: DataFrame, id_col: str, text_col: str, sections_col: str | None = None) -> DataFrame:
    """(id, grouped, overview, groups): each text's outline, groups being an array of (title, sections), sections of (title, content, digest).

    A text with two numbered topics or more is grouped by them; another one is a single group without a title, of the given sections (an array
    of (title, content)) or else of its bracketed ones. Within a group sections of one canonical title merge in the order in which they come,
    repeated contents once; sections without a digest are left out, and groups without sections. Ids must be unique."""
    given = F.col(sections_col) if sections_col else F.lit(None).cast("array<struct<title:string,content:string>>")
    # by text, so that the work is spread however few files there are, and a text's sections meet without another shuffle
    base = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), given.alias("given")).repartition(id_col).withColumn("topics", topics(F.col("text")))
    single = F.array(F.struct(F.lit(0).alias("no"), F.lit("").alias("title"), F.col("text").alias("content")))
    many = F.size("topics") > 0
    # of topics number 0 is the overview, a section of its own without a title
    groups = base.select(id_col, "given", many.alias("many"), F.explode_outer(F.when(many, F.col("topics")).otherwise(single)).alias("g"))
    overview = F.col("many") & (F.col("group_no") == 0)
    groups = groups.select(id_col, "given", "many", F.col("g.no").alias("group_no"), F.col("g.title").alias("group_title"), F.col("g.content").alias("content"))
    listed = F.transform("given", lambda s, i: F.struct(i.alias("no"), canonical_title(F.coalesce(s["title"], F.lit(""))).alias("title"), stripped(F.coalesce(s["content"], F.lit(""))).alias("content")))
    alone = F.array(F.struct(F.lit(0).alias("no"), F.lit("").alias("title"), F.col("content")))
    found = F.when(overview, alone).when(~F.col("many") & (F.size(F.coalesce("given", F.array())) > 0), listed).otherwise(bracket_sections(F.col("content")))
    rows = groups.select(id_col, "many", "group_no", "group_title", F.explode_outer(found).alias("s")).where(overview | ((F.col("s.title") != "") & (F.length("s.content") >= 8)))
    keys = [id_col, "group_no", "title"]
    rows = rows.select(id_col, "many", "group_no", "group_title", F.col("s.no").alias("no"), canonical_title(F.col("s.title")).alias("title"), F.col("s.content").alias("content"))
    merged = rows.groupBy(*keys, "many", "group_title").agg(F.array_sort(F.collect_list(F.struct("no", "content"))).alias("x"))
    several = F.size("x") > 1
    merged = merged.withColumn("by", F.when(several, F.array_sort(F.transform("x", lambda x: F.struct(compared(x["content"]).alias("same"), x["no"].alias("no"), x["content"].alias("content"))))))
    once = F.filter("by", lambda x, i: (i == 0) | (F.get("by", i - 1)["same"] != x["same"]))
    merged = merged.withColumn("x", F.when(several, F.array_sort(F.transform(once, lambda x: F.struct(x["no"].alias("no"), x["content"].alias("content"))))).otherwise(F.col("x")))
    merged = merged.select(*keys, "many", "group_title", F.col("x")[0]["no"].alias("no"), F.array_join(F.transform("x", lambda x: x["content"]), "\n").alias("content"))
    told = F.when(~overview & _has(F.col("content"), "表"), _without_tables(F.col("title"), _plain(F.col("content")))).otherwise(F.col("content"))
    merged = merged.withColumns({"k": F.when(overview | (F.col("title") == CORE), 2).otherwise(4), "told": told})
    # most contents are told as a whole
    merged = merged.withColumn("content", F.when(F.col("content") != F.col("told"), F.col("content")))
    whole = _best(merged, keys, "told", "k", ["many", "group_title", "no", "content"], by=id_col)
    section = F.struct("keys.group_no", "others.group_title", "others.no", "keys.title", F.coalesce("others.content", "text").alias("content"), "k", "best")
    by_doc = whole.groupBy(id_col, F.col("others.many").alias("many")).agg(F.array_sort(F.collect_list(section)).alias("s"))
    out = docs.select(id_col).join(by_doc, id_col, "left")
    # last, as rows come back from it without their partitioning
    out = out.withColumn("fresh", _first_unlike(F.transform("s", lambda x: x["best"]["plain"]), F.transform("s", lambda x: x["k"])))
    digest = lambda x, i: F.transform(F.get("fresh", i), lambda j: F.get(x["best"], j)["text"])
    out = out.withColumn("s", F.transform("s", lambda x, i: F.struct(*(x[c].alias(c) for c in ("group_no", "group_title", "title", "content")), digest(x, i).alias("digest"))))
    told_of = F.filter("s", lambda x: F.col("many") & (x["group_no"] == 0))
    out = out.withColumns({"overview": F.get(told_of, F.lit(0))["digest"], "kept": F.filter("s", lambda x: ~(F.col("many") & (x["group_no"] == 0)) & (F.size(x["digest"]) > 0))})
    out = out.withColumn("g", F.array_distinct(F.transform("kept", lambda x: F.struct(x["group_no"].alias("no"), x["group_title"].alias("title")))))
    sections = lambda g: F.transform(F.filter("kept", lambda x: x["group_no"] == g["no"]), lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content"), x["digest"].alias("digest")))
    groups = F.transform("g", lambda g: F.struct(g["title"].alias("title"), sections(g).alias("sections")))
    none = F.array().cast("array<struct<title:string,sections:array<struct<title:string,content:string,digest:array<string>>>>>")
    return out.select(id_col, F.coalesce(F.col("many") & (F.size("g") >= 2), F.lit(False)).alias("grouped"), F.coalesce("overview", F.array().cast("array<string>")).alias("overview"), F.coalesce(groups, none).alias("groups"))


#: Marks that the queries set before the lines of documents, by line number, so that the texts have structure.
SECTION_MARKS = ("【病因】", "", "治疗：", "", "（二）预后 ", "", "3.诊断标准:", "")
POINT_MARKS = ("", "一、", "（1）", "", "2. ", "【治疗】", "①", "")


def _with_marks(marks: Sequence[str]) -> Column:
    table = F.array(*map(F.lit, marks))
    return F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.get(table, i % len(marks)), line)), "\n")


@query(rf"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents
    WHERE length(list_aggregate(list_transform(string_split(text, chr(10)), lambda v, i: {list(SECTION_MARKS)}[(i - 1) % 8 + 1] || v), 'string_agg', chr(10))) >= 50)),
s AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(13)) AS line, CASE i % 8 WHEN 0 THEN '病因' WHEN 2 THEN '治疗' WHEN 4 THEN '预后' WHEN 6 THEN '诊断标准' END AS title FROM l),
n AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM s)
SELECT doc_id, section_no::INTEGER AS section_no, max(title) AS title, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line <> '')) AS content_md5 FROM n GROUP BY doc_id, section_no HAVING count(*) FILTER (WHERE line <> '') > 0""")
def structured_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of documents whose lines begin with titles in four forms."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", _with_marks(SECTION_MARKS))
    return titled_sections(d, "doc_id", "text").select("doc_id", "section_no", "title", F.md5("content").alias("content_md5"))


@query()
def marked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of each level documents have whose lines begin with marks, and their texts' digest (no SQL twin: tests compare by hand)."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", _with_marks(POINT_MARKS))
    p = content_points(d, ["doc_id"], "text")
    return p.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("body_chars"), F.count_if(F.col("title") != "").alias("n_titled"))


@query()
def document_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each document's outline, its lines marked as topics and sections by turns (no SQL twin: tests compare by hand)."""
    marks = ("", "一、甲中毒 ", "【病因】主要", "【治疗】应", "二、乙中毒 ", "【临床表现】可", "", "三、丙中毒 ")
    d = scan(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", _with_marks(marks))
    o = outlines(d, "doc_id", "text").select("doc_id", "grouped", F.size("overview").alias("n_overview"), F.explode_outer("groups").alias("g"))
    return o.groupBy("doc_id", "grouped", "n_overview").agg(F.count("g").alias("n_groups"), F.sum(F.size("g.sections")).alias("n_sections"), F.sum(F.aggregate("g.sections", F.lit(0), lambda n, s: n + F.size(s["digest"]))).alias("n_points"))
