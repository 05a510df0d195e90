"""Rubric scoring of submissions against a ground truth: four dimensions, total, grade, strengths and weaknesses.

Rows carry three structs. ``submission``: primaryDiagnosis, differentials (diagnosis, reasoning), evidence, treatments.
``truth``: diagnosis (primary, primaryAliases), differentials (diagnosis, aliases, mustExclude), evidence, and
treatment: critical (action, aliases) and dangerous (action, penalty, aliases). ``rubric``: the points. Everything
is a column expression over one row, so scoring needs no shuffle. A null text counts as empty, a null list as no items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clamp, fuzzy_match, half_up, let, normalised, similarity
from ..plans.registry import Registry
from ..sources.tables import scan
from .folds import greedy_matches

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: Names of one disease.
SYNONYMS = (
    ("stemi", "st段抬高型心肌梗死", "急性前壁心梗", "st elevation mi", "急性st段抬高型心梗"),
    ("nstemi", "非st段抬高型心肌梗死", "non-stemi", "非st段抬高型心梗"),
    ("ami", "急性心肌梗死", "acute mi", "heart attack", "心梗", "急性心梗"),
    ("pe", "肺栓塞", "pulmonary embolism"),
    ("dka", "糖尿病酮症酸中毒", "diabetic ketoacidosis"),
    ("copd", "慢性阻塞性肺疾病", "慢阻肺"),
    ("uti", "尿路感染", "泌尿系感染"),
    ("dvt", "深静脉血栓", "深静脉血栓形成"),
)
#: A treatment that holds one of these is not meant.
NEGATIONS = ("不", "没有", "无", "避免", "不要", "不用", "禁止", "忌", "非")
#: Words that show reasoning.
REASONS = ("诊断", "鉴别", "排除", "支持", "证据", "检查", "治疗", "症状", "体征", "病理", "生理", "机制", "预后", "并发症", "禁忌", "适应证", "指南")
#: Kinds of disease that make a wrong answer near.
KINDS = ("心肌梗死", "心力衰竭", "心律失常", "心绞痛", "肺炎", "肺栓塞", "哮喘", "copd", "糖尿病", "甲亢", "甲减", "脑卒中", "脑梗", "脑出血", "阑尾炎", "胆囊炎", "胰腺炎", "肾衰竭", "尿路感染")
#: The share of a dimension's points from which it is a strength.
STRONG = {"diagnosis": 0.75, "differential": 0.8, "evidence": 0.75, "treatment": 0.75}
#: The grades' least percentages.
GRADES = (("excellent", 90), ("good", 70), ("fair", 50))


def _text(x):
    return F.coalesce(x, F.lit(""))


def _list(x):
    """A list without null items; none for null."""
    return F.filter(F.coalesce(x, F.array()), lambda i: i.isNotNull())


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _groups(groups=SYNONYMS):
    """A map from normalised names to the numbers of their groups."""
    known: dict[str, list[int]] = {}
    for k, group in enumerate(groups):
        for t in group:
            known.setdefault(t, []).append(k)
    return F.map_from_entries(F.array(*(F.struct(normalised(F.lit(t)).alias("key"), F.array(*map(F.lit, ks)).alias("value")) for t, ks in known.items())))


def named(text, groups):
    """A struct (name, groups): a text normalised once, and the groups of synonyms that hold it (``groups``: their map)."""
    name = normalised(_text(text))
    return F.transform(F.array(name), lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at(groups, n), F.array().cast("array<int>")).alias("groups")))[0]


def names(item, main: str, aliases: str, groups):
    """The names of an item, its own and the aliases, as ``named`` structs."""
    return F.transform(F.concat(F.array(_text(item[main])), _list(item[aliases])), lambda x: named(x, groups))


def same_name(given, others):
    """Whether a ``named`` text is equal to one of the others or its synonym."""
    return F.exists(others, lambda x: (given["name"] == x["name"]) | F.arrays_overlap(given["groups"], x["groups"]))


def reasoning_points(text):
    """0 to 2 by how many words of reasoning a text holds, or how long it is."""
    t = _text(text)
    hits = sum((F.contains(F.lower(t), F.lit(w)).cast("int") for w in REASONS), F.lit(0))
    n = F.length(t)
    return F.when(n < 5, 0).when((hits >= 2) | (n > 30), 2).when((hits >= 1) | (n > 15), 1).otherwise(0)


def prepared(submission, truth, groups):
    """All names of a case normalised once, before they are compared with each other: columns for the scores."""
    given = lambda d: F.struct(named(d["diagnosis"], groups).alias("is"), reasoning_points(d["reasoning"]).alias("points"))
    known = lambda d: F.struct(names(d, "diagnosis", "aliases", groups).alias("names"), F.coalesce(d["mustExclude"], F.lit(False)).alias("must"))
    plain = lambda x: normalised(x)
    action = lambda t: F.struct(F.transform(F.concat(F.array(_text(t["action"])), _list(t["aliases"])), plain).alias("names"), _or0(t["penalty"]).alias("penalty"))
    critical = lambda t: F.transform(F.concat(F.array(_text(t["action"])), _list(t["aliases"])), plain)
    meant = lambda g: F.struct(normalised(g).alias("name"), (~_any(F.contains(g, F.lit(w)) for w in NEGATIONS)).alias("meant"))
    return {
        "main": named(submission["primaryDiagnosis"], groups), "primary": normalised(_text(truth["diagnosis"]["primary"])), "own": names(truth["diagnosis"], "primary", "primaryAliases", groups),
        "given": F.transform(_list(submission["differentials"]), given), "known": F.transform(_list(truth["differentials"]), known),
        "shown": F.transform(_list(submission["evidence"]), plain), "wanted": F.transform(_list(truth["evidence"]), plain),
        "treatments": F.transform(_list(submission["treatments"]), meant), "critical": F.transform(_list(truth["treatment"]["critical"]), critical), "dangerous": F.transform(_list(truth["treatment"]["dangerous"]), action),
    }


def diagnosis_score(x, points):
    """The ladder of the main diagnosis: a name or synonym of it, nearly so (over 0.7), of its kind, a differential, wrong."""
    given, main = x["main"]["name"], x["primary"]
    longer = F.greatest(F.length(given), F.length(main))
    near = F.when(F.contains(given, main) | F.contains(main, given), F.least(F.length(given), F.length(main)) / F.greatest(longer, F.lit(1))).otherwise(similarity(given, main))
    kind = _any(F.contains(given, F.lit(k)) & F.contains(main, F.lit(k)) for k in KINDS)
    other = F.exists(x["known"], lambda d: same_name(x["main"], d["names"]))
    return F.when(same_name(x["main"], x["own"]), points["exactMatch"]).when(near > 0.7, points["partialMatch"]).when(kind, points["categoryMatch"]).when(other, points["hitDifferential"]).otherwise(points["wrong"])


def differential_score(x, points):
    """4 points and up to 2 for its reasoning for each given differential that takes one of the truth's, the first still
    free; missingCritical for each that must be excluded and is not named; 0 to the weight."""
    known, given = x["known"], x["given"]

    def step(s, g):
        free = F.filter(F.sequence(F.lit(1), F.greatest(F.size(known), F.lit(1))), lambda i: (i <= F.size(known)) & ~F.array_contains(s["used"], i) & F.coalesce(same_name(g["is"], F.get(known, i - 1)["names"]), F.lit(False)))
        took = lambda i: F.struct(F.when(i.isNotNull(), F.array_append(s["used"], i)).otherwise(s["used"]).alias("used"), F.when(i.isNotNull(), s["points"] + 4 + g["points"]).otherwise(s["points"]).alias("points"))
        return let(F.get(free, F.lit(0)), took)

    met = F.aggregate(given, F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("points")), step)["points"]
    missed = F.filter(known, lambda d: d["must"] & ~F.exists(given, lambda g: same_name(g["is"], d["names"])))
    return clamp(met + F.size(missed) * points["missingCritical"], 0, points["weight"])


def evidence_score(x, points):
    """The share of the truth's evidence that is met, each item once, of the weight."""
    met = F.size(greedy_matches(x["shown"], x["wanted"], fuzzy_match))
    return F.when(F.size(x["wanted"]) > 0, half_up(met / F.size(x["wanted"]) * points["weight"])).otherwise(0).cast("long")


def treatment_score(x, points):
    """An equal share of the weight for each critical treatment that is met, less the penalty of each dangerous one
    for each given treatment that names it without a negation; 0 to the weight."""
    fits = lambda g, named_: F.exists(named_, lambda n: fuzzy_match(g["name"], n))
    met = F.size(F.filter(x["critical"], lambda c: F.exists(x["treatments"], lambda g: fits(g, c))))
    lost = F.aggregate(x["dangerous"], F.lit(0.0), lambda s, d: s + F.size(F.filter(x["treatments"], lambda g: g["meant"] & fits(g, d["names"]))) * d["penalty"])
    gained = F.when(F.size(x["critical"]) > 0, met * points["weight"] / F.size(x["critical"])).otherwise(0.0)
    return half_up(clamp(gained - lost, 0, points["weight"])).cast("long")


def _or0(x):
    return F.coalesce(x, F.lit(0))


def score_submissions(cases: DataFrame) -> DataFrame:
    """``cases`` (submission, truth, rubric) with a score for each dimension, total_score, max_score, grade, strengths and weaknesses."""
    sub, truth, rubric = F.col("submission"), F.col("truth"), F.col("rubric")
    parts = {"diagnosis": diagnosis_score, "differential": differential_score, "evidence": evidence_score, "treatment": treatment_score}
    ready = cases.withColumn("__groups", _groups())
    ready = ready.withColumns({f"__{k}": c for k, c in prepared(sub, truth, F.col("__groups")).items()})
    x = {c[2:]: F.col(c) for c in ready.columns if c.startswith("__")}
    out = ready.withColumns({f"{k}_score": f(x, rubric[k]).cast("long") for k, f in parts.items()}).drop(*(c for c in ready.columns if c.startswith("__")))
    total, most = sum((F.col(f"{k}_score") for k in parts), F.lit(0)), sum((rubric[k]["weight"] for k in parts), F.lit(0))
    strong = F.array(*(F.struct(F.lit(k).alias("name"), (F.col(f"{k}_score") >= rubric[k]["weight"] * share).alias("is")) for k, share in STRONG.items()))
    out = out.withColumns({"total_score": total.cast("long"), "max_score": most.cast("long"), "strengths": F.filter(strong, lambda x: x["is"])["name"], "weaknesses": F.filter(strong, lambda x: ~x["is"])["name"]})
    share = F.when(F.col("max_score") > 0, F.col("total_score") / F.col("max_score") * 100).otherwise(0)
    grade = F.lit("poor")
    for name, least in reversed(GRADES):
        grade = F.when(share >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def default_rubric():
    """The points of the usual rubric, as a struct."""
    number = lambda **kw: F.struct(*(F.lit(v).alias(k) for k, v in kw.items()))
    return F.struct(
        number(weight=40, exactMatch=40, partialMatch=30, categoryMatch=15, hitDifferential=8, wrong=0).alias("diagnosis"),
        number(weight=20, missingCritical=-3).alias("differential"), number(weight=20).alias("evidence"), number(weight=20).alias("treatment"),
    )


@query()
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a case: its lines in two halves, what is answered and what is true (no SQL twin: nested greedy
    folds; tests recompute every order)."""
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    line = F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "p_name", "p_type")
    x = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    all_names = F.col("x.p_name")
    item = lambda key: lambda i: F.struct(i["p_name"].alias(key), F.array(i["p_type"]).alias("aliases"), (i["l_quantity"] >= 40).alias("mustExclude"), F.lit(10).alias("penalty"))
    submission = F.struct(
        F.get(all_names, F.lit(0)).alias("primaryDiagnosis"), F.transform("x", lambda i: F.struct(i["p_name"].alias("diagnosis"), i["p_type"].alias("reasoning"))).alias("differentials"),
        F.filter("x", lambda i: i["l_returnflag"] != "N")["p_name"].alias("evidence"), F.filter("x", lambda i: i["l_discount"] >= 0.04)["p_name"].alias("treatments"),
    )
    truth = F.struct(
        F.struct(F.get(all_names, F.size("x") - 1).alias("primary"), F.array(F.get(F.col("x.p_type"), F.size("x") - 1)).alias("primaryAliases")).alias("diagnosis"),
        F.transform(F.filter("x", lambda i: i["l_quantity"] >= 20), item("diagnosis")).alias("differentials"), all_names.alias("evidence"),
        F.struct(F.transform(F.filter("x", lambda i: i["l_tax"] < 0.04), item("action")).alias("critical"), F.transform(F.filter("x", lambda i: i["l_tax"] >= 0.07), item("action")).alias("dangerous")).alias("treatment"),
    )
    scored = score_submissions(x.select("l_orderkey", submission.alias("submission"), truth.alias("truth"), default_rubric().alias("rubric")))
    return scored.select("l_orderkey", "diagnosis_score", "differential_score", "evidence_score", "treatment_score", "total_score", "grade", F.array_join("weaknesses", ",").alias("weaknesses"))
