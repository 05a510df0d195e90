"""Rubric scoring: worked cases, and every order recomputed row by row."""

import re

import pytest
from pyspark.sql import functions as F

from studyloom.operators import scoring

SF = "/root/testdata/sf0.001"
NAMED = "struct<action:string,aliases:array<string>,penalty:int>"
SHAPE = f"""submission struct<primaryDiagnosis:string,differentials:array<struct<diagnosis:string,reasoning:string>>,evidence:array<string>,treatments:array<string>>,
truth struct<diagnosis:struct<primary:string,primaryAliases:array<string>>,differentials:array<struct<diagnosis:string,aliases:array<string>,mustExclude:boolean>>,
evidence:array<string>,treatment:struct<critical:array<{NAMED}>,dangerous:array<{NAMED}>>>"""
TRUTH = (
    ("急性前壁ST段抬高型心肌梗死", ["STEMI", "急性前壁心梗"]), [("主动脉夹层", ["夹层"], True), ("肺栓塞", ["PE"], True)],
    ["胸骨后压榨样胸痛", "心率快", "V1-V4 ST段抬高", "肌钙蛋白升高"],
    ([("阿司匹林", ["ASA"], None), ("急诊PCI", ["PCI"], None), ("他汀类药物", ["阿托伐他汀"], None)], [("溶栓", [], 10)]),
)


def scored(spark, *submissions, truth=TRUTH):
    df = spark.createDataFrame([(s, truth) for s in submissions], SHAPE).withColumn("rubric", scoring.default_rubric())
    return scoring.score_submissions(df).collect()


def test_accepts_aliases_and_bounds(spark):
    both = [("主动脉夹层", "需要通过症状和检查排除危险诊断"), ("PE", "需要结合呼吸症状和检查排除")]
    (r,) = scored(spark, ("STEMI", both, TRUTH[2], ["阿司匹林", "急诊PCI", "阿托伐他汀"]))
    assert (r.diagnosis_score, r.evidence_score, r.treatment_score, r.differential_score) == (40, 20, 20, 12)
    assert r.total_score == 92 and r.max_score == 100 and r.grade == "excellent" and r.weaknesses == ["differential"]


def test_negated_and_dangerous_treatments(spark):
    negated, meant, nothing = scored(spark, ("STEMI", [], [], ["不使用溶栓", "急诊PCI"]), ("STEMI", [], [], ["急诊PCI", "阿司匹林", "溶栓"]), (None, None, None, None))
    assert (negated.treatment_score, meant.treatment_score) == (7, 3)  # a third of 20; two thirds less 10
    assert negated.differential_score == 0 and (nothing.total_score, nothing.grade) == (0, "poor")


@pytest.mark.parametrize(
    ("given", "score"),
    [("急性前壁 心梗", 40), ("st elevation MI", 40), ("前壁ST段抬高型心肌梗死", 30), ("陈旧性心肌梗死", 15), ("肺动脉栓塞", 0), ("pulmonary-embolism", 8), ("感冒", 0), ("", 0)],
)
def test_diagnosis_ladder(spark, given, score):
    assert scored(spark, (given, [], [], []))[0].diagnosis_score == score


def test_reasoning_points(spark):
    texts = ["abc", "排除", "需要排除它", "x" * 16, "x" * 31, "排除并检查它", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scoring.reasoning_points(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [0, 0, 1, 1, 2, 2, 0]


def plain(x):
    return re.sub(r"[\s_-]", "", (x or "").lower())  # the tables' names are ASCII


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def like(a, b):
    return bool(a and b) and (a in b or b in a or 1 - distance(a, b) / max(len(a), len(b)) > 0.8)


def by_hand(lines):
    """The scores of one order's lines, (name, type, quantity, discount, tax, flag) in order."""
    names = [plain(x[0]) for x in lines]
    own = {names[-1], plain(lines[-1][1])}
    known = [({plain(n), plain(t)}, q >= 40) for n, t, q, *_ in lines if q >= 20]
    a, b = names[0], names[-1]
    near = min(len(a), len(b)) / max(len(a), len(b), 1) if a in b or b in a else 1 - distance(a, b) / max(len(a), len(b))
    diagnosis = 40 if a in own else 30 if near > 0.7 else 8 if any(a in k for k, _ in known) else 0
    used, points = set(), 0
    for n, t, *_ in lines:
        hit = next((i for i, (k, _) in enumerate(known) if i not in used and plain(n) in k), None)
        if hit is not None:
            used.add(hit)
            points += 4 + (0 if len(t) < 5 else 2 if len(t) > 30 else 1 if len(t) > 15 else 0)
    points -= 3 * sum(must and not any(plain(n) in k for n, *_ in lines) for k, must in known)
    taken = set()
    for n, _, _, _, _, flag in lines:
        hit = next((i for i, w in enumerate(names) if i not in taken and like(plain(n), w)), None) if flag != "N" else None
        taken |= set() if hit is None else {hit}
    given = [plain(x[0]) for x in lines if x[3] >= 0.04]
    fits = lambda g, x: like(g, plain(x[0])) or like(g, plain(x[1]))
    critical = [x for x in lines if x[4] < 0.04]
    met = sum(any(fits(g, c) for g in given) for c in critical)
    lost = sum(10 for d in lines if d[4] >= 0.07 for g in given if fits(g, d))
    treatment = max(0, min(20, (met * 20 / len(critical) if critical else 0) - lost))
    return diagnosis, max(0, min(20, points)), int(len(taken) / len(names) * 20 + 0.5), int(treatment + 0.5)


def test_every_order(spark):
    li, p = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    orders = {}
    for r in li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "p_name", "p_type").collect():
        orders.setdefault(r.l_orderkey, []).append((r.p_name, r.p_type, r.l_quantity, r.l_discount, r.l_tax, r.l_returnflag))
    got = {r.l_orderkey: (r.diagnosis_score, r.differential_score, r.evidence_score, r.treatment_score) for r in scoring.case_scores(spark, SF).collect()}
    assert got == {k: by_hand(v) for k, v in orders.items()} and len(set(got.values())) > 50
