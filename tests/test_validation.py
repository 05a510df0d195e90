"""Record validation: a whole record, and one change at a time."""

import copy
import json

import pytest

from studyloom.operators import validation

RECORD = {
    "id": "c1", "case_code": "c1", "title": "t", "chief_complaint": "pain", "difficulty": "beginner", "demographics": {"age": 60, "presentationContext": "came in"},
    "patient_world": {
        "chiefComplaint": "pain", "history": {"now": [{"id": f"h{i}", "field": "f", "answer": "a", "patientVoice": "v"} for i in range(3)], "note": "no list"},
        "physicalExam": {"signs": {"findings": []}}, "investigations": {"ecg": {"result": "odd"}},
    },
    "ground_truth": {
        "diagnosis": {"primary": "A", "primaryAliases": ["a"]}, "differentials": [{"diagnosis": "B", "mustExclude": True}, {"diagnosis": "C", "mustExclude": False}],
        "criticalEvidence": {"forDiagnosis": {"fromHistory": ["x"], "fromExam": ["y"], "fromTests": ["z"]}}, "treatment": {"immediate": [{}], "definitive": [{}], "dangerous": [{}]},
    },
    "scoring_rubric": {"diagnosis": {"weight": 40}, "differential": {"weight": 20}, "evidence": {"weight": 20}, "treatment": {"weight": 20}},
    "is_active": True, "review_status": "approved", "reviewed_by": "me", "reviewed_at": "2026-06-11",
}
GONE = object()
CHANGES = [
    ([], None, []),
    (["title"], "  ", ["title"]), (["id"], 7, ["id"]), (["difficulty"], "hard", ["difficulty"]), (["difficulty"], GONE, ["difficulty"]),
    (["demographics"], [], ["demographics"]), (["demographics", "age"], "60", ["demographics.age"]), (["demographics", "age"], 1.5, []),
    (["patient_world"], None, ["patient_world"]), (["patient_world", "history"], 1, ["patient_world.history"]),
    (["patient_world", "history", "now"], [], ["patient_world.history.*"]),
    (["patient_world", "history", "now", 1, "id"], "h0", ["patient_world.history.*.id"]),
    (["patient_world", "history", "now", 1, "answer"], "", ["patient_world.history.*[1].answer"]),
    (["patient_world", "physicalExam"], {}, ["patient_world.physicalExam"]), (["patient_world", "investigations"], GONE, ["patient_world.investigations"]),
    (["ground_truth"], "x", ["ground_truth"]), (["ground_truth", "diagnosis"], GONE, ["ground_truth.diagnosis"]),
    (["ground_truth", "differentials", 0, "mustExclude"], "true", ["ground_truth.differentials"]),
    (["ground_truth", "differentials"], [{"mustExclude": True}], ["ground_truth.differentials"]),
    (["ground_truth", "criticalEvidence"], None, [f"ground_truth.criticalEvidence.forDiagnosis.from{x}" for x in ("Exam", "History", "Tests")]),
    (["ground_truth", "treatment", "dangerous"], [], ["ground_truth.treatment.dangerous"]),
    (["scoring_rubric", "evidence", "weight"], 25, ["scoring_rubric", "scoring_rubric.evidence.weight"]), (["scoring_rubric"], GONE, ["scoring_rubric"]),
    (["reviewed_by"], GONE, ["reviewed_by"]), (["review_status"], "draft", ["is_active"]),
]


def changed(path, value):
    record = copy.deepcopy(RECORD)
    at = record
    for p in path[:-1]:
        at = at[p]
    if path and value is GONE:
        del at[path[-1]]
    elif path:
        at[path[-1]] = value
    return json.dumps(record)


def test_one_change_at_a_time(spark):
    rows = [(i, changed(path, value)) for i, (path, value, _) in enumerate(CHANGES)]
    got = {r.i: r for r in validation.validated(spark.createDataFrame(rows, "i int, record string")).collect()}
    for i, (path, _, want) in enumerate(CHANGES):
        assert sorted(x.path for x in got[i].issues) == sorted(want), path
        assert got[i].releasable == (not want or want == ["is_active"])


def test_no_records_and_no_json(spark):
    df = spark.createDataFrame([(None,), ("{",), ("[1]",), ("{}",)], "record string")
    got = validation.validated(df).collect()
    assert all(not r.releasable and {"id", "patient_world", "difficulty"} <= {x.path for x in r.issues} for r in got)


@pytest.mark.parametrize(("rows", "least", "passed"), [([changed([], None)] * 3, 3, True), ([changed([], None)] * 2, 3, False), ([changed([], None)] * 3 + ["{}"], 3, False), ([], 0, True)])
def test_release_gate(spark, rows, least, passed):
    checked = validation.validated(spark.createDataFrame([(r,) for r in rows], "record string"))
    assert validation.release_gate(checked, least).first().passed == passed
