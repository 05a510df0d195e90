import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studyloom.llm.chat_format import LAYOUTS, canonical_turns, conversation_records, fingerprint, format_turns, op10_chat_format, paths, read_back, registry

CONVERSATIONS = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_end|>", "[\\\\INST]", "<s", "|>", "a\\", "\\", "<|", "", "\n", "%0A", "%25", "é\U0001f600<|x", "<s><s></s>", "[[INST]]", "$1 \\1"]


def read(spark, turns):
    """What comes back of lists of (role, text) after formatting, and the formatted texts."""
    rows = [(i, [{"role": r, "text": t} for r, t in x]) for i, x in enumerate(turns)]
    got = read_back(format_turns(spark.createDataFrame(rows, "i int, turns array<struct<role:string,text:string>>"))).orderBy("i").collect()
    return [[(t.role, t.text) for t in r.read_turns] for r in got], [r.loss_texts for r in got], [r.formatted for r in got]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(3)
    turns = [[(rng.choice(["user", "assistant", *NASTY]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))] for _ in range(400)]
    back, loss, formatted = read(spark, turns)
    assert back == turns
    assert loss == [[t for r, t in x if r == "assistant"] for x in turns]
    for text, x in zip(formatted, turns):  # only the template's own marks are left unescaped
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == text.count("<|") // 2 == len(x)
        assert "[INST]" not in text and "</s>" not in text


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|%0A\n"]), st.text(st.sampled_from("<[|/s>INT]\\$1é\n%"), max_size=12)), max_size=3), min_size=20, max_size=40))
def test_round_trip_of_any_text(spark, turns):
    back, loss, _ = read(spark, turns)
    assert back == turns and loss == [[t for r, t in x if r == "assistant"] for x in turns]


def test_loss_spans_count_code_points(spark):
    rows = [([{"role": "user", "text": "\U0001f600"}, {"role": "assistant", "text": "a\U0001f600<|"}],)]
    r = format_turns(spark.createDataFrame(rows, "turns array<struct<role:string,text:string>>")).first()
    ((start, length),) = [(s.start, s.length) for s in r.loss_spans]
    assert r.formatted[start : start + length] == "a\U0001f600<\\|"


def test_fingerprints_depend_on_structure_only():
    assert paths({"a": [{"b": 1, "c": None}, {"b": "x"}], "d": {}, "e": []}) == {"a[].b", "a[].c", "d{}", "e[]"}
    assert len(registry()) == len(LAYOUTS)
    assert fingerprint(paths({"prompt": "p", "response": "r"})) in registry()
    assert fingerprint(paths({"response": 2, "prompt": None})) == fingerprint(paths({"prompt": "p", "response": "r"}))


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": {"k": "é"}}]}, None),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "q", "output": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "q", "input": "about", "output": None}, [("user", "q"), ("user", "about")]),
        ({"system": "s", "instruction": "q", "output": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"id": 1, "prompt": "q", "response": "a", "meta": {"k": [1]}}, [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "response": "a", "system": None, "history": []}, [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "response": 7}, [("system", "s"), ("user", "q"), ("assistant", "7")]),
        ({"other": 1}, None),
    ],
)
def test_layouts(spark, record, turns):
    r = canonical_turns(spark.createDataFrame([(json.dumps(record),)], "record string")).first()
    assert r.fingerprint == fingerprint(paths(record))
    assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == turns


def test_unknown_and_broken_records(spark):
    rows = [(None,), ("",), ("{",), ("[1]",), ("null",), ("{}",)]
    df = spark.createDataFrame(rows, "record string").selectExpr("*", "1 as Turns", "2 as FINGERPRINT", "'k' as extra", "3 as formatted")
    got = read_back(format_turns(canonical_turns(df))).collect()
    assert len(got) == len(rows) and all(r.turns is None and r.formatted == "" and r.read_turns == [] and r.loss_texts == [] and r.extra == "k" for r in got)
    assert canonical_turns(spark.createDataFrame([], "record string")).collect() == []


def test_deep_records_and_half_surrogates(spark):
    deep = [(json.dumps({"prompt": "q", "response": "a"})[:-1] + ', "x": ' + "[" * n + "]" * n + "}",) for n in (150, 600, 100_000)]
    half = [('{"prompt": "a\\ud800b", "response": "\\ud83d\\ude00"}',), ('{"\\udfff": 1}',)]
    got = canonical_turns(spark.createDataFrame(deep + half, "record string")).collect()
    assert [r.turns for r in got[:3]] == [None] * 3 and got[1].fingerprint == got[2].fingerprint == fingerprint(())
    assert [t.text for t in got[3].turns] == ["a?b", "\U0001f600"] and got[4].turns is None


def brute(rows):
    """The contract's columns but formatted_chars, of rows of (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        said = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        out[c] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([*range(60), None]), rng.choice([0, 1, 1, 2, 3, None]), rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([None, "x" * 100_000, *NASTY])) for _ in range(300)]
    rows += rows[:20] + [(100, 0, "user", "q"), (100, 1, "assistant", "a"), (101, 0, "system", None), (101, 1, "user", "<|"), (101, 2, "assistant", "</s>")]
    spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as record", "2 as turns").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat_format(spark, str(tmp_path)).collect()}
    assert got == brute(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_query_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    (own,) = op10_chat_format(spark, str(tmp_path)).collect()
    assert (own.conv_id, own.n_turns, own.loss_chars) == (-7, 2, 21)


def test_records_use_several_layouts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "user", "q")]
    got = {r.conv_id: set(json.loads(r.record)) for r in conversation_records(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert got == {1: {"prompt", "response"}, 2: {"system", "prompt", "response"}, 3: {"messages"}}
