"""10. Chat formatting by schema fingerprints.

A record is a JSON object in one of many layouts. Its fingerprint is a digest of its nested field
paths (``messages[].role`` ...), and a registry maps fingerprints to declarative mappings that say
where the turns are. So a layout is recognised by structure, without looking at values, and a record of
an unknown layout is kept with null turns and its fingerprint, ready for a new mapping.

Canonical turns are formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and
texts are escaped by a backslash after their first character, one more than they already have, which
undoes exactly; a role's percent signs and line feeds are percent-encoded as well. The loss mask is the list of
(start, length) code-point spans of assistant texts. Formatting and reading back are DataFrame functions;
only the fingerprint walks JSON in an Arrow function.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), so ties and
repeated rows have a fixed order; a record that is null or no JSON object has the fingerprint of no
paths and null turns, as has one nested more than DEPTH levels deep; half of a surrogate pair in a text
becomes a question mark; a conversation id may be null (one conversation); extra columns of records pass
through and those named as a result give way. A conversation is one record, so its turns meet in one row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

#: Control strings: the template's own and those of common templates, without their first character.
#: Fixed values, shared with the SQL below; no string holds the first character of another.
CONTROL = r"\||/?s>|/?INST\]"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*)({CONTROL})", rf"([<\[])\\(\\*)({CONTROL})"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


#: Values nested deeper than this are not walked: the record has the layout of no paths.
DEPTH = 200
#: Fields beside the turns that any record may have; they are no part of its layout.
ASIDE = frozenset(("id", "conv_id", "conversation_id", "uuid", "source", "dataset", "lang", "language", "meta", "metadata", "tags", "timestamp", "created_at"))


def paths(record, aside: frozenset = ASIDE) -> set[str]:
    """The nested field paths of a JSON value; elements of arrays share the path ``[]``. Fields of the record itself
    that are ``aside`` have none."""
    found, todo = set(), [("", record, 0)]
    while todo:
        at, value, depth = todo.pop()
        if depth > DEPTH:
            raise ValueError("nested too deeply")
        if isinstance(value, dict):
            inner = [(f"{at}.{k}" if at else k, v) for k, v in value.items() if at or k not in aside]
            found |= {at + "{}"} if at and not inner else set()
        elif isinstance(value, list):
            inner = [(at + "[]", v) for v in value]
            found |= {at + "[]"} if not inner else set()
        else:
            inner = []
            found.add(at)
        todo += [(p, v, depth + 1) for p, v in inner]
    return found


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "replace")).hexdigest()[:16]


def messages(at: str, role: str, text: str, names: dict[str, str] | None = None) -> dict:
    """A mapping for a list of messages under ``at``; ``names`` renames roles."""
    return {"list": at, "role": role, "text": text, "names": names or {}}


def fields(*pairs: tuple[str, str]) -> dict:
    """A mapping for turns in fields of their own: (role, field), in order; a null field is no turn."""
    return {"fields": pairs}


#: Layouts: the field paths of each, beside the record's ASIDE fields, and its mapping. An instruction is what the
#: user asks, in every layout; an input is what it is about and follows it.
LAYOUTS: list[tuple[tuple[str, ...], dict]] = [
    (("messages[].role", "messages[].content"), messages("messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    (("prompt", "completion"), fields(("user", "prompt"), ("assistant", "completion"))),
    (("prompt", "response"), fields(("user", "prompt"), ("assistant", "response"))),
    (("instruction", "output"), fields(("user", "instruction"), ("assistant", "output"))),
    (("instruction", "input", "output"), fields(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    (("system", "prompt", "response"), fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    (("system", "instruction", "output"), fields(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
]


def registry(layouts=LAYOUTS) -> dict[str, dict]:
    return {fingerprint(found): mapping for found, mapping in layouts}


def _turns(record: dict, mapping: dict) -> list[dict]:
    def text(x) -> str:
        said = x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
        return said.encode("utf-8", "replace").decode()  # half of a surrogate pair is no character: ?

    if "list" in mapping:
        return [{"role": mapping["names"].get(text(m.get(mapping["role"])), text(m.get(mapping["role"]))), "text": text(m.get(mapping["text"]))} for m in record[mapping["list"]]]
    return [{"role": role, "text": text(record.get(name))} for role, name in mapping["fields"] if record.get(name) is not None]


def canonical_turns(records: DataFrame, record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """``records`` with fingerprint and turns (null for an unknown layout)."""
    known = registry(layouts)
    clash = [c for c in records.columns if c.lower() in ("fingerprint", "turns", "__got")]

    @F.pandas_udf(T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("turns", TURNS)]))
    def select(column):
        import pandas as pd

        marks, turns = [], []
        for raw in column:
            try:
                record = json.loads(raw) if raw is not None else None
                record = record if isinstance(record, dict) else {}
                mark = fingerprint(paths(record))
            except (ValueError, RecursionError):  # no JSON, or nested too deeply
                record, mark = {}, fingerprint(())
            # optional fields that are left open don't make another layout
            mapping = known.get(mark) or known.get(fingerprint(paths({k: v for k, v in record.items() if v not in (None, [], {})})))
            marks.append(mark)
            turns.append(None if mapping is None else _turns(record, mapping))
        return pd.DataFrame({"fingerprint": marks, "turns": turns})

    return records.drop(*clash).withColumn("__got", select(F.col(record_col))).withColumns({"fingerprint": F.col("__got.fingerprint"), "turns": F.col("__got.turns")}).drop("__got")


def escape(text):
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _role(text):
    return F.replace(F.replace(escape(text), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(text):
    return unescape(F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``records`` with formatted (the template's text) and loss_spans (assistant texts, from code point 0)."""
    turns = F.coalesce(F.col(turns_col), F.array().cast(TURNS))
    parts = F.transform(turns, lambda t: F.struct((F.length(_role(F.coalesce(t["role"], F.lit("")))) + F.lit(len("<|im_start|>\n"))).alias("head"), F.length(escape(F.coalesce(t["text"], F.lit("")))).alias("body"), (t["role"] == F.lit("assistant")).alias("loss")))
    tail = len("<|im_end|>\n")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        parts, begin,
        lambda acc, p: F.struct((acc["at"] + p["head"] + p["body"] + F.lit(tail)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans")),
    )["spans"]
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), _role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escape(F.coalesce(t["text"], F.lit(""))), F.lit("<|im_end|>\n"))), "")
    return records.withColumns({"formatted": text, "loss_spans": spans})


def read_back(records: DataFrame) -> DataFrame:
    """``records`` with read_turns and loss_texts, from formatted and loss_spans alone."""
    pieces = F.slice(F.split(F.col("formatted"), r"<\|im_start\|>"), 2, F.lit(2**30))
    turns = F.transform(pieces, lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + F.lit(1), F.length(p) - F.locate("\n", p) - F.lit(len("<|im_end|>\n")))).alias("text")))
    loss = F.transform(F.col("loss_spans"), lambda s: unescape(F.substring(F.col("formatted"), s["start"] + F.lit(1), s["length"])))
    return records.withColumns({"read_turns": turns, "loss_texts": loss})


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON records, in the layout that their roles allow.

    A user's text and an answer become prompt and response, with a system text before them system, prompt and
    response; all others are lists of messages."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.col("t.role")
    pair, triple = roles == F.array(F.lit("user"), F.lit("assistant")), roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    record = (
        F.when(pair, F.to_json(F.struct(F.get(F.col("t.text"), F.lit(0)).alias("prompt"), F.get(F.col("t.text"), F.lit(1)).alias("response"))))
        .when(triple, F.to_json(F.struct(F.get(F.col("t.text"), F.lit(0)).alias("system"), F.get(F.col("t.text"), F.lit(1)).alias("prompt"), F.get(F.col("t.text"), F.lit(2)).alias("response"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))))
    )
    return convs.select("conv_id", record.alias("record"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    got = read_back(format_turns(canonical_turns(conversation_records(rows))))
    all_turns = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return got.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS e,
  replace(replace(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'), '%', '%25'), chr(10), '%0A') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(r) + 1 + length(e) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
