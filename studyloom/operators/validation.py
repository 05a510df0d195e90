"""Validation of JSON records by declarative rules: a list of (path, message, severity) for each record.

A record is parsed once to a VARIANT; every rule is a condition on a path of it, so a record's issues are one
expression and a table of records needs no shuffle. A record that is no JSON object fails every rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

#: Paths that need a text, a list (with its least length) or an object with fields.
TEXTS = ("id", "case_code", "title", "chief_complaint", "demographics.presentationContext", "patient_world.chiefComplaint", "ground_truth.diagnosis.primary")
LISTS = {
    "ground_truth.diagnosis.primaryAliases": 1, "ground_truth.differentials": 2,
    "ground_truth.criticalEvidence.forDiagnosis.fromHistory": 1, "ground_truth.criticalEvidence.forDiagnosis.fromExam": 1, "ground_truth.criticalEvidence.forDiagnosis.fromTests": 1,
    "ground_truth.treatment.immediate": 1, "ground_truth.treatment.definitive": 1, "ground_truth.treatment.dangerous": 1,
}
OBJECTS = ("patient_world.physicalExam", "patient_world.investigations")
#: Objects without which nothing below them is judged.
PARENTS = ("demographics", "patient_world", "patient_world.history", "ground_truth", "ground_truth.diagnosis", "scoring_rubric")
#: The levels, the texts of a history field, and the rubric's weights.
LEVELS, HISTORY_TEXTS, LEAST_HISTORY = ("beginner", "intermediate", "advanced"), ("id", "field", "answer", "patientVoice"), 3
WEIGHTS = {"diagnosis": 40, "differential": 20, "evidence": 20, "treatment": 20}


def _at(v, path: str, kind: str = "variant"):
    return F.try_variant_get(v, "$" + "".join(f".{p}" for p in path.split(".") if p), kind)


def _kind(v, path: str = ""):
    return F.coalesce(F.schema_of_variant(_at(v, path)), F.lit("VOID"))


def _is_object(v, path: str = ""):
    return F.startswith(_kind(v, path), F.lit("OBJECT"))


def _has_text(v, path: str = ""):
    return (_kind(v, path) == "STRING") & (F.trim(F.coalesce(_at(v, path, "string"), F.lit(""))) != "")


def _elements(v, path: str = ""):
    """A list's elements; none of what is no list."""
    return F.when(F.startswith(_kind(v, path), F.lit("ARRAY")), _at(v, path, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _fields(v, path: str):
    return F.when(_is_object(v, path), _at(v, path, "map<string,variant>"))


def _issue(failed, path, message: str, severity: str = "error"):
    path = F.lit(path) if isinstance(path, str) else path
    return F.array_compact(F.array(F.when(F.coalesce(failed, F.lit(True)), F.struct(path.alias("path"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))))


def _under(v, path: str, issues):
    """Issues of ``path`` if all objects above it are there; else those objects' own issues tell enough."""
    above = [p for p in PARENTS if path.startswith(p + ".")]
    fine = F.lit(True)
    for p in above:
        fine = fine & _is_object(v, p)
    return F.when(fine, issues).otherwise(F.array().cast("array<struct<path:string,message:string,severity:string>>"))


def issues(v):
    """The issues of a record (VARIANT)."""
    found = [_under(v, p, _issue(~_is_object(v, p), p, "must be an object")) for p in PARENTS]
    found += [_under(v, p, _issue(~_has_text(v, p), p, "must be a text")) for p in TEXTS]
    found += [_under(v, p, _issue(F.size(_elements(v, p)) < n, p, f"must have {n} elements at least")) for p, n in LISTS.items()]
    found += [_under(v, p, _issue(F.coalesce(F.size(_fields(v, p)), F.lit(0)) < 1, p, "must have a field")) for p in OBJECTS]
    found.append(_issue(~F.coalesce(_at(v, "difficulty", "string"), F.lit("")).isin(*LEVELS), "difficulty", "must be a level"))
    numeric = _kind(v, "demographics.age").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    found.append(_under(v, "demographics.age", _issue(~numeric, "demographics.age", "must be a number")))
    risky = F.exists(_elements(v, "ground_truth.differentials"), lambda d: F.coalesce(_at(d, "mustExclude", "boolean") & (_kind(d, "mustExclude") == "BOOLEAN"), F.lit(False)))
    found.append(_under(v, "ground_truth.differentials", _issue(~risky, "ground_truth.differentials", "one must be excluded")))
    history = F.flatten(F.transform(F.map_values(F.coalesce(_fields(v, "patient_world.history"), F.create_map().cast("map<string,variant>"))), lambda x: _elements(x)))
    at = "patient_world.history.*"
    found.append(_under(v, at, _issue(F.size(history) < LEAST_HISTORY, at, f"must have {LEAST_HISTORY} elements at least")))
    ids = F.transform(F.filter(history, lambda x: _has_text(x, "id")), lambda x: _at(x, "id", "string"))
    found.append(_under(v, at, _issue(F.size(F.array_distinct(ids)) < F.size(ids), f"{at}.id", "must not repeat")))
    each = F.transform(history, lambda x, i: F.when(_is_object(x), F.flatten(F.array(*(_issue(~_has_text(x, t), F.concat(F.lit(f"{at}["), i.cast("string"), F.lit(f"].{t}")), "must be a text") for t in HISTORY_TEXTS)))).otherwise(_issue(F.lit(False), at, "")))
    found.append(_under(v, at, F.flatten(each)))
    weight = {k: _at(v, f"scoring_rubric.{k}.weight", "double") for k in WEIGHTS}
    found += [_under(v, f"scoring_rubric.{k}", _issue(weight[k] != n, f"scoring_rubric.{k}.weight", f"must be {n}")) for k, n in WEIGHTS.items()]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in weight.values()), F.lit(0.0))
    found.append(_under(v, "scoring_rubric.sum", _issue(total != sum(WEIGHTS.values()), "scoring_rubric", "weights must add up")))
    approved = F.coalesce(_at(v, "review_status", "string") == "approved", F.lit(False))
    found += [F.when(approved, _issue(~_has_text(v, p), p, "must be a text")).otherwise(_issue(F.lit(False), p, "")) for p in ("reviewed_by", "reviewed_at")]
    active = F.coalesce(_at(v, "is_active", "boolean") & (_kind(v, "is_active") == "BOOLEAN"), F.lit(False))
    found.append(_issue(~approved & active, "is_active", "must be approved first", "warning"))
    return F.flatten(F.array(*found))


def validated(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with their issues, and ``releasable``: without an error."""
    parsed = records.withColumn("__v", F.try_parse_json(F.col(record)))
    out = parsed.withColumn("issues", issues(F.col("__v"))).drop("__v")
    return out.withColumn("releasable", ~F.exists("issues", lambda x: x["severity"] == "error"))


def release_gate(checked: DataFrame, least: int) -> DataFrame:
    """Counts of records, releasable ones, errors and warnings, and whether at least ``least`` are releasable and none has an error."""
    of = lambda kind: F.coalesce(F.sum(F.size(F.filter("issues", lambda x: x["severity"] == kind))), F.lit(0)).cast("long")
    counted = checked.agg(F.count("*").alias("n"), F.count_if("releasable").alias("n_releasable"), of("error").alias("n_errors"), of("warning").alias("n_warnings"))
    return counted.withColumn("passed", (F.col("n_releasable") >= least) & (F.col("n_errors") == 0))


@query("""
WITH k AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user' AND trim(coalesce(text, '')) <> '') AS asked FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, 'title' AS path FROM k WHERE asked = 0 UNION ALL SELECT conv_id, 'difficulty' FROM k WHERE n > 6
  UNION ALL SELECT conv_id, unnest(['patient_world', 'ground_truth', 'scoring_rubric']) FROM k UNION ALL SELECT conv_id, 'demographics.age' FROM k WHERE n % 2 = 1 UNION ALL SELECT conv_id, 'is_active' FROM k WHERE n > 4)
SELECT path, count(*) AS n, count(DISTINCT conv_id) AS n_records FROM i GROUP BY path""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by path of sketchy records that conversations make: title, level, age and state depend on their turns."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "role", "text")
    k = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("asked"))
    name = F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    record = F.to_json(F.struct(
        name.alias("id"), name.alias("case_code"), F.when(F.col("asked") > 0, name).otherwise(" ").alias("title"), name.alias("chief_complaint"),
        F.when(F.col("n") > 6, "long").otherwise("beginner").alias("difficulty"), (F.col("n") > 4).alias("is_active"),
        F.struct(F.when(F.col("n") % 2 == 0, F.col("n")).alias("age"), F.lit("here").alias("presentationContext")).alias("demographics"),
    ))
    found = validated(k.select("conv_id", record.alias("record"))).select("conv_id", F.explode("issues").alias("x"))
    return found.groupBy(F.col("x.path").alias("path")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_records"))
