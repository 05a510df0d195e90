"""Search and matching: vectors, hybrid ranks, fuzzy ladders, rule classifiers, term leaks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import scan

REGISTRY = Registry()
QUERIES, SQL, query = REGISTRY.queries, REGISTRY.sql, REGISTRY.query

from ..functions.columns import bigrams, cosine, first_rule, fuzzy_match, jaccard, similarity, stable_id, title_key, usable_vector  # noqa: E402

DIM = 64


def nearest(vectors: DataFrame, target, k: int, id_col: str = "vec_id", vector: str = "embedding", size: int = DIM, kept=None) -> DataFrame:
    """The ``k`` rows of largest cosine similarity to a vector (of the rows that the condition ``kept`` holds for, if there is one);
    exact, unusable vectors left out; ties by id."""
    wanted = F.array(*(F.lit(float(x)) for x in target))
    scored = (vectors if kept is None else vectors.where(kept)).where(usable_vector(F.col(vector), size)).withColumn("similarity", cosine(F.col(vector), wanted))
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return scan(spark, sf_dir, "embeddings", "vec_id", "embedding").where("vec_id = 0").first().embedding


@query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors."""
    return nearest(scan(spark, sf_dir, "embeddings", "vec_id", "embedding"), _query_vector(spark, sf_dir), 5).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings
WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY 3 DESC, 1 LIMIT 5""")
def vector_topk_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of one label."""
    v = scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    own = v.where("vec_id = 0").first()
    near = nearest(v, own.embedding, 5, kept=F.col("label") == own.label)
    return near.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def lexical(text, words: list[str]):
    """Share of the query's distinct words that a text has."""
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.size(F.array_intersect(tokens, F.array(*(F.lit(w) for w in words)))) / len(words)


@query(r"""
WITH s AS (SELECT doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS sim,
  len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+')), ['the', 'of', 'and'])) / 3.0 AS lex FROM documents JOIN embeddings ON vec_id = doc_id)
SELECT doc_id, round(sim, 6) AS similarity, round(CAST(lex AS DOUBLE), 6) AS lexical, round(0.7 * sim + 0.3 * CAST(lex AS DOUBLE), 6) AS score FROM s WHERE lex > 0 OR 1 - sim < 0.3 ORDER BY 4 DESC, 1 LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and word ranks mixed 7 : 3, over rows that match by either."""
    v = scan(spark, sf_dir, "embeddings", "vec_id", "embedding")
    j = scan(spark, sf_dir, "documents", "doc_id", "text").join(v, F.col("doc_id") == F.col("vec_id"))
    wanted = F.array(*(F.lit(float(x)) for x in _query_vector(spark, sf_dir)))
    s = j.select("doc_id", cosine(F.col("embedding"), wanted).alias("sim"), lexical(F.col("text"), ["the", "of", "and"]).alias("lex")).where("lex > 0 or 1 - sim < 0.3")
    score = F.round(0.7 * F.col("sim") + 0.3 * F.col("lex"), 6)
    return s.select("doc_id", F.round("sim", 6).alias("similarity"), F.round("lex", 6).alias("lexical"), score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("""
SELECT * FROM (SELECT 'node' AS origin, p_partkey AS id FROM part WHERE contains(lower(p_name), 'al') ORDER BY p_partkey LIMIT 5) UNION ALL SELECT * FROM (
  SELECT 'chunk', vec_id FROM embeddings ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 12) DESC, vec_id LIMIT 5)""")
def two_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five substring hits and five nearest chunks, tagged by origin."""
    nodes = scan(spark, sf_dir, "part", "p_partkey", "p_name").where(F.lower("p_name").contains("al")).orderBy("p_partkey").limit(5).select(F.lit("node").alias("origin"), F.col("p_partkey").alias("id"))
    near = nearest(scan(spark, sf_dir, "embeddings", "vec_id", "embedding"), _query_vector(spark, sf_dir), 5)
    return nodes.unionByName(near.select(F.lit("chunk").alias("origin"), F.col("vec_id").alias("id")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64 AND sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) >= 1e-6) AS usable FROM embeddings")
def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "embeddings", "embedding").agg(F.count("*").alias("n"), F.count_if(usable_vector(F.col("embedding"), DIM)).alias("usable"))


def rare_first(grams: DataFrame) -> DataFrame:
    """(name, gram, need) with ``at``, the gram's place in its name's list, the rarest of all names first."""
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    listed = grams.join(often, "gram").groupBy("name", "need").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
    return listed.select("name", "need", F.size("g").alias("size"), F.posexplode("g").alias("at", "x")).select("name", "need", "size", "at", F.col("x.gram").alias("gram"))


def sharing(grams: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of names with at least ``need`` grams in common, and some others, to be verified.

    grams: (name, gram, need), grams distinct within a name. A name's first size - need + 1 grams, rarest first,
    hold one of any ``need`` that it shares, so only these are joined."""
    first = rare_first(grams).where("at <= size - need").select("name", "gram")
    x, y = first.select(F.col("name").alias("a"), "gram"), first.select(F.col("name").alias("b"), "gram")
    return x.join(y, "gram").where("a < b").select("a", "b").distinct()


def _numbered_bigrams(name):
    """Bigrams with how often each came before, so that repeats count."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - 1)), lambda i: F.substring(name, i, F.lit(2)))
    return F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of distinct names (name) that are equal but for edits, similar beyond ``least`` (over 0.5), or
    one of which holds the other.

    Candidates lose nothing: texts of length L that are similar share (2 least - 1) L bigrams at least; texts too
    short for that meet in what is left after the edits they may differ by; and a text holds the rarest bigram of
    every text inside it."""
    if least <= 0.5:
        raise ValueError("similarity must be over 0.5")
    n = names.where("length(name) > 0").select("name", F.length("name").alias("size"))
    need = F.greatest(F.lit(1), F.floor((2 * least - 1) * F.col("size") + 1e-9)).cast("long")
    grams = n.where("size > 1").select("name", need.alias("need"), F.explode(_numbered_bigrams(F.col("name"))).alias("gram"))
    short = math.ceil(1 / (2 * least - 1) - 1e-9) - 1
    cut = n.where(F.col("size") <= short).select("name", F.col("name").alias("rest"))
    for _ in range(math.ceil(short * (1 - least) - 1e-9) - 1):
        fewer = F.explode(F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substr("rest", i + 1))))
        cut = cut.union(cut.where("length(rest) > 0").select("name", fewer)).distinct()
    near = cut.select(F.col("name").alias("a"), "rest").join(cut.select(F.col("name").alias("b"), "rest"), "rest").where("a < b").select("a", "b")
    every = n.where("size > 1").select("name", F.lit(1).alias("need"), F.explode(bigrams(F.col("name"))).alias("gram")).union(n.where("size = 1").select("name", F.lit(1), F.col("name")))
    listed = rare_first(every)
    letters = n.where("size > 1").select("name", F.explode(F.array_distinct(F.split("name", ""))).alias("gram"))
    held = listed.where("at = 0").select(F.col("name").alias("x"), "gram").join(listed.select("name", "gram").union(letters), "gram").where(F.contains("name", "x") & (F.col("name") != F.col("x")))
    inside = held.select(F.least("x", "name").alias("a"), F.greatest("x", "name").alias("b"))
    found = sharing(grams).union(near).union(inside).distinct()
    return found.where(fuzzy_match(F.col("a"), F.col("b"), least))


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS sim
FROM n a JOIN n b ON a.name < b.name WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) > 0.6""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All similar names."""
    j = similar_names(scan(spark, sf_dir, "part", F.col("p_name").alias("name")).distinct(), 0.6)
    return j.select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(similarity(F.col("a"), F.col("b")), 6).alias("sim"))


def match_ladder(wanted: DataFrame, known: DataFrame, prefix: int = 6) -> DataFrame:
    """(name, target, rung): the best match of each wanted name: equal (1), equal as a title key (2), equal in the
    first characters (4); within a rung the first known one by pos. One equality join a rung."""
    keyed = [("1", lambda c: c), ("2", title_key), ("4", lambda c: F.substring(title_key(c), 1, prefix))]
    found = None
    for rung, key in keyed:
        hit = wanted.withColumn("__k", key(F.col("name"))).join(known.select(key(F.col("target")).alias("__k"), "target", "pos"), "__k").select("name", "target", "pos", F.lit(int(rung)).alias("rung"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("name").agg(F.min(F.struct("rung", "pos", "target")).alias("x"))
    return wanted.select("name").join(best, "name", "left").select("name", F.col("x.target").alias("target"), F.col("x.rung").alias("rung"))


@query("""
WITH k AS (SELECT p_name AS target, min(p_partkey) AS pos FROM part GROUP BY 1), n AS (SELECT DISTINCT p_name AS name FROM part),
w AS (SELECT name FROM n UNION SELECT upper(left(name, 1)) || substr(name, 2) FROM n UNION SELECT name || ' more' FROM n UNION SELECT 'no ' || name FROM n),
c AS (SELECT name, target, pos, 1 AS rung FROM w JOIN k ON name = target UNION ALL SELECT name, target, pos, 2 FROM w JOIN k ON lower(replace(name, ' ', '')) = lower(replace(target, ' ', ''))
  UNION ALL SELECT name, target, pos, 4 FROM w JOIN k ON left(lower(replace(name, ' ', '')), 6) = left(lower(replace(target, ' ', '')), 6))
SELECT w.name, target, rung FROM w LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY rung, pos, target) = 1) USING (name)""")
def name_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are, with a capital, with a word after and with one before, matched to all known names."""
    p = scan(spark, sf_dir, "part", "p_partkey", "p_name")
    known = p.groupBy(F.col("p_name").alias("target")).agg(F.min("p_partkey").alias("pos"))
    name = F.col("target")
    forms = F.array(name, F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))), F.concat(name, F.lit(" more")), F.concat(F.lit("no "), name))
    return match_ladder(known.select(F.explode(forms).alias("name")).distinct(), known)


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct([substr(name, i, 2) FOR i IN generate_series(1, length(name) - 1)]) AS b FROM n)
SELECT * FROM (SELECT x.name AS a, y.name AS b, round(len(list_intersect(x.b, y.b)) / CAST(len(x.b) + len(y.b) - len(list_intersect(x.b, y.b)) AS DOUBLE), 6) AS sim FROM g x JOIN g y ON x.name < y.name) WHERE sim >= 0.5""")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of names whose bigrams have a similarity of 0.5 or more."""
    n = scan(spark, sf_dir, "part", F.col("p_name").alias("name")).distinct().withColumn("g", bigrams(F.col("name")))
    pairs = sharing(n.select("name", F.ceil(F.size("g") / 2).alias("need"), F.explode("g").alias("gram")))
    scored = pairs.select("a", "b", F.round(jaccard(bigrams(F.col("a")), bigrams(F.col("b"))), 6).alias("sim"))
    return scored.where("sim >= 0.5")


@query("SELECT p_partkey, 'kn-' || substr(sha256(p_brand || chr(0) || p_type || chr(0) || coalesce(p_name, '')), 1, 20) AS node_id FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name")
    return p.select("p_partkey", stable_id([F.col("p_brand"), F.col("p_type"), F.col("p_name")], "kn-").alias("node_id"))


#: Rules in order: name, intent, target, confidence, the phases in which it holds (none: all) and patterns. A table to
#: be replaced by an application's own; these few fit the conversations.
INTENTS = [
    ("greeting", "greeting", None, 0.95, (), (r"(?i)^(hello|hi|hey)\b",)),
    ("question", "ask_history", "open", 0.8, ("user",), (r"\?", r"(?i)^(what|why|how|when|where|who)\b")),
    ("request", "order_test", "request", 0.9, ("user",), (r"(?i)\b(please|could you|can you)\b",)),
    ("instruction", "phase_transition", None, 0.85, ("system",), (r"(?i)\byou\b",)),
    ("list", "mention_treatment", "list", 0.85, ("assistant",), (r"(^| )(\d+\.|-) ",)),
    ("short", "mention_diagnosis", None, 0.85, ("assistant", "intro"), (r"^.{0,80}$",)),
]
#: The intents whose rules hold in the first phase whatever their own phases, and what ends a text.
OPENING, ENDS = ("ask_history", "unknown"), r"[,，。.！!？?]+$"


def parse_intent(text, phase, rules=INTENTS):
    """A struct (type, target, confidence, rule, needs_model): the first rule that holds in the phase and one of whose
    patterns is found in the text without its end marks; empty texts are ``empty``, others ``unknown`` for a model."""
    shape = lambda kind, target, sure, rule, model: F.struct(F.lit(kind).alias("type"), F.lit(target).cast("string").alias("target"), F.lit(float(sure)).alias("confidence"), F.lit(rule).cast("string").alias("rule"), F.lit(model).alias("needs_model"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), ENDS, ""), r"\s+", " ")
    out = shape("unknown", None, 0, None, True)
    for name, kind, target, sure, phases, patterns in reversed(rules):
        held = F.lit(True) if not phases else phase.isin(*phases, *(("intro",) if kind in OPENING else ()))
        found = F.rlike(clean, F.lit("|".join(f"(?:{p})" for p in patterns)))
        out = F.when(F.coalesce(held, F.lit(False)) & found, shape(kind, target, sure, name, False)).otherwise(out)
    return F.when(clean == "", shape("empty", None, 1, None, False)).otherwise(out)


def _intent_sql() -> str:
    clean = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '[,，。.！!？?]+$', ''), '\s+', ' ', 'g')"
    rules = " ".join(f"WHEN {'true' if not ph else 'role IN (' + ', '.join(repr(x) for x in (*ph, *(('intro',) if kind in OPENING else ()))) + ')'} AND regexp_matches(c, '{'|'.join(f'(?:{p})' for p in pats)}') THEN '{name}'" for name, kind, _, _, ph, pats in INTENTS)
    return f"SELECT role, CASE WHEN c = '' THEN 'empty' {rules} ELSE 'unknown' END AS intent, count(*) AS n FROM (SELECT role, {clean} AS c FROM conversations) GROUP BY ALL"


@query(_intent_sql())
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule holds, the speaker standing for the phase."""
    c = scan(spark, sf_dir, "conversations", "role", "text").withColumn("i", parse_intent(F.col("text"), F.col("role")))
    return c.groupBy("role", F.coalesce("i.rule", "i.type").alias("intent")).agg(F.count("*").alias("n"))


#: What in an input is meant to change a model's instructions.
INJECTION = [
    r"(?i)ignore (all |any )?(previous|prior|above) instructions", r"(?i)system (prompt|message|instruction)", r"(?i)developer (prompt|message|instruction)",
    r"(?i)jailbreak|prompt injection", r"(?i)reveal (the )?(diagnosis|answer|rubric)", r"(?i)act as (a )?(doctor|clinician|system)",
    r"忽略.{0,8}(之前|以上|前面).{0,8}(指令|要求|规则)", r"(系统|开发者).{0,4}(提示词|消息|指令)", r"(告诉|泄露|输出|显示).{0,8}(诊断|答案|评分规则|标准答案)",
    r"(跳出|退出|忘记).{0,6}(患者|角色|设定)", r"越狱|提示词注入",
]
#: Advice that an output must not give.
UNSAFE = [
    r"(我建议你|你应该|你需要).{0,20}(服用|使用|停用|加量|减量|治疗|手术)", r"(治疗方案|处方|用药建议)(是|包括|：|:)",
    r"(?i)\b(i recommend|you should|you need to)\b.{0,40}\b(take|stop|increase|decrease|treat|surgery)\b",
]


def first_pattern(text, patterns: list[str]):
    """The first of the patterns that a text holds, else null. All are tried only where one of them is found at all."""
    at_all = F.rlike(text, F.lit("|".join(f"(?:{p})" for p in patterns)))
    return F.when(at_all, first_rule(text, [(p, p) for p in patterns]))


def _pattern_sql(patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{p}'" for p in patterns) + " END"


@query(f"SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN {_pattern_sql(INJECTION)} END AS injection, CASE WHEN role = 'assistant' THEN {_pattern_sql(UNSAFE)} END AS unsafe FROM conversations")
def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that try to change the instructions and outputs that give unsafe advice."""
    c = scan(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.col("role") == "assistant"
    return c.select("conv_id", "turn", "role", F.when(~said, first_pattern(F.col("text"), INJECTION)).alias("injection"), F.when(said, first_pattern(F.col("text"), UNSAFE)).alias("unsafe"))
