import random

import pytest

import corpus_pipeline
from studyloom.llm.toxicity import toxicity
from tests.llm.conftest import DOCS, corpus
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_line_dedup import brute as brute_lines

LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"


def planted():
    """(documents, labels, benchmark) with toxic documents, near copies and leaked items among clean ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("pqrstuvwxyz") for _ in range(6))
    plain, bad = [word() for _ in range(400)], [word() for _ in range(6)]
    say = lambda k: [rng.choice(plain) for _ in range(k)]
    docs = corpus(3, 60)
    items = [(k, " ".join(say(25))) for k in range(5)] + [(50, None), (None, "a b")]
    for i in range(200, 320):
        words = say(80)
        if i % 4 == 0:
            words[10:15] = rng.sample(bad, 5)
        if i % 4 == 1 and i > 210:
            words = docs[-4][1].split()
            words[40] = word()
        if i % 12 == 2:
            words[30:30] = items[i % 5][1].split()
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
    docs += [docs[70], (None, " ".join(say(30)), None, None, None), (None, None, None, None, None)]
    labels = [(r[0], 1, int(r[0] >= 200 and r[0] % 4 == 0)) for r in docs if r[0] is not None and r[0] % 7]
    return docs, labels, items


def save(spark, where, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{where}/benchmark.parquet")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(folder, each stage's documents written and read again, the input first)."""
    where = str(tmp_path_factory.mktemp("tables"))
    save(spark, where, *planted())
    out = [spark.read.parquet(f"{where}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], where).write.parquet(f"{where}/{name}")
        out.append(spark.read.parquet(f"{where}/{name}"))
    return where, out


def key(row):
    return str(row[0]), str(row[1])


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontaminate", "source_mix"]
    assert all(df.columns == steps[1][0].columns for df in steps[1][:-1])


def test_toxicity_rejects(spark, steps):
    where, (docs, kept, *_) = steps
    scored = toxicity(docs, spark.read.parquet(f"{where}/labels.parquet")).where("not is_toxic")
    assert sorted(pairs(kept), key=key) == sorted(pairs(scored), key=key)
    ids = {r.doc_id for r in kept.collect()}
    toxic = {i for i in range(200, 320) if i % 4 == 0}
    assert not ids & toxic and {i for i in range(200, 320)} - toxic <= ids and None in ids


def test_line_dedup_takes_effect(steps):
    _, (_, docs, kept, *_) = steps
    rows = pairs(docs)
    want = [(i, t) for (i, t), (_, before) in zip(brute_lines(rows), rows) if not ((before or "").strip() and i is not None and not (t or "").strip())]
    assert sorted(pairs(kept), key=key) == sorted(want, key=key)
    before = {key((r.doc_id, r.text)) for r in docs.collect()}
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None and key((r.doc_id, r.text)) not in before)
    assert len(want) < len(rows)


def test_jaccard_join_keeps_one_of_each_group(steps):
    _, (_, _, docs, kept, *_) = steps
    rows = pairs(docs)
    want = {i for i, n, c in brute_components(rows, 5, 80, 100) if n == 0 or i == c}
    assert {str(r.doc_id) for r in kept.collect()} == want
    assert set(pairs(kept)) <= set(rows) and kept.count() < docs.count()


def test_decontaminate_removes_leaks(steps):
    _, (_, _, _, docs, kept, _) = steps
    rows = pairs(docs)
    want = [(r[0], t) for r, (_, t) in zip(brute_hits(rows, planted()[2]), rows) if not r[4]]
    assert sorted(pairs(kept), key=key) == sorted(want, key=key) and len(want) < len(rows)


def test_source_mix_lays_out_all(spark, steps):
    _, (*_, docs, mixed) = steps
    assert sorted(pairs(mixed), key=key) == sorted(pairs(docs), key=key)
    slots = [(r.slot, r.position) for r in corpus_pipeline.source_mix(spark, docs, "").collect()]
    assert slots == sorted(slots)


def test_run_is_its_stages(spark, steps):
    where, (*_, last) = steps
    assert sorted(map(str, corpus_pipeline.run(spark, where).collect())) == sorted(map(str, last.collect()))


def test_no_documents_and_no_labels(spark, tmp_path):
    save(spark, f"{tmp_path}/none", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    save(spark, f"{tmp_path}/some", [(1, "one line here", "en", "a", 13), (2, None, None, None, None)], [], [])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == [1, 2]
