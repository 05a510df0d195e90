import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import line_crf as C
from studyloom.llm.kernels import buffers


def column(texts):
    import pyarrow as pa

    return buffers(pa.array(texts, pa.string()))


def enumerated(emission, transition):
    """Marginals and pair sums of one chain by listing all its labellings."""
    n = len(emission)
    good, pairs, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for path in itertools.product((0, 1), repeat=n):
        score = np.exp(sum(e for e, x in zip(emission, path, strict=True) if x) + sum(transition[a, b] for a, b in itertools.pairwise(path)))
        total += score
        good += score * np.array(path)
        for t in range(1, n):
            pairs[t, path[t - 1], path[t]] += score
    return good / total, pairs / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 8, 1, 3, 10]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, transition = rng.normal(0, 3, first[-1]), rng.normal(0, 2, (2, 2))
    good, pairs = C.marginals(emission, transition, first, pairs=True)
    for a, b in itertools.pairwise(first):
        want = enumerated(emission[a:b], transition)
        assert np.allclose(good[a:b], want[0]) and np.allclose(pairs[a:b], want[1].reshape(-1, 4))
    extreme = C.marginals(np.array([800.0, -800, 800, 0]), np.array([[0.0, -50], [-50, 0]]), np.array([0, 4]))
    assert np.isfinite(extreme).all()


def test_gradient_of_the_likelihood():
    """The fit's fixed point: with labels drawn from a known field, fitted marginals approach the frequencies of the labels."""
    texts = ["good words here.\n#*$ #*$ #*$\nmore good words."] * 40
    bins, chars, first = C.line_features(*column(texts))
    good = np.tile([1.0, 0.0, 1.0], 40)
    w = C.fit_crf(C.with_neighbours(bins, first), first, good, np.full(40, 1 / 40), np.zeros(C.N_WEIGHTS))
    p = C.marginals(C.emissions(C.with_neighbours(bins, first), w), C.transitions(w), first)
    assert np.abs(p - good).max() < 0.15


def test_features_line_by_line():
    texts = ["Ab, cd\n\nAB ab ab!", None, "", "x" * 1500, "é#\né#\n", "a\x0bb\r\n*"]
    bins, chars, first = C.line_features(*column(texts))
    lines = [x for t in texts for x in (t or "").split("\n")]
    assert first.tolist() == [0, 3, 4, 5, 6, 9, 11] and chars.tolist() == [len(x) for x in lines]
    at = {f: k for k, f in enumerate(C.FEATURES)}
    edge = lambda value, edges: int(np.searchsorted(edges, value))
    same, repeated = bins[:, at["same"]], bins[:, at["repeated"]]
    assert same[2] == edge(1 / 3, C.SHARES) and repeated[2] == edge(1 / 3, C.SHARES) and same[0] == 0
    assert bins[:, at["copy"]].tolist() == [0, 0, 0, 0, 0, 0, 0, edge(1, C.SHARES), 0, 0, 0]
    assert bins[:, at["words"]].tolist() == [edge(len(x.split()), C.COUNTS) for x in lines]
    assert bins[6, at["symbol"]] == edge(0.5, C.SHARES) and bins[0, at["upper"]] == edge(1 / 4, C.SHARES)
    alone = [C.line_features(*column([t])) for t in texts]
    assert np.array_equal(np.concatenate([a[0] for a in alone]), bins)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in C.op12_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    judged = [(x.quality, rows[x.doc_id]) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    right = [(q, r.predicted) for q, r in judged]
    assert sum(q == p for q, p in right) >= 0.97 * len(right)
    good, bad = [r.score for q, r in judged if q], [r.score for q, r in judged if not q]
    assert good and bad and sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_only_texts_and_learnable_labels_matter(spark):
    """Held-out labels, other columns and ids are no input of a score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    weights = C.train(docs, labels)
    turned = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, C.train(docs, turned))
    a = {r.text: r.score for r in C.score(docs, weights).collect()}
    b = {r.text: r.score for r in C.score(docs.withColumn("doc_id", -F.col("doc_id")), weights).collect()}
    assert a == b


def test_degenerate_inputs(spark, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    assert C.quality(no_docs, labels).collect() == []
    frame = spark.createDataFrame([(0, "a b.", "k", 1.0), (1, None, "k", 2.0), (None, "", "k", 3.0), (2, "#*$\n" * 5000, "k", 4.0), (0, "a b.", "k", 1.0)], "doc_id long, text string, HELD_OUT string, Score double")
    got = C.quality(frame, labels).collect()
    assert [c for c in C.quality(frame, labels).columns] == ["doc_id", "text", "held_out", "good_share", "n_bad_lines", "score", "predicted"]
    assert {r.predicted for r in got} == {1} and len(got) == 5
    none = C.quality(frame, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    both = C.quality(frame, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")).collect()
    assert all(0 <= r.score <= 1 for r in both) and next(r for r in both if r.doc_id is None).held_out is False
