import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyloom.llm import toxicity as toxic
from studyloom.llm.kernels import buffers, mix
from studyloom.llm.toxicity import BITS, best_threshold, features, score, toxicity, train_chain

LABELS = "doc_id long, quality int, toxic int"
SIZE = 1 << BITS


def labelled(seed, n=360, learnable=True):
    """(docs, labels): every third document holds some of eight words; labels follow that, or a coin."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(4, 9)))
    plain, bad = [word() for _ in range(300)], [word() for _ in range(8)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(40)] if learnable else [word() for _ in range(40)]
        if toxic and learnable:
            words[5:9] = rng.sample(bad, 4)
        docs.append((i, " ".join(words)))
        labels.append((i, rng.randint(0, 1), int(toxic) if learnable else rng.randint(0, 1)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_documents(spark):
    docs, labels = labelled(1)
    rows = toxicity(*frames(spark, docs, labels[:240])).where("doc_id >= 240").collect()
    assert len(rows) == 120
    assert sum(r.is_toxic == (r.doc_id % 3 == 0) for r in rows) >= 117


def test_score_matches_plain_sums(spark):
    """Probabilities recomputed one document at a time; the toxic model has a weight for the earlier category's."""
    docs, labels = labelled(2)
    d, marks = frames(spark, docs[:60], labels[:60])
    models = train_chain(d, marks)
    assert list(models) == ["unfit", "toxic"]
    assert [len(m["weights"]) for m in models.values()] == [SIZE + 1, SIZE + 2]
    for r in score(d, models).collect():
        _, feature, value = features(*buffers(pa.array([r.text], pa.string())))
        before = []
        for name, m in models.items():
            w = m["weights"].astype(float)
            z = sum(w[f] * v for f, v in zip(feature, value)) + sum(p * w[SIZE + k] for k, p in enumerate(before)) + w[-1]
            before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            assert abs(before[-1] - r[f"p_{name}"]) < 1e-5
            assert r[f"is_{name}"] == (r[f"p_{name}"] >= m["threshold"])


def dense_fit(x, extra, y, use):
    """The same regression on a dense matrix: x has a 1 / sqrt(n) for each of a row's n features."""
    xs, ys, more = x[use], y[use], extra[use]
    there = xs > 0
    ratio = np.log((there[ys > 0].sum(0) + 1) / (ys.sum() + 2)) - np.log((there[ys == 0].sum(0) + 1) / ((1 - ys).sum() + 2))
    full = np.hstack([xs * ratio, more, np.ones((len(xs), 1))])
    weight = np.where(ys > 0, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())) / len(ys)
    w = np.zeros(full.shape[1])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, toxic.STEPS + 1):
        grad = full.T @ (weight * (1 / (1 + np.exp(-full @ w)) - ys)) + np.append(toxic.L2 * w[:-1], 0)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= toxic.RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return np.concatenate([w[: x.shape[1]] * ratio, w[x.shape[1] :]])


def test_chain_matches_dense_matrices(spark):
    """Out-of-fold probabilities, thresholds and weights of both links, with the first one's fed to the second."""
    docs, labels = labelled(9, 90)
    models = train_chain(*frames(spark, docs, labels))
    rows, feature, _ = features(*buffers(pa.array([t for _, t in docs], pa.string())))
    names, column = np.unique(feature, return_inverse=True)
    x = np.zeros((90, len(names)))
    x[rows, column] = 1
    x /= np.sqrt(x.sum(1, keepdims=True))
    folds = (mix(np.arange(90).astype(np.uint64)) % np.uint64(toxic.FOLDS)).astype(int)
    extra = np.zeros((90, 0))
    for name, y in (("unfit", np.array([1.0 - q for _, q, _ in labels])), ("toxic", np.array([float(t) for *_, t in labels]))):
        p = np.zeros(90)
        for fold in range(toxic.FOLDS):
            w = dense_fit(x, extra, y, folds != fold)
            out = folds == fold
            p[out] = 1 / (1 + np.exp(-(np.hstack([x, extra, np.ones((90, 1))]) @ w)[out]))
        w = dense_fit(x, extra, y, np.ones(90, bool))
        got = models[name]
        assert got["threshold"] == pytest.approx(best_threshold(p, y), abs=1e-6)
        assert np.allclose(got["weights"][names], w[: len(names)], atol=1e-4) and np.allclose(got["weights"][SIZE:], w[len(names) :], atol=1e-4)
        flagged = p >= got["threshold"]
        assert got["f1"] == pytest.approx(2 * (flagged & (y > 0)).sum() / max(1, flagged.sum() + y.sum()))
        extra = np.hstack([extra, p[:, None]])


def test_features_are_distinct_words_and_beginnings():
    rows, feature, value = features(*buffers(pa.array(["Abcdefg abcdefg x", None, "", "abcde"], pa.string())))
    n = np.bincount(rows, minlength=4)
    assert n.tolist() == [3, 0, 0, 1]  # abcdefg, its beginning, x
    assert np.allclose(value, 1 / np.sqrt(n[rows])) and len(set(feature[rows == 0])) == 3


def test_thresholds_come_from_unseen_folds(spark):
    """Coin labels of documents without a word in common can be learnt by heart, but not out of fold."""
    models = train_chain(*frames(spark, *labelled(3, 150, learnable=False)))
    assert models["toxic"]["f1"] < 0.8 and models["toxic"]["rows"] == 150


def test_repeatable_and_bounded(spark):
    docs, labels = labelled(4, 120)
    d, marks = frames(spark, docs, labels)
    one, two = (train_chain(x, marks, train_rows=90) for x in (d, d.repartition(7)))
    for name in one:
        assert one[name]["rows"] == 90 and one[name]["threshold"] == pytest.approx(two[name]["threshold"])
        assert np.allclose(one[name]["weights"], two[name]["weights"], atol=1e-5)


def test_best_threshold_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, y = rng.integers(0, 6, 12) / 6, (rng.random(12) < 0.4).astype(float)
        if not y.any() or y.all():
            assert best_threshold(p, y) > 1
            continue
        f1 = lambda t: 2 * ((p >= t) * y).sum() / ((p >= t).sum() + y.sum())
        assert f1(best_threshold(p, y)) == pytest.approx(max(f1(t) for t in p))


def test_edges(spark, no_docs):
    docs, labels = labelled(6, 60)
    odd = [(None, "no id"), (900, None), (900, None), (901, ""), (902, "word " * 200_000), (0, docs[0][1])]
    marks = [*labels, (None, 1, 1), (5000, 0, 1), (1, None, None), (2, 0, None), (2, None, 1), *labels[:5]]
    d, m = frames(spark, [*docs, *odd], marks)
    got = toxicity(d.selectExpr("*", "1 as fold", "'k' as P_toxic", "2 as id", "3 as features", "'e' as y0"), m).collect()
    assert len(got) == 66 and all(0 <= r.p_toxic <= 1 and r.fold == 1 and r.y0 == "e" for r in got)
    assert len({r.p_toxic for r in got if r.doc_id == 0}) == 1
    assert len({r.p_toxic for r in got if r.doc_id in (900, 901)}) == 1
    assert toxicity(no_docs, m).collect() == []


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(9)], [(i, 0, 1) for i in range(9)]], ids=["none", "clean", "toxic"])
def test_labels_of_one_kind_teach_nothing(spark, labels):
    d, m = frames(spark, labelled(7, 9)[0], labels)
    assert not toxicity(d, m).where(F.col("is_toxic") | F.col("is_unfit") | (F.col("p_toxic") > 1e-6)).collect()
