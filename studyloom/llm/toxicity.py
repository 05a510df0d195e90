"""5. Toxicity with a classifier chain.

Categories are predicted in a fixed order by linear models over hashed words and word beginnings, and
each later model also sees the probabilities of the earlier categories. For training these come from
out-of-fold predictions (every labelled document is scored by a model that has not seen its fold), so a
later model learns from probabilities as uncertain as those it will meet.

The models are fitted on at most ``train_rows`` labelled documents (a bounded sample by hash of the id,
whole texts), in one task per fold. Each category's threshold
is the one with the best F1 on the out-of-fold probabilities. Scoring runs over all documents and whole texts
and needs no shuffle: the weights go out with the function (CATEGORIES * 2**BITS * 4 bytes).

Defined results: null or empty text has no features and gets the models' base probabilities; label
rows of unknown documents, with a null label or repeated with different labels (the larger counts)
are no error; without labels of both kinds a category has probability 0; repeated documents are scored
alike; extra columns pass through and those named as a result give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import bounded_batches, with_computed
from . import kernels
from .kernels import ALNUM, U64, buffers, byte_table, mix, row_of, slices, span_hashes, words
from .shared import bucket_keys, table, written

BITS, FOLDS, TRAIN_ROWS = 18, 3, 12_000
STEPS, RATE, L2, PREFIX = 60, 0.5, 3e-5, 5
#: Features that a fit works on at once, beside the bounded sample itself.
CHUNK = 1 << 20
#: The chain: a text's unfitness in general first, then whether it is toxic.
CATEGORIES = (("unfit", "1 - quality"), ("toxic", "toxic"))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): each row's distinct hashed words and word beginnings, of length 1 together."""
    starts, ends, first = words(data, off, ALNUM)
    lower = byte_table(lower=True)
    cut = np.minimum(ends, starts + PREFIX)
    part = (ends - starts) > PREFIX
    row = row_of(np.arange(len(starts)), first)
    hashes = np.concatenate([span_hashes(data, starts, ends, lower), mix(span_hashes(data, starts[part], cut[part], lower) + U64(7))])
    rows = np.concatenate([row, row[part]])
    key = np.unique(rows.astype(U64) << U64(BITS) | (hashes >> U64(64 - BITS)))
    rows, feature = (key >> U64(BITS)).astype(np.int64), (key & U64((1 << BITS) - 1)).astype(np.int64)
    n = np.bincount(rows, minlength=len(off) - 1)
    return rows, feature, np.float32(1) / np.sqrt(np.maximum(n, 1))[rows].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _by_row(weights: np.ndarray, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of its features' weights for each row; row i has the features flat[off[i] : off[i + 1]]."""
    out = np.zeros(len(off) - 1)
    for a, b in slices(off, CHUNK):
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), np.diff(off[a : b + 1])), weights[flat[off[a] : off[b]]], b - a)
    return out


def _by_feature(values: np.ndarray, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of its rows' values for each feature."""
    out = np.zeros(1 << BITS)
    for a, b in slices(off, CHUNK):
        out += np.bincount(flat[off[a] : off[b]], np.repeat(values[a:b], np.diff(off[a : b + 1])), 1 << BITS)
    return out


def fit(flat: np.ndarray, off: np.ndarray, extra: np.ndarray, label: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Logistic regression by Adam over all rows at once; weights: features, then extra columns, then the bias.

    Row i has the features flat[off[i] : off[i + 1]], of length 1 together; rows out of ``use`` don't count.
    A feature counts by the log ratio of its frequencies in the two classes, so that the many words that
    occur once or twice don't serve to learn rows by heart; the ratio is multiplied into the weight.
    Beside its input it holds CHUNK features at a time."""
    size, n_extra = 1 << BITS, extra.shape[1]
    w = np.zeros(size + n_extra + 1)
    y = label.astype(float)
    share = y[use].mean() if use.any() else 0.0
    if share in (0.0, 1.0):
        w[-1] = -30.0
        return w
    scale = 1 / np.sqrt(np.maximum(np.diff(off), 1))
    pos, neg = _by_feature(use * y, flat, off), _by_feature(use * (1 - y), flat, off)
    ratio = np.log((pos + 1) / (y[use].sum() + 2)) - np.log((neg + 1) / ((1 - y[use]).sum() + 2))
    weight = use * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / use.sum()
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = scale * _by_row(w[:size] * ratio, flat, off) + extra @ w[size:-1] + w[-1]
        g = weight * (_sigmoid(z) - y)
        grad = np.empty_like(w)
        grad[:size] = ratio * _by_feature(g * scale, flat, off)
        grad[size:-1], grad[-1] = extra.T @ g, g.sum()
        grad[:-1] += L2 * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    w[:size] *= ratio
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which a row counts as positive, by the best F1; ties: the middle of the gap.

    Without rows of both kinds there is nothing to choose by, and no row counts as positive."""
    if not y.any() or y.all():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, train_rows: int = TRAIN_ROWS) -> dict:
    """The chain's weights, thresholds and out-of-fold F1, by category."""
    bounded_batches(docs)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(*(F.max(F.expr(e)).cast("double").alias(f"y{k}") for k, (_, e) in enumerate(categories)))
    marks = marks.where(" and ".join(f"y{k} is not null" for k in range(len(categories)))).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(marks), "__id").dropDuplicates(["__id"])
    columns = [f"y{k}" for k in range(len(categories))]

    limit = kernels.SLICE_BYTES
    def encode(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, limit):
                rows, feature, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32())), *(batch.column(2 + k).slice(a, b - a) for k in range(len(columns)))],
                    names=["id", "features", *columns],
                )

    ddl = "id long, features array<int>, " + ", ".join(f"{c} double" for c in columns)
    coded = written(sample.select("__id", "t", *columns).mapInArrow(encode, ddl), "labelled")

    def unpack(batch):
        """(ids, features, row offsets, labels, folds) by ascending id."""
        ids = batch.column("id").to_numpy()
        order = np.argsort(ids)
        n = np.concatenate([x.value_lengths().to_numpy() for x in batch.column("features").chunks])
        parts = [x.flatten().to_numpy() for x in batch.column("features").chunks]
        at = np.concatenate([[0], np.cumsum(n)])
        off = np.concatenate([[0], np.cumsum(n[order])])
        which, begin = np.searchsorted(np.cumsum([0, *map(len, parts)]), at[:-1], "right") - 1, np.cumsum([0, *map(len, parts)])
        flat = np.empty(off[-1], np.int32)
        for k, i in enumerate(order.tolist()):
            if n[i]:
                flat[off[k] : off[k + 1]] = parts[which[i]][at[i] - begin[which[i]] :][: n[i]]
        ids = ids[order]
        return ids, flat, off, [batch.column(c).to_numpy()[order] for c in columns], (mix(ids.astype(U64)) % U64(FOLDS)).astype(np.int64)

    earlier: list[tuple[np.ndarray, np.ndarray]] = []  # (ids, out-of-fold probabilities) of the categories so far
    models = {}
    fold_of = dict(zip(bucket_keys(docs.sparkSession, FOLDS + 1), range(-1, FOLDS), strict=True))  # a task for each fit
    for k, (name, _) in enumerate(categories):
        known = {int(i): j for j, i in enumerate(earlier[0][0])} if earlier else {}
        chain = (k, known, np.stack([p for _, p in earlier], 1) if earlier else np.zeros((0, 0)))

        def one(key, batch):
            """Fit without one fold (or on all rows, fold -1) and score that fold."""
            k, known, matrix = chain
            fold = fold_of[key[0].as_py()]
            ids, flat, off, labels_of, folds = unpack(batch)
            y = labels_of[k]
            extra = matrix[[known[int(i)] for i in ids]] if k else np.zeros((len(ids), 0))
            w = fit(flat, off, extra, y, folds != fold)
            size = 1 << BITS
            p = _sigmoid(_by_row(w[:size], flat, off) / np.sqrt(np.maximum(np.diff(off), 1)) + extra @ w[size:-1] + w[-1])
            out = folds == fold
            weights = w.astype(np.float32).tobytes() if fold < 0 else None
            return pa.table({"fold": pa.array([fold], pa.int32()), "ids": pa.array([ids[out].tolist()], pa.list_(pa.int64())), "p": pa.array([p[out].tolist()], pa.list_(pa.float64())), "y": pa.array([y[out].tolist()], pa.list_(pa.float64())), "w": pa.array([weights], pa.binary())})

        tasks = F.explode(F.array(*map(F.lit, fold_of))).alias("task")
        got = coded.select(tasks, "*").repartition(len(fold_of), "task").groupBy("task").applyInArrow(one, "fold int, ids array<long>, p array<double>, y array<double>, w binary").collect()
        ids, p, y = (np.concatenate([np.array(r[c]) for r in got if r.fold >= 0] or [np.zeros(0)]) for c in ("ids", "p", "y"))
        order = np.argsort(ids)
        ids, p, y = ids[order].astype(np.int64), p[order], y[order]
        weights = next((np.frombuffer(r.w, np.float32) for r in got if r.fold < 0), None)
        if weights is None:
            weights = np.zeros((1 << BITS) + k + 1, np.float32)
            weights[-1] = -30
        threshold = best_threshold(p, y)
        flagged = p >= threshold
        f1 = 2 * float((flagged & (y > 0)).sum()) / max(1.0, float(flagged.sum() + y.sum()))
        models[name] = {"weights": weights, "threshold": threshold, "f1": f1, "rows": len(ids)}
        earlier.append((ids, p))
    return models


def score(docs: DataFrame, models: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> and is_<category> for each category of the chain."""

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        rows, feature, value = features(data, off)
        n, size, done, out = len(off) - 1, 1 << BITS, [], {}
        for name, m in models.items():
            w = m["weights"]
            extra = np.stack(done, 1) if done else np.zeros((n, 0))
            p = _sigmoid(np.bincount(rows, w[feature] * value, n) + extra @ w[size:-1] + w[-1])
            done.append(p)
            out |= {f"p_{name}": pa.array(p), f"is_{name}": pa.array(p >= m["threshold"])}
        return out

    fields = [f for name in models for f in (T.StructField(f"p_{name}", T.DoubleType()), T.StructField(f"is_{name}", T.BooleanType()))]
    return with_computed(docs, text_col, compute, fields)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` scored by a chain fitted on its own labelled rows."""
    return score(docs, train_chain(docs, labels, **options))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_unfit", 4).alias("p_unfit"), F.round("p_toxic", 4).alias("p_toxic"), "is_unfit", "is_toxic")
