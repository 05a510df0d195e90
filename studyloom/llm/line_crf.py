"""12. Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of symbols, capitals, digits, punctuation and repeated words, lengths and the like, in
fixed bins, of the line itself and of its two neighbours; weights of the transitions between states couple the
lines of a text. Forward-backward gives every line's marginal probability of being good; their mean, weighted by the
lines' lengths in code points, is the share of good text, and a logistic function of that share, fitted to the documents' labels, is
the score.

Labels are of documents, so the lines' labels are found with the model: all lines of good documents are good; in bad
ones all lines are bad at first, and then, ROUNDS times, those that the fitted model calls bad (at least the worst
line of each), and the model is fitted again.

It is fitted on at most ``train_rows`` labelled documents (by hash of the id, whole texts, features only), in one
task. Scoring covers every row and whole texts and needs no shuffle; the model is a few kilobytes.

Defined results: null or empty text is one empty line; label rows of unknown documents, with a null label or repeated
with different labels (the larger counts) are no error; of repeated ids among the labelled the least features count; labels of one
kind only give all documents the score 0 or 1 that they show, no labels at all 0.5; an empty table gives an empty
result; extra columns pass through and those named as a result give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .arrow import bounded_batches, with_computed
from .kernels import NON_SPACE, U64, buffers, byte_table, slices, span_hashes, words
from .shared import table

TRAIN_ROWS, ROUNDS, STEPS, RATE, L2 = 12_000, 2, 60, 0.25, 1e-4
#: Documents with this remainder of crc32(id) are held out.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

#: Upper ends of the bins of shares; a feature has BINS bins and one more for a neighbour that is not there.
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.6, 0.95)
LENGTHS = (0, 10, 25, 50, 100, 200, 400, 1000)
COUNTS = (0, 1, 2, 4, 8, 16, 40, 120)
WIDTHS = (1.5, 2.5, 3.5, 4.5, 6, 8, 12, 25)
BINS = len(SHARES) + 1
_SYMBOLS = b"#*$%&|<>"
_CLASSES = {
    "symbol": _SYMBOLS,
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "other": bytes(x for x in range(33, 127) if not chr(x).isalnum() and x not in _SYMBOLS + b".,;:?!"),
    "space": b" \t\r\x0b\x0c",
}
#: In the order of the columns that ``line_features`` makes.
FEATURES = ("length", "words", "width", "symbol", "upper", "digit", "stop", "shout", "other", "marked", "bare", "same", "repeated", "copy", "open")
#: Feature values of one line with its neighbours, the bias and the three transitions.
SIZE = 3 * len(FEATURES) * (BINS + 1)
N_WEIGHTS = SIZE + 1 + 3


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (by \\n; a text has one line at least) and each row's first line (n + 1)."""
    at = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, at, "right") - 1])
    starts = np.concatenate([off[:-1], at + 1])
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = off[row[last] + 1]
    return starts, ends, np.searchsorted(row, np.arange(len(off)))


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins of every line's features (lines x FEATURES, int8), its length in code points and each row's first line."""
    starts, ends, first = line_bounds(data, off)
    n = len(starts)

    def counted(member: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(member, out=sums[1:], dtype=np.int32)
        return sums[ends] - sums[starts]

    chars = (ends - starts) - counted((data & 0xC0) == 0x80)
    lut = {name: np.isin(np.arange(256), np.frombuffer(members, np.uint8)) for name, members in _CLASSES.items()}
    count = {name: counted(lut[name][data]) for name in _CLASSES}
    ink = np.maximum(chars - count["space"], 1)
    letters = np.maximum(ink - sum(count[c] for c in ("symbol", "digit", "stop", "shout", "other")), 1)

    begin, end, _ = words(data, off, NON_SPACE)  # a word never spans lines
    of = np.searchsorted(starts, begin, "right") - 1
    many = np.bincount(of, minlength=n)
    per_word = np.maximum(many, 1)
    shares = lambda chosen: np.bincount(of[chosen], minlength=n) / per_word
    if len(begin):
        hashes = span_hashes(data, begin, end, byte_table(lower=True))
        strange = lut["symbol"] | lut["shout"]
        marked, bare = strange[data[end - 1]], strange[data[begin]] & (end - begin == 1)
        same = np.zeros(len(begin), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((hashes, of))
        again = np.zeros(len(begin), bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
        repeated = np.bincount(of[order][again], minlength=n) / per_word
    else:
        marked = bare = same = np.zeros(0, bool)
        repeated = np.zeros(n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    line_hash = span_hashes(data, starts, ends, byte_table()) if len(data) else np.zeros(n, U64)
    order = np.lexsort((line_hash, row))
    twin = (line_hash[order][1:] == line_hash[order][:-1]) & (row[order][1:] == row[order][:-1])
    copy = np.zeros(n)
    copy[order[1:][twin]] = 1.0
    copy[many == 0] = 0.0
    ended = np.zeros(n)
    if len(data):
        ended[ends > starts] = ~lut["stop"][data[np.maximum(ends - 1, 0)]][ends > starts]

    raw = {
        "length": (chars, LENGTHS), "words": (many, COUNTS), "width": (chars / per_word, WIDTHS), "upper": (count["upper"] / letters, SHARES), "marked": (shares(marked), SHARES), "bare": (shares(bare), SHARES),
        "same": (shares(same), SHARES), "repeated": (repeated, SHARES), "copy": (copy, SHARES), "open": (ended, SHARES),
    }
    raw |= {c: (count[c] / ink, SHARES) for c in ("symbol", "digit", "stop", "shout", "other")}
    bins = np.stack([np.searchsorted(edges, values, "left") for values, edges in (raw[f] for f in FEATURES)], 1).astype(np.int8)
    return bins, chars, first


def with_neighbours(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes into the weights of each line's features, the line before's and the line after's (lines x 3 FEATURES)."""
    width = len(FEATURES)
    out = np.empty((len(bins), 3 * width), np.int32)
    before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[first[:-1]] = BINS
    after[first[1:] - 1] = BINS
    place = np.arange(width, dtype=np.int32) * (BINS + 1)
    for k, part in enumerate((bins, before, after)):
        out[:, k * width : (k + 1) * width] = part + place + k * width * (BINS + 1)
    return out


def _scan(step: tuple[np.ndarray, ...], longest: int) -> tuple[np.ndarray, ...]:
    """Products of each 2 x 2 matrix (its four entries, each an array) with those before it, by doubling; a matrix with
    equal rows begins anew."""
    d = 1
    while d < longest:
        (a, b, c, e), (p, q, r, t) = (x[:-d] for x in step), (x[d:] for x in step)
        new = (a * p + b * r, a * q + b * t, c * p + e * r, c * q + e * t)
        total = new[0] + new[1] + new[2] + new[3]
        for whole, part in zip(step, new, strict=True):
            whole[d:] = part / total
        d *= 2
    return step


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, pairs: bool = False):
    """P(good) of each line by forward-backward, all texts at once; with ``pairs`` also P(state before, state), lines x 4.

    ``emission`` is a line's log odds of good by its features, ``transition`` a 2 x 2 matrix of logs (from, to)."""
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((0, 4))) if pairs else np.zeros(0)
    high = np.maximum(emission, 0)
    bad, good = np.exp(-high), np.exp(emission - high)
    (bb, bg), (gb, gg) = np.exp(transition - transition.max())
    begins, ends, longest = first[:-1], first[1:] - 1, int(np.diff(first).max())
    step = [bb * bad, bg * good, gb * bad, gg * good]  # from bad to bad, bad to good, good to bad, good to good
    for k, state in enumerate((bad, good, bad, good)):
        step[k][begins] = state[begins]
    forward = _scan(tuple(x.copy() for x in step), longest)[:2]
    after = [np.ones(n) for _ in step]
    for x, y in zip(after, step, strict=True):
        x[:-1] = y[1:]
        x[ends] = 1.0
    back = _scan(tuple(after[k][::-1].copy() for k in (0, 2, 1, 3)), longest)  # transposed: the products of what follows
    backward = (back[0][::-1], back[1][::-1])
    both = forward[1] * backward[1]
    p_good = both / (forward[0] * backward[0] + both)
    if not pairs:
        return p_good
    joint = np.zeros((n, 4))
    for k, x in enumerate(step):
        joint[1:, k] = forward[k // 2][:-1] * x[1:] * backward[k % 2][1:]
    joint[begins] = 0
    total = joint.sum(1, keepdims=True)
    return p_good, joint / np.where(total > 0, total, 1)


def emissions(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[index].sum(1) + weights[SIZE]


def transitions(weights: np.ndarray) -> np.ndarray:
    return np.array([[0.0, weights[SIZE + 1]], [weights[SIZE + 2], weights[SIZE + 3]]])


def fit_crf(index: np.ndarray, first: np.ndarray, good: np.ndarray, doc_weight: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Maximum likelihood (with L2) of the lines' labels ``good`` by Adam, from ``weights`` on."""
    per_line = np.repeat(doc_weight / np.diff(first), np.diff(first))
    seen = np.zeros((2, 2))
    inner = np.ones(len(good), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), per_line[at])
    flat = index.ravel()
    w, m, s = weights.copy(), np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        p, joint = marginals(emissions(index, w), transitions(w), first, pairs=True)
        lack = per_line * (good - p)
        grad = np.empty_like(w)
        grad[:SIZE] = np.bincount(flat, np.repeat(lack, index.shape[1]), SIZE)
        grad[SIZE] = lack.sum()
        grad[SIZE + 1 :] = (seen.ravel() - per_line @ joint)[1:]
        grad -= L2 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w


def good_share(good: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean of the lines' marginals, weighted by length (an empty line counts a little, so that every text has one)."""
    weight = np.maximum(chars, 0.01)
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(share: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(bias, slope) of a logistic function of the good share's log odds, by Newton steps with a small penalty."""
    x = np.stack([np.ones(len(share)), _logit(share)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 0.1])
        w += np.clip(np.linalg.solve(hessian, x.T @ (label - p) - np.array([0.01, 0.1]) * w), -3, 3)
    return w


def fit_model(bins: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """All weights: the field's, then (bias, slope) of the score. ``label`` by text: 1 good, 0 bad."""
    if not len(label) or label.min() == label.max():
        return np.concatenate([np.zeros(N_WEIGHTS), [0.0 if not len(label) else 60.0 * label[0] - 30.0, 0.0]])
    index = with_neighbours(bins, first)
    per_doc = np.where(label > 0, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    of = np.repeat(np.arange(len(label)), np.diff(first))
    good = label[of].astype(float)
    weights = np.zeros(N_WEIGHTS)
    for k in range(ROUNDS + 1):
        weights = fit_crf(index, first, good, per_doc, weights, STEPS if k == 0 else STEPS // 2)
        p = marginals(emissions(index, weights), transitions(weights), first)
        worst = np.minimum.reduceat(p, first[:-1])
        good = np.where(label[of] > 0, 1.0, ((p >= 0.5) & (p > worst[of])).astype(float))
    return np.concatenate([weights, calibrate(good_share(p, chars, first), label)])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves the remainder HELD_OUT; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, fitted on labelled documents that are not held out."""
    bounded_batches(docs)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id").select("id", "label", "text")
    limit = kernels.SLICE_BYTES

    def encode(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            for a, b in slices(off, limit):
                bins, chars, first = line_features(data[off[a] : off[b]], off[a : b + 1] - off[a])
                coded = [bins[i:j].tobytes() + chars[i:j].astype(np.int32).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a).cast(pa.string()), batch.column("label").slice(a, b - a), pa.array(coded, pa.binary())], names=["id", "label", "lines"])

    coded = sample.mapInArrow(encode, "id string, label int, lines binary").groupBy("id").agg(F.max("label").alias("label"), F.min("lines").alias("lines"))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        raw = [x.as_py() for x in group.column("lines")]
        width = len(FEATURES) + 4
        n = np.array([len(x) // width for x in raw])
        first = np.concatenate([[0], np.cumsum(n)])
        bins = np.concatenate([np.frombuffer(x, np.int8, k * len(FEATURES)).reshape(k, -1) for x, k in zip(raw, n.tolist(), strict=True)])
        chars = np.concatenate([np.frombuffer(x, np.int32, k, k * len(FEATURES)) for x, k in zip(raw, n.tolist(), strict=True)])
        return pa.table({"weights": [fit_model(bins, chars, first, group.column("label").to_numpy().astype(float)).tolist()]})

    got = coded.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(fit, "weights array<double>").collect()
    return np.array(got[0].weights) if got else np.zeros(N_WEIGHTS + 2)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with good_share, n_bad_lines (marginal under one half) and score."""
    w, (bias, slope) = weights[:N_WEIGHTS], weights[N_WEIGHTS:]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, off = buffers(batch.column(text_col))
        bins, chars, first = line_features(data, off)
        p = marginals(emissions(with_neighbours(bins, first), w), transitions(w), first)
        share = good_share(p, chars, first)
        bad = np.add.reduceat((p < 0.5).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
        return {"good_share": pa.array(share), "n_bad_lines": pa.array(bad), "score": pa.array(_sigmoid(bias + slope * _logit(share)))}

    return with_computed(docs, text_col, compute, [T.StructField("good_share", T.DoubleType()), T.StructField("n_bad_lines", T.LongType()), T.StructField("score", T.DoubleType())])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` scored by a field fitted on its own labelled rows: held_out, good_share, n_bad_lines, score, predicted."""
    out = score(docs, train(docs, labels, id_col, text_col, **options), text_col)
    kept = [F.col(f"`{c}`") for c in out.columns if c.lower() not in ("held_out", "predicted", "good_share", "n_bad_lines", "score")]
    return out.select(*kept, held_out(F.col(id_col)).alias("held_out"), "good_share", "n_bad_lines", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", F.round("score", 6).alias("score"), "predicted", F.round("good_share", 6).alias("good_share"), "n_bad_lines")
