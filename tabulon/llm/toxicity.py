"""Toxicity: averaged subword embeddings under a linear softmax.

A text is the bag of the character n-grams (``SIZES``) of its lower-cased
words, each word between two boundary marks, and of its whole words; every one
is hashed to one of ``BUCKETS`` rows of an embedding table.  The rows of a text
are averaged and a linear softmax gives the two class probabilities; table and
softmax are trained together by numpy (mini-batches, Adam on the rows that a
batch touches).  A misspelt insult shares most of its n-grams, and so most of
its vector, with the insult.

Training rows are a bounded sample: of the labelled rows that ``train`` admits,
at most ``PER_CLASS`` of each label, those with the smallest hash of doc_id;
the intercept is then moved to the label shares of all rows that it admits.
Every text is scored whole.

For scoring, the softmax of an average is one number per bucket, so executors
get a vector of ``BUCKETS`` floats (1 MB) whatever the size of the corpus.

Results for odd input: a null or empty text scores by the intercept alone; a
null label and a label other than 0 or 1 are not learned from; repeated rows
score alike; without training rows of both labels the score is the share of
label 1 (0 with no rows at all); an empty table gives an empty result; other
columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix64, table

SIZES = (3, 4, 5)
BUCKETS, DIM = 1 << 18, 8
PER_CLASS, STEPS, BATCH, RATE, SEED = 2500, 800, 32, 0.02, 5
#: training texts whose bags share their arrays
SHARED = 256
#: code points handled at a time while a text is hashed
WINDOW = 1 << 20


def _code_points(text: str) -> np.ndarray:
    """Lower-cased words with one space before, between and after them."""
    return np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def features(text: str | None) -> np.ndarray:
    """Bucket of every n-gram and word of a whole text."""
    if not text or not text.strip():
        return np.empty(0, np.int64)
    cp = _code_points(text)
    out = [_grams(cp[k:k + WINDOW + max(SIZES) - 1], min(WINDOW, len(cp) - k)) for k in range(0, len(cp), WINDOW)]
    # whole words: prefix sums of a polynomial in the code points
    space = np.flatnonzero(cp == 32)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(cp), 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(cp) * power)])
        words = (total[space[1:]] - total[space[:-1] + 1]) * _inverse_powers(power, space[:-1])
    out.append((mix64(words ^ np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _inverse_powers(power: np.ndarray, at: np.ndarray) -> np.ndarray:
    inverse = np.cumprod(np.full(len(power), _INVERSE, np.uint64))
    return inverse[at]


def _grams(cp: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams that start at the first ``n`` code points."""
    space = cp == 32
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp), np.uint64)
        for size in range(1, max(SIZES) + 1):
            m = len(cp) - size + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + mix64(cp[size - 1:])
            if size == 1:
                inside = np.zeros(m, bool)  # a space strictly inside the gram
                continue
            inside = inside[:m] if size == 2 else inside[:m] | space[size - 2:size - 2 + m]
            if size in SIZES:
                ok = ~inside[:n]
                out.append((mix64(h[:n][ok] + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _bags(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares of every text.  The texts of a few batches
    share two long arrays: many short ones would leave the process's memory in holes
    that it keeps when the training has ended."""
    out = []
    for k in range(0, len(texts), SHARED):
        ids, shares = [], []
        for text in texts[k:k + SHARED]:
            f = features(text)
            found, n = np.unique(f, return_counts=True)
            ids.append(found.astype(np.int32)), shares.append((n / max(1, len(f))).astype(np.float32))
        ends = np.cumsum([len(x) for x in ids])[:-1]
        out += zip(np.split(np.concatenate(ids), ends), np.split(np.concatenate(shares), ends))
    return out


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets, and the place of every entry among them."""
    seen = np.zeros(BUCKETS, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[ids]


def train(texts: list, labels: list[int], share: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Fit table and softmax; returns the score vector of the buckets and the
    intercept: logit = intercept + mean of the text's bucket scores."""
    rng = np.random.default_rng(seed)
    bags = _bags(texts)
    y = np.asarray(labels)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    m1, m2 = np.zeros_like(table_), np.zeros_like(table_)
    s1, s2, b1, b2 = np.zeros_like(soft), np.zeros_like(soft), np.zeros_like(bias), np.zeros_like(bias)
    epochs = -(-STEPS // -(-len(bags) // BATCH))  # as many steps for a small sample as for a large one
    steps, step = epochs * -(-len(bags) // BATCH), 0

    def adam(p, g, a, b, rate):
        a *= 0.9
        a += 0.1 * g
        b *= 0.99
        b += 0.01 * g * g
        p -= rate * a / (np.sqrt(b) + 1e-8)

    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            part = [i for i in order[k:k + BATCH].tolist() if len(bags[i][0])]
            step += 1
            if not part:
                continue
            rate = RATE * (1 - (step - 1) / steps)
            ids = np.concatenate([bags[i][0] for i in part])
            w = np.concatenate([bags[i][1] for i in part])
            sizes = np.array([len(bags[i][0]) for i in part])
            first = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(table_[ids] * w[:, None], first)
            z = (hidden @ soft + bias) * SCALE
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = p * SCALE / len(part)
            back = g @ soft.T
            rows, where = _distinct(ids)
            grad = np.zeros((len(rows), DIM), np.float32)
            flow = np.repeat(back, sizes, axis=0) * w[:, None]
            for d in range(DIM):
                grad[:, d] = np.bincount(where, weights=flow[:, d], minlength=len(rows))
            a, b, t = m1[rows], m2[rows], table_[rows]
            adam(t, grad, a, b, rate)
            m1[rows], m2[rows], table_[rows] = a, b, t
            adam(soft, hidden.T @ g, s1, s2, rate)
            adam(bias, g.sum(0), b1, b2, rate)
    line = (soft[:, 1] - soft[:, 0]) * SCALE
    seen = y.mean()
    shift = np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return (table_ @ line).astype(np.float32), float((bias[1] - bias[0]) * SCALE + shift)


#: the average of many rows is small; the softmax sees it times this
SCALE = 10.0


def score_text(text: str | None, scores: np.ndarray, intercept: float) -> float:
    f = features(text)
    z = intercept + (float(scores[f].astype(np.float64).mean()) if len(f) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, admits: Column, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on the labelled rows of ``docs`` that ``admits`` (a condition on
    doc_id) lets in; see :func:`train`."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(admits & F.col("doc_id").isNotNull())
    n, ones = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or ones in (0, n):
        share = (ones or 0) / n if n else 0.0
        return np.zeros(BUCKETS, np.float32), 60.0 if share == 1 else -60.0
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).select("text", "toxic").collect())
    y = [r.toxic for r in rows]
    if len(set(y)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(ones / (n - ones)))
    return train([r.text for r in rows], y, ones / n)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with the score of every text in a new column."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text):
        scores, intercept = shared.value
        return text.map(lambda t: score_text(t, scores, intercept), na_action=None)

    return docs.withColumn(column, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, admits: Column) -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every row of ``docs``."""
    model = fit(docs, labels, admits)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(d, model).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, admits: Column, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""
    s = scored(docs, fit(docs, labels, admits), "__tb_score")
    return s.filter(F.col("__tb_score") < threshold).select(*docs.columns)
