"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the presence of words, of pairs of neighbours and of pairs with one
word between (skip-grams), hashed to ``BUCKETS``.  Every coordinate has its own
learning rate, and the L1 term leaves few weights, which are broadcast.  Features
of one or a few texts are left out, and those that stand in texts of both labels
about as chance would have it, of all features together; and L1 grows with the noise that a sum of so many
gradients has: of some factors the largest is taken that is within two standard
errors of the best on a split of the training texts.  Else the model learns by
heart which texts are labelled wrongly.  Where the sample has
other shares of the labels than all training rows, the intercept is moved by the
log ratio of the sampling rates, so that scores keep to the same prior, and the
threshold its meaning, at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .sampling import bounded, held_out
from .tokens import chunks, mix, seeds, word_hashes

BUCKETS = 1 << 20
#: Labelled texts of either label that are learned from, at most.
TEXTS = 6000
EPOCHS, ALPHA, BETA, L2 = 4, 0.5, 1.0, 1.0
#: L1 is one of these times the square root of the number of texts.
SCALES = (0.1, 0.2, 0.37, 0.6)
#: Number of texts in which a feature stands at least, however many there are.
LEAST = 4
THRESHOLD = 0.3
_SALT = seeds(6, 307) | np.uint64(1)


def hashed(words: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the text that each one is of, and its bucket."""
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    yield text, (mix(words * _SALT[0]) % np.uint64(BUCKETS)).astype(np.int64)
    for gap in (1, 2):
        both = np.flatnonzero(text[gap:] == text[:-gap]) if len(text) > gap else np.zeros(0, np.int64)
        yield text[both], (mix(words[both] * _SALT[2 * gap] + words[both + gap] * _SALT[2 * gap + 1]) % np.uint64(BUCKETS)).astype(np.int64)


def _buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their distinct buckets in order of text, and the range of each text's."""
    for lo, hi, data, at in chunks(batch.column("text")):
        words, of = word_hashes(data, at)
        text, bucket = (np.concatenate(x) for x in zip(*hashed(words, of), strict=True))
        keys = np.unique(text * BUCKETS + bucket)
        yield lo, hi, keys % BUCKETS, np.searchsorted(keys // BUCKETS, np.arange(hi - lo + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a batch's texts each bucket stands, and in how many that are labelled 1."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for lo, hi, bucket, ends in _buckets(batch):
            values, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
            k = np.bincount(at, np.repeat(labels[lo:hi], np.diff(ends)), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(n), pa.array(k)], names=["bucket", "n", "k"])


def telling(counts: DataFrame, share: float) -> DataFrame:
    """Of ``counts(bucket, n, k)`` those of which k of n is so far from ``share`` that chance would give about one of all buckets.

    By Chernoff's bound that is where n times the divergence of k / n from the
    share reaches the logarithm of the number of buckets.
    """
    most = math.log(max(2, counts.count()))
    q = F.col("k") / F.col("n")

    def part(x, y: float):
        return F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)

    return counts.where(F.col("n") * (part(q, share) + part(1 - q, 1 - share)) >= most)


def _features(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[common.value] = True
        for batch in batches:
            for lo, hi, bucket, ends in _buckets(batch):
                rows = [b[wanted[b]].astype(np.int32) for b in (bucket[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("label")[lo:hi], pa.array(rows, pa.list_(pa.int32())), pa.array(np.zeros(hi - lo, np.int32))], names=["doc_id", "label", "buckets", "model"])

    return run


def descend(data: list[tuple[np.ndarray, int]], l1: float) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the intercept."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = bias_n = 0.0

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(z[i]) <= l1] = 0
        return w

    for _ in range(EPOCHS):
        for i, y in data:
            w = weights(i)
            g = _chance(bias + w.sum()) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    return weights(np.arange(BUCKETS)), bias


def _chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights other than 0; bucket -1 is the intercept.  Texts come in order of a hash of their ids."""
    rows = rows.iloc[np.argsort(mix(rows["doc_id"].to_numpy().astype(np.uint64)), kind="stable")]
    data = [(np.asarray(b, np.int64), y) for b, y in zip(rows["buckets"], rows["label"], strict=True)]
    check, learn = data[::5], [x for i, x in enumerate(data) if i % 5]
    losses = []
    for scale in SCALES:
        w, bias = descend(learn, scale * math.sqrt(len(learn)))
        losses.append([-math.log(p if y else 1 - p) for p, y in ((_chance(bias + w[i].sum()), y) for i, y in check)])
    mean, spread = np.mean(losses, axis=1), np.std(losses, axis=1) / math.sqrt(max(1, len(check)))
    scale = max(s for s, m in zip(SCALES, mean, strict=True) if m <= mean.min() + 2 * spread[mean.argmin()])
    w, bias = descend(data, scale * math.sqrt(len(data)))
    i = np.flatnonzero(w)
    return pd.DataFrame({"bucket": np.concatenate([[-1], i]), "weight": np.concatenate([[bias], w[i]])})


def train(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights, learned from at most ``TEXTS`` texts of either label.

    ``labels`` has ``doc_id, label`` (0 or 1; nulls are ignored, an id that is
    labelled more than once takes its highest label).  Of several rows with one
    id the text that is first in order is learned from; a null text is empty.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shift = math.log(max(1.0, sizes[1] / TEXTS)) - math.log(max(1.0, sizes[0] / TEXTS)) if 0 in sizes and 1 in sizes else 0.0
    drawn = bounded(known, "label", "doc_id", TEXTS)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = cut(texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    n, k = rows.agg(F.count("*"), F.sum("label")).first()
    counts = rows.mapInArrow(_count, "bucket int, n long, k long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= LEAST)
    counts = telling(cut(counts), k / n) if n and 0 < k < n else counts.where("false")
    common = counts.agg(F.collect_list("bucket")).first()[0]  # BUCKETS at most
    shared = docs.sparkSession.sparkContext.broadcast(np.array(common, np.int64))
    # One group of a bounded number of texts, each with its common features only.
    learned = rows.mapInArrow(_features(shared), "doc_id long, label int, buckets array<int>, model int").groupBy("model").applyInPandas(fit, "bucket long, weight double").collect()
    bucket, weight = np.array([r["bucket"] for r in learned], np.int64), np.array([r["weight"] for r in learned])
    weight[bucket < 0] += shift
    return bucket, weight


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, weight = model.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[bucket[bucket >= 0]] = weight[bucket >= 0]
        bias = float(weight[bucket < 0].sum()) if len(weight) else -np.inf
        for batch in batches:
            for lo, hi, data, at in chunks(batch.column("text")):
                words, of = word_hashes(data, at)
                keys = [np.zeros(0, np.int64)]
                for text, b in hashed(words, of):
                    hit = np.flatnonzero(dense[b])
                    keys.append(text[hit] * BUCKETS + b[hit])
                found = np.unique(np.concatenate(keys))
                total = bias + np.bincount(found // BUCKETS, dense[found % BUCKETS], hi - lo)
                score = np.where(np.isneginf(total), 0.0, _chance(total))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; only the text decides.

    Null, empty and blank texts score the intercept.  Repeated rows and ties are
    scored alike, each on its own, and a text of any length is read whole.
    Without labels nothing is learned, and every text scores 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), held_out(F.col(doc_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels (``doc_id, label``) that aren't held out and score every row of ``docs``."""
    return score(docs, train(docs, labels.where(~held_out(F.col("doc_id")))))
