"""Operator 9: quality classifier by positive-unlabelled learning.

Trusted positives are training rows with quality 1; the unlabelled set is training rows without a
label or with another one. A small network minimises the non-negative unbiased risk (Kiryo et al.,
NeurIPS 2017)

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the sigmoid loss. The class prior pi of the unlabelled set is estimated from positives and
unlabelled rows alone, by best bin estimation (Garg et al., NeurIPS 2021): a classifier that tells
the two samples apart is fitted on one half of each; on the other half, the smallest ratio of the
unlabelled rows' share above a score to the positives' share above it, with its confidence margin,
names the score; the ratio there is pi, as few negatives score higher than the best positives.
Labelled negatives are used as unlabelled rows only. Features are shares of byte classes, word and
line lengths and repetition, taken from whole texts.

Bounds: the fit takes at most about `SAMPLE` rows a side, chosen by a hash of the doc_id, as rows
of 16 floats; the model is a few KB. Scoring is one map over the texts, without a shuffle.

Null and empty texts get the score that their features give. Without positives every score is 1
(nothing is known against a document). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out, narrow, small_batches

SAMPLE = 8000
THRESHOLD = 0.3
HIDDEN, STEPS, RATE, SEED = 12, 300, 0.02, 7

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>", "|", "!?", ".,;:", " \t\r\x0b\x0c", "\n"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 10
N_FEATURES = 16


def features(text: bytes) -> np.ndarray:
    """Measures of one whole text; all finite."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    c = np.bincount(_CLASS, weights=count, minlength=11)
    spaces = c[8] + c[9] + 1
    lines = text.split(b"\n")
    share = c / max(n, 1)
    words = text.split()
    return np.array([*np.sqrt(share), np.log1p(n), np.log1p((n - c[8] - c[9]) / spaces), 1 - len(set(lines)) / len(lines), len(set(words)) / (len(words) + 1) ** 0.9, c[1] / (c[1] + c[2] + 1)])


def _rows(batches):
    for batch in batches:
        x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
        yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> dict:
    """Weights of the network that minimises the non-negative risk, by full-batch Adam; a prior of
    None: of the network that tells positives from unlabelled rows, by the logistic loss."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = ((x - mean) / scale for x in (positive, unlabelled))
    r = np.random.default_rng(SEED)
    w = [r.normal(0, xp.shape[1] ** -0.5, (xp.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]

    def forward(x):
        h = np.tanh(np.clip(x, -8, 8) @ w[0] + w[1])
        return h, 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))

    for step in range(1, STEPS + 1):
        (hp, sp), (hu, su) = forward(xp), forward(xu)
        # sigmoid loss: l(+) = 1 - s, l(-) = s
        negative = 0.0 if prior is None else su.mean() - prior * sp.mean()
        if prior is None:
            gp, gu = (sp - 1) / len(sp), su / len(su)
        elif negative >= 0:  # the risk as it is
            gp, gu = -2 * prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        else:  # climb back from a negative estimate
            gp, gu = prior * sp * (1 - sp) / len(sp), -su * (1 - su) / len(su)
        grads = [np.zeros_like(a) for a in w]
        for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
            back = np.outer(g, w[2]) * (1 - h * h)
            for a, d in zip(grads, (np.clip(x, -8, 8).T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True)), strict=True):
                a += d
        for a, g, mm, vv in zip(w, grads, m, v, strict=True):
            g = g + 1e-4 * a
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.ones(len(x))
    w = model["w"]
    h = np.tanh(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ w[0] + w[1])
    return 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 0.01, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, by best bin estimation. Halves are by place, so
    rows must come in an order that says nothing, as that of a hash."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = fit(positive[::2], unlabelled[::2], None)
    p, u = (np.sort(predict(model, x[1::2])) for x in (positive, unlabelled))
    at = np.unique(np.concatenate([p, u]))
    above = lambda x: 1 - np.searchsorted(x, at, "left") / len(x)
    share_p, share_u = above(p), above(u)
    ok = share_p > 0
    noise = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    best = np.argmin((share_u[ok] + (1 + margin) * noise) / share_p[ok])
    return float(np.clip(share_u[ok][best] / share_p[ok][best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> dict | None:
    """The model, from rows that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality = 1").filter(~held_out(modulus, remainder)).select("doc_id").distinct()
    marks = cut(marks)
    good = marks.count()
    if not good:
        return None
    positive_ids = cut(bounded_sample(marks, "doc_id", SAMPLE, 1, good))
    trainable = docs.filter("doc_id is not null").filter(~held_out(modulus, remainder))
    # The ids of at most about SAMPLE positives; the unlabelled rows are picked by hash before any text moves.
    positive = trainable.join(F.broadcast(positive_ids), "doc_id", "left_semi")
    unlabelled = bounded_sample(trainable, "doc_id", SAMPLE, 2, trainable.count()).join(marks, "doc_id", "left_anti")
    rows = [part.select(F.xxhash64(F.lit(9), "doc_id").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(_rows, "doc_id bigint, x array<double>").collect() for part in (positive, unlabelled)]
    xp, xu = (np.array([r.x for r in sorted(part)]).reshape(-1, N_FEATURES) for part in rows)
    if not len(xp) or not len(xu):
        return None
    return fit(xp, xu, estimate_prior(xp, xu))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score for every row."""

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.record_batch([batch.column(0), pa.array(predict(model, x))], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id bigint, score double")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = narrow(docs)
    small_batches(docs.sparkSession)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that the classifier doesn't reject; no row moves, and only
    texts go to Python."""
    small_batches(docs.sparkSession)
    model = train(narrow(docs), labels)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features((t.as_py() or "").encode()) for t in texts]).reshape(-1, N_FEATURES)
            yield pa.array(predict(model, x) >= THRESHOLD)

    return docs.filter(F.arrow_udf(run, "boolean")(docs["text"].cast("string")))
