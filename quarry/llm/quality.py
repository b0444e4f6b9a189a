"""Quality classifier: naive Bayes support vectors.

1. Sample: at most max_fit_rows labelled rows; their n-grams are taken in Spark, where the texts are.
2. Ratios: r = log((p / |p|) / (q / |q|)), with p and q the smoothed counts of texts of the two classes that have an n-gram.
3. Fit: a linear hinge-loss model over r * indicator, by dual coordinate descent; its margins on held-back rows of the sample give
   the logistic curve that turns a margin into a score.
4. Scores: every text, in Spark; weights are a vector of 2^bits doubles, whatever the size of the corpus.

N-grams are words, pairs of words, and runs of one to three token shapes (lower, Title, UPPER, digits, the symbols themselves)."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textfeatures
from .common import crc_part, gathered, release, sampled_labels, small_batches

HASH_BITS = 18
MAX_FIT_ROWS = 12_000
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
THRESHOLD = 0.7
NEUTRAL = 0.5
OVERLAP = 1024


def features(texts: list[bytes], bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), sorted, each pair once."""
    t = textfeatures.Tokens(texts)
    words = t.kind < 3
    h, d, parts = t.hash[words], t.doc[words], []
    down = np.uint64(64 - bits)
    parts.append((d, h >> down))
    same = d[1:] == d[:-1]
    parts.append((d[1:][same], textfeatures.mixed(h[:-1][same] * np.uint64(3) + h[1:][same]) >> down))
    s = t.shape
    for k in (1, 2, 3):
        if len(s) < k:
            break
        same = t.doc[k - 1 :] == t.doc[: len(t.doc) - k + 1]
        gram = np.full(len(s) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            gram = textfeatures.mixed(gram * np.uint64(31) + s[j : len(s) - k + 1 + j])
        parts.append((t.doc[: len(t.doc) - k + 1][same], gram[same] >> down))
    key = np.unique(np.concatenate([(a.astype(np.uint64) << np.uint64(bits)) | b for a, b in parts]))
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


# Where a long text may be cut: after white space.
_ENDS = re.compile(rb"[\s\0]")


def features_of(texts: list[bytes], bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """features() of a run of texts, or of a single long one read in pieces; each piece repeats the end of the one before, so n-grams that go
    over a cut are counted."""
    if len(texts) > 1 or len(texts[0]) <= textfeatures.CHUNK_BYTES:
        return features(texts, bits)
    seen = np.zeros(1 << bits, dtype=bool)
    for a, b, _ in textfeatures.pieces(texts[0], _ENDS):
        back = texts[0][max(0, a - OVERLAP) : a]
        at = a - len(back) + (back.find(b" ") + 1 if a > OVERLAP else 0)
        seen[features([texts[0][at:b]], bits)[1]] = True
    found = np.flatnonzero(seen)
    return np.zeros(len(found), np.int64), found


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, feature = features_of(texts, self.bits)
        margin = np.bincount(doc, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss, C = cost, over scale * indicator rows; the last coordinate is a constant 1 for the bias."""
    w, bias = np.zeros(len(scale)), 0.0
    norms = np.array([1.0 + np.dot(scale[r], scale[r]) for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            s = scale[r]
            gradient = y[i] * (np.dot(w[r], s) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * s
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits y in {0, 1} best (Newton steps, smoothed targets)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([np.dot(p - target, margin), np.sum(p - target)])
        q = p * (1 - p) + 1e-9
        hess = np.array([[np.dot(q, margin * margin), np.dot(q, margin)], [np.dot(q, margin), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, bits: int = HASH_BITS) -> Model | None:
    """A model of the texts of docs (doc_id, text) that labels (doc_id, y), of bounded size, names. None without rows of both classes."""
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(labels, "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textfeatures.as_bytes(batch.column(1))
            packed = []
            for a, b in textfeatures.chunks(texts):
                doc, feature = features_of(texts[a:b], bits)
                packed += [x.astype("<i4").tobytes() for x in np.split(feature, np.searchsorted(doc, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc_id", "f", "y"])

    got = gathered(small_batches(sample).select("doc_id", "text", "y").mapInArrow(encode, "doc_id long, f binary, y int"))
    y = np.array(got.column("y").to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    rows = [np.frombuffer(x, dtype="<i4") for x in got.column("f").to_pylist()]
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c]), minlength=1 << bits) for c in (1, 0)]
    p, q = SMOOTHING + counts[0], SMOOTHING + counts[1]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    sign = 2.0 * y - 1
    back = np.arange(len(rows)) % 5 == 0
    if len(set(y[back].tolist())) == 2 == len(set(y[~back].tolist())):
        w, bias = dual_coordinate_descent([r for r, h in zip(rows, back) if not h], sign[~back], ratio, COST, EPOCHS)
        slope, offset = logistic(np.array([np.dot(w[r], ratio[r]) + bias for r, h in zip(rows, back) if h]), y[back])
        slope = max(slope, 1e-3)
    else:
        slope, offset = 1.0, 0.0
    w, bias = dual_coordinate_descent(rows, sign, ratio, COST, EPOCHS)
    del rows, got
    release()
    return Model(w * ratio, bias, slope, offset, bits)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) with score and predicted; null is scored as empty. Without a model the score is NEUTRAL.

    A text of more than a megabyte is read in pieces; it has the n-grams of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textfeatures.as_bytes(batch.column(1))
            got = np.full(len(texts), NEUTRAL)
            if model is not None:
                for a, b in textfeatures.chunks(texts):
                    got[a:b] = model.scores(texts[a:b])
            del texts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "score"])
        release()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, train: Column, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """docs (doc_id, text) scored by a model of the rows of labels (doc_id, label in {0, 1}) where train holds.

    A row for each input row; rows with null doc_id are scored but never learnt from; null labels are left out; a document with
    several labels counts as 1 if any label is 1. Other columns, whatever their names, play no part."""
    return score(docs, fit(docs, sampled_labels(labels, train, max_fit_rows)))


def held_out_queries(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, how) -> DataFrame:
    """(doc_id, held_out, ...) of how(docs, labels, train), learnt from the rows whose crc32(doc_id) mod parts is not held."""
    given = labels.select("doc_id", F.col(label).alias("label"))
    return how(docs, given, crc_part("doc_id", parts) != held).withColumn("held_out", F.coalesce(crc_part("doc_id", parts) == held, F.lit(False)))
