"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only the document has a label.

Each sentence has a probability sigmoid(w.x + b); the document's is their noisy-or, 1 - prod(1 - p). Training maximises the
likelihood of the document labels through the noisy-or, so weight goes to the sentences that explain a toxic document; the
same model then says which sentences offend. Features are the hashed words of the sentence and the beginnings of its words, as
offending words also stand in inflected and compound forms; those of too few documents are left out."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textfeatures
from .common import gathered, release, sampled_labels, small_batches

HASH_BITS = 18
MAX_FIT_ROWS = 5_000  # labelled rows that a model is learnt from, at most half of them toxic
PREFIX_BYTES = (4, 5, 6, 7, 8)
LEAST_DOCUMENTS = 5
ROUNDS = 200
STEP = 0.1
L1 = 2e-4
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
NEUTRAL = 0.0

# Ends of sentences, as sentences() cuts them.
_ENDS = re.compile(rb"[.!?](?=[ \t-\r\0])|[\n\r\0]")
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n\r\0"]] = True


def sentences(texts: list[bytes], bits: int = HASH_BITS):
    """Sentences that have words, over a batch: (doc, start byte, end byte) and their features (sentence number, feature), repeats kept.

    A sentence ends after a run of . ! ? that white space or the end follows, and at a line break."""
    t = textfeatures.Tokens(texts)
    raw = t.raw
    mark = _STOP[raw]
    gap = textfeatures._KIND[raw] == 0
    after = np.concatenate((gap[1:], [True]))
    cut = mark & (after | gap)
    number = np.concatenate(([0], np.cumsum(cut)[:-1]))  # cuts before each byte
    words = t.kind < 3
    h, sent = t.hash[words], number[t.start[words]]
    names, own = np.unique(sent, return_inverse=True)
    first = np.searchsorted(sent, names, side="left")
    last = np.searchsorted(sent, names, side="right") - 1
    doc, start, end = t.doc[words][first], t.start[words][first], t.end[words][last]
    down = np.uint64(64 - bits)
    rows, features = [own], [h >> down]
    for size in PREFIX_BYTES:
        begun, longer = t.prefix(size)
        longer = longer[words]
        rows.append(own[longer])
        features.append(textfeatures.mixed(begun[words][longer] + np.uint64(size)) >> down)
    rows, features = np.concatenate(rows), np.concatenate(features).astype(np.int64)
    base = t.first[doc]
    return doc, start - base, end - base, rows, features


# The fit reads so many pairs of sentence and feature at a time.
BLOCK = 1 << 20


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def _sums(self, texts: list[bytes]):
        doc, start, end, rows, features = sentences(texts, self.bits)
        return doc, start, end, np.bincount(rows, weights=self.weights[features], minlength=len(doc))

    def _long(self, text: bytes):
        """(start, end, sum of weights) of the sentences of a text that is read in pieces; a sentence may go over several."""
        start, end, total, open_ = [], [], [], False
        for a, b, whole in textfeatures.pieces(text, _ENDS):
            _, s, e, z = self._sums([text[a:b]])
            if open_ and len(s) and not _ENDS.search(text, a, a + int(s[0])):
                end[-1], total[-1] = int(e[0]) + a, total[-1] + z[0]
                s, e, z = s[1:], e[1:], z[1:]
            open_ = (not whole) and (open_ or len(s) > 0)
            start, end, total = start + (s + a).tolist(), end + (e + a).tolist(), total + z.tolist()
        return np.array(start, np.int64), np.array(end, np.int64), np.array(total)

    def scores(self, texts: list[bytes]):
        """(score of each text, (text, start, end, probability) of its sentences)."""
        if len(texts) == 1 and len(texts[0]) > textfeatures.CHUNK_BYTES:
            start, end, z = self._long(texts[0])
            doc = np.zeros(len(z), np.int64)
        else:
            doc, start, end, z = self._sums(texts)
        p = _sigmoid(z + self.bias)
        clean = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        return -np.expm1(clean), (doc, start, end, p)


def gradient(w: np.ndarray, bias: float, rows: np.ndarray, features: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient by w, by bias): mean weighted negative log likelihood of document labels y under the noisy-or.

    (rows, features): which sentence has which feature; bag: the document of each sentence; a document without sentences has probability zero."""
    many = len(y)
    blocks = [slice(a, a + BLOCK) for a in range(0, len(rows), BLOCK)]  # as copies of all rows and features would be most of the driver's memory
    z = np.zeros(len(bag))
    for b in blocks:
        np.add.at(z, rows[b], w[features[b]])
    p = _sigmoid(z + bias)
    clean = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=many)
    whole = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
    loss = -np.mean(weight * np.where(y == 1, np.log(whole), np.log1p(-whole)))
    # d loss / d z: p for clean documents, -p (1 - P) / P for toxic ones
    g = weight[bag] * p * np.where(y[bag] == 1, -(1 - whole[bag]) / whole[bag], 1.0) / many
    by_w = np.zeros(len(w))
    for b in blocks:
        np.add.at(by_w, features[b], g[rows[b]])
    return float(loss), by_w, float(g.sum())


def pack(rows: np.ndarray, features: np.ndarray) -> bytes:
    """The features of a document's sentences, each once a sentence, compressed: how many each sentence has, then the features, four bytes each."""
    if not len(rows):
        return b""
    key = np.unique(np.unique(rows, return_inverse=True)[1].astype(np.int64) << 32 | features)
    counts = np.bincount(key >> 32)
    fields = (np.array([len(counts)]), counts, key & 0xFFFFFFFF)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<u4").tobytes() for x in fields))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of each sentence, features) as pack() took them."""
    if not data:
        return np.zeros(0, "<u4"), np.zeros(0, "<u4")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")
    return raw[1 : 1 + raw[0]], raw[1 + raw[0] :]


def fit(docs: DataFrame, labels: DataFrame, bits: int = HASH_BITS) -> Model | None:
    """A model of the texts of docs (doc_id, text) that labels (doc_id, y), of bounded size, names. None without rows of both classes."""
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(labels, "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textfeatures.as_bytes(batch.column(1))
            packed = []
            for a, b in textfeatures.chunks(texts):
                if len(texts[a]) > textfeatures.CHUNK_BYTES:
                    packed.append(_pack_long(texts[a], bits))
                    continue
                doc, _, _, rows, features = sentences(texts[a:b], bits)
                order = np.argsort(rows, kind="stable")
                rows, features = rows[order], features[order]
                of = doc[rows]
                for i in range(b - a):
                    lo, hi = np.searchsorted(of, i), np.searchsorted(of, i, side="right")
                    packed.append(pack(rows[lo:hi], features[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["doc_id", "f", "y"])

    got = gathered(small_batches(sample).select("doc_id", "text", "y").mapInArrow(encode, "doc_id long, f binary, y int"))
    y = np.array(got.column("y").to_pylist(), dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    counts, features = zip(*map(unpack, got.column("f").to_pylist()))
    del got
    bag = np.repeat(np.arange(len(y)), [len(c) for c in counts])
    documents = np.zeros(1 << bits, dtype=np.int32)
    for x in features:
        documents[np.unique(x)] += 1
    used = np.flatnonzero(documents >= LEAST_DOCUMENTS)
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    features = place[np.concatenate(features)]
    kept = features >= 0
    rows = np.repeat(np.arange(len(bag), dtype=np.int32), np.concatenate(counts))[kept]
    features = features[kept]
    del kept
    w, bias = train(rows, features, bag, y, len(used))
    weights = np.zeros(1 << bits)
    weights[used] = w
    del rows, features, bag
    release()
    return Model(weights, float(bias), bits)


def _pack_long(text: bytes, bits: int) -> bytes:
    rows, features, at = [], [], 0
    for a, b, _ in textfeatures.pieces(text, _ENDS):
        doc, _, _, r, f = sentences([text[a:b]], bits)
        rows.append(r + at)
        features.append(f)
        at += len(doc)
    return pack(np.concatenate(rows), np.concatenate(features))


def train(rows: np.ndarray, features: np.ndarray, bag: np.ndarray, y: np.ndarray, many: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights of many features, bias): Adam steps on gradient(), with a pull of size L1 to zero."""
    w, bias = np.zeros(many), -4.0
    m, v = np.zeros(many + 1), np.zeros(many + 1)
    weight = np.minimum(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 5.0)
    for k in range(1, rounds + 1):
        _, by_w, by_bias = gradient(w, bias, rows, features, bag, y, weight)
        grad = np.concatenate((by_w, [by_bias]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = STEP / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        w -= scale[:-1] * m[:-1] / (1 - 0.9**k)
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * scale[:-1], 0)  # features without steady evidence stay at zero
        bias -= scale[-1] * m[-1] / (1 - 0.9**k)
    return w, bias


OFFENDING = "array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model | None, located_from: float = SENTENCE_THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of docs (text and others) with score, predicted and offending: byte spans of the sentences of at least located_from, in order of place.

    Null is scored as empty; a text without words scores zero. A text of more than a megabyte is read in pieces cut between sentences or, within a
    longer one, between words; its score is that of the whole."""
    given = [*columns] if "text" in columns else [*columns, "text"]
    at = given.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = textfeatures.as_bytes(batch.column(at))
            got, spans = np.full(len(texts), NEUTRAL), [[] for _ in texts]
            if model is not None:
                for a, b in textfeatures.chunks(texts):
                    got[a:b], (doc, start, end, p) = model.scores(texts[a:b])
                    for i in np.flatnonzero(p >= located_from):
                        spans[a + doc[i]].append({"start": int(start[i]), "end": int(end[i]), "score": float(p[i])})
            del texts
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(got), pa.array(spans, kind)], names=[*columns, "score", "offending"])
        release()

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns], "score double", f"offending {OFFENDING}"])
    return small_batches(docs).select(*given).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, train: Column, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """docs (doc_id, text) scored by a model of the rows of labels (doc_id, label in {0, 1}) where train holds.

    A row for each input row; rows with null doc_id are scored but never learnt from; null labels are left out; a document with
    several labels counts as toxic if any label says so."""
    return score(docs, fit(docs, sampled_labels(labels, train, max_fit_rows, balanced=True)))
