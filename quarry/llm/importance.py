"""Importance resampling towards a target: hashed runs of words of the corpus and of a target are counted, and documents are drawn by their mean log ratio and Gumbel noise.

Words are found by an Aho-Corasick automaton. Its dictionary holds each distinct word of a batch once, with a delimiter at both ends, so a word in a text is exactly one match;
the match emits the word's payload: its CRC-32 and its length. The CRC of a run of words follows from the payloads of adjacent words alone, as a CRC is linear: that of `a b` is
that of `a ` moved on by the length of b, xor that of b. So each distinct word is hashed once a batch, and runs of words never exist as strings.
A batch's dictionary is bounded by the batch, not by the vocabulary of the corpus; longer texts are scanned in stretches of STRETCH bytes cut between words.
"""

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, release, saved, small_batches

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 25
SEED = 7
STRETCH = 4 << 20

# A to Z become lower case; letters, digits and all bytes from 0x80 on are of words; the others delimit.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SHORT = 64


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with these 32 columns, of each of x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """by_length[n, byte, value]: what a CRC's byte gives when it is moved on by n < SHORT bytes. powers[k]: columns of the move by SHORT << k bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = np.array([(v >> 8) ^ (zlib.crc32(bytes([v & 255])) ^ zlib.crc32(b"\0")) for v in unit.tolist()], dtype=np.uint32)  # one zero byte, without the final complement
    columns, by_length = unit.copy(), np.empty((SHORT, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for n in range(SHORT):
        for byte in range(4):
            by_length[n, byte] = _times(columns, values << np.uint32(8 * byte))
        columns = _times(step, columns)
    powers = [columns]
    for _ in range(25):
        powers.append(_times(powers[-1], powers[-1]))
    return by_length, powers


_BY_LENGTH, _POWERS = _moves()


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes: crc(a + b) is moved(crc(a), len(b)) ^ crc(b)."""
    short = length % SHORT
    out = np.zeros_like(crc)
    for byte in range(4):
        out ^= _BY_LENGTH[short, byte, crc >> np.uint32(8 * byte) & np.uint32(255)]
    rest, k = length // SHORT, 0
    while rest.any():
        far = (rest & 1).astype(bool)
        out[far] = _times(_POWERS[k], out[far])
        rest, k = rest >> 1, k + 1
    return out


class Dictionary:
    """The distinct words of some texts in an automaton, and their payloads."""

    def __init__(self, folded: list[bytes]):
        words: set[bytes] = set()
        for text in folded:
            words.update(text.split())
        self.crc = np.empty(len(words), np.uint32)
        self.length = np.empty(len(words), np.int64)
        self.automaton = ahocorasick.Automaton()
        for payload, word in enumerate(words):
            self.crc[payload], self.length[payload] = zlib.crc32(word), len(word)
            self.automaton.add_word(f" {word.decode('latin-1')} ", payload)  # a byte is a letter of the automaton
        if words:
            self.automaton.make_automaton()

    def scan(self, folded: bytes) -> np.ndarray:
        """The payloads' numbers of all words of a text, in order."""
        if not len(self.crc):
            return np.empty(0, np.int64)
        return np.fromiter((payload for _, payload in self.automaton.iter(f" {folded.decode('latin-1')} ")), dtype=np.int64)


def stretches(folded: bytes, size: int = STRETCH) -> list[bytes]:
    """folded in parts of about size bytes, cut at delimiters."""
    parts, at = [], 0
    while len(folded) - at > size:
        cut = folded.find(b" ", at + size)
        if cut < 0:
            break
        parts.append(folded[at:cut])
        at = cut + 1
    return [*parts, folded[at:]]


def composed(crc: np.ndarray, length: np.ndarray, runs: int) -> np.ndarray:
    """CRCs of all runs of 1 to runs adjacent words joined by a space."""
    space = np.uint32(zlib.crc32(b" "))
    out, so_far = [crc], crc
    for n in range(2, runs + 1):
        if len(crc) < n:
            break
        so_far = moved(moved(so_far[:-1], np.ones(len(so_far) - 1, np.int64)) ^ space, length[n - 1 :]) ^ crc[n - 1 :]
        out.append(so_far)
    return np.concatenate(out)


def _features(runs: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known = Dictionary(texts)
        for text in texts:
            found = known.scan(text)
            yield known.crc[found], known.length[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD) for x in batch.column(1)]
            short = words_of([t for t in texts if len(t) <= STRETCH])
            counts, packed = [], []
            for text in texts:
                if len(text) <= STRETCH:
                    crc, length = next(short)
                else:
                    parts = [part for s in stretches(text) for part in words_of([s])]
                    crc, length = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
                counts.append(len(crc))
                packed.append((composed(crc, length, runs) % np.uint32(buckets)).astype(kind).tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array([len(p) // kind().itemsize for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])
        release()

    return run


def featured(docs: DataFrame, runs: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets binary: the bucket of each feature) of each row; null texts have none."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features(runs, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _unpacked(data: pa.Scalar, buckets: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint16 if buckets <= 1 << 16 else np.uint32)


def counted(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: one row a bucket and task is shuffled, one number a bucket comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(_unpacked(data, buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    sums = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, floored; every bucket is counted once more than it occurs."""
    size, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the floored mean of the gains of a row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = []
            for data in batch.column(3):
                own = gain[_unpacked(data, len(gain))]
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, runs: int = 2) -> DataFrame:
    """docs: doc_id, text, any more; target: text, any more. (doc_id, n_features, weight, score, rank), a row for each row of docs.

    Of the rows with an id and at least min_words words, share percent (rounded down) with the highest scores are drawn; rank is their place from 1, ties go to the smaller doc_id.
    Rows that repeat an id are drawn each by itself, in any order among equal ones. A row without an id has a weight, no score and no rank, and isn't counted.
    Null and empty texts have no features and weight 0. An empty table gives no rows; an empty target leaves all buckets at one occurrence."""
    own = saved(featured(docs, runs, buckets))
    aim = featured(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets)
    gain = gains(counted(own, buckets), counted(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighted(own, gain).withColumn("score", F.col("weight") + noise).withColumn("eligible", (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    rows = placed(scored.withColumn("down", -F.col("score")), ["eligible"], ["down", "doc_id"])
    drawn = F.col("eligible") & ((F.col("place") + 1) * 100 <= F.col("total") * share - F.pmod(F.col("total") * share, F.lit(100)))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


ORACLE_SQL = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
rows AS (SELECT 0 AS part, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT part, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM rows),
runs AS (
  SELECT part, k, doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM words),
features AS (SELECT part, k, unnest(f) AS f FROM runs),
kinds AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM features),
buckets AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM kinds CROSS JOIN crc),
counts AS (SELECT b, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM features JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS BIGINT) AS gain FROM counts),
weights AS (SELECT k, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE part = 0 GROUP BY k),
noise AS (
  SELECT k, doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, sha256('7:' || doc_id) AS d FROM runs WHERE part = 0),
hashes AS (
  SELECT *, list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', d[i]) - 1 AS BIGINT)), lambda a, x: a * 16 + x) AS h FROM noise),
scores AS (
  SELECT doc_id, n_words, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM hashes LEFT JOIN weights USING (k)),
ranks AS (
  SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS ok, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND r <= 25 * n // 100 THEN r END AS rank FROM ranks
"""
