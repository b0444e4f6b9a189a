import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import importance

SCHEMA = "doc_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, runs=2):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, share=25, min_words=20):
    own = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, _, f in own:
        np.add.at(s, np.array(f, np.int64) % 10_000, 1)
    for (x,) in target:
        np.add.at(t, np.array(features(x)[1], np.int64) % 10_000, 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, w, f in own:
        weight = sum(gain[x % 10_000] for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(w)])
    order = sorted((r for r in out if r[0] is not None and r[4] >= min_words), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: share * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def found(spark, docs, target, **kinds):
    d = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as buckets", "2 as place", "3 as total", "'x' as eligible")
    return sorted((tuple(r) for r in importance.resample(d, spark.createDataFrame(target, "text string").selectExpr("*", "1 as doc_id"), **kinds).collect()), key=str)


def corpus(n):
    rng = random.Random(4)
    letters = "abcdeXYZ0189éßÄあ\U0001f600"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 9, 70])))
    known = [word() for _ in range(60)]
    return [(i, "".join(rng.choice(known) + rng.choice([" ", "  ", "\n", ", ", "\x85", " ", "_", "\x7f"]) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    docs, target = corpus(120), [(t,) for _, t in corpus(15)]
    got = found(spark, docs, target)
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 5


def test_edge_cases(spark):
    docs = corpus(30) + [(None, "a b " * 20), (None, None), (100, None), (101, ""), (102, ".,; \n"), (103, "one"), (104, "w" * 300_000), (105, "ab " * 300_000)]
    docs += [(200, "same text " * 15)] * 3
    for target in ([], [(None,), ("",)], [("ab ab",)]):
        assert found(spark, docs, target) == brute(docs, target)
    assert found(spark, [], [("a",)]) == []
    assert [r[4] for r in found(spark, docs, [("ab",)], share=0)] == [None] * len(docs)


def test_crc_of_runs_from_payloads():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"y"), (b"abc", b"d" * 63), (b"abc", b"e" * 64), (b"q" * 70, b"f" * 100_001)):
        crc = importance.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert crc[0] == zlib.crc32(a + b)
    words = ["a", "bb", "é" * 40, "ccc", "a"]
    crc, length = np.array([zlib.crc32(w.encode()) for w in words], np.uint32), np.array([len(w.encode()) for w in words])
    assert importance.composed(crc, length, 3).tolist() == features(" ".join(words), 3)[1]
