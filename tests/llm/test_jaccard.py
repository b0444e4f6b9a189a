import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import jaccard

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def changed(words, places):
    return [w + "x" if i in places else w for i, w in enumerate(words)]


def brute(rows, words=4, numerator=85, denominator=100):
    """[(doc_id, n_shingles, component_id)] by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and denominator * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, **kinds):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as node", "'x' as source", "3 as region")
    return sorted((tuple(r) for r in jaccard.near_copies(docs, **kinds).collect()), key=str)


def test_edge_cases(spark):
    rng = random.Random(1)
    same = prose(rng, 50)
    rows = [(1, None), (2, ""), (3, " \t "), (None, " ".join(same)), (5, " ".join(same)), (4, " ".join(same).upper()), (6, "two words"), (7, "Two  Words"), (None, "lonely text"), (8, "lonely"), (8, "lonely"), (9, " ".join(changed(same, {10}))), (10, "Kelvin K k"), (11, "kelvin k k")]
    rows += [(12, "word " * 100_000), (13, "word " * 50)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("direct", [2, 32])
def test_equals_brute_force_where_neighbourhoods_are_crowded(spark, direct):
    """Rings around a base, chains with unlike ends, texts that share a passage or are made of two common ones, and pairs on both sides of the limit."""
    rng = random.Random(2)
    texts, base, passage = [], prose(rng, 120), prose(rng, 50)
    texts += [changed(base, set(rng.sample(range(120), k))) for k in (1, 2, 3, 4, 5, 6) for _ in range(12)]
    chain = prose(rng, 100)
    for i in range(40):
        chain = changed(chain, {(i * 7 + 3) % 100})
        texts.append(chain)
    texts += [prose(rng, rng.randrange(5, 60)) + passage for _ in range(45)]
    texts += [passage + prose(rng, k % 9) + base for k in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    want = brute(rows)
    assert 3 < len({c for _, _, c in want}) < len(rows)
    assert found(spark, rows, direct=direct) == want


def test_limit_is_exact(spark):
    """Pairs at 0.80 and just under it, by words of five and four fifths."""
    rng = random.Random(5)
    one, two = prose(rng, 49), prose(rng, 49)  # 45 runs of five
    rows = [(1, " ".join(one)), (2, " ".join(one[:44] + ["q"] * 5)), (3, " ".join(two)), (4, " ".join(two[:43] + list("abcdef")))]
    assert brute(rows, 5, 80) == [(1, 45, 1), (2, 45, 1), (3, 45, 3), (4, 45, 4)]
    assert found(spark, rows, words=5, numerator=80) == brute(rows, 5, 80)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        b = np.union1d(b, a[: rng.integers(0, len(a) + 1)])
        differ = len(np.setxor1d(a, b))
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(jaccard.parities(a).tolist(), jaccard.parities(b).tolist()))
        assert bits <= differ
    order = jaccard.rarest_first(np.array([5, 9, 70], np.uint64) << np.uint64(24), np.array([5, 70], np.uint64), np.array([9, 4], np.uint8))
    assert (order >> np.uint64(24)).tolist() == [9, 70, 5]
    assert [jaccard.prefix_length(n, 85, 100) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]


def test_tables_of_few_sets_have_few_partitions_and_a_pivot_one_region(spark, monkeypatch):
    """However many partitions the session has; and regions that share a crowd don't repeat it for each pivot that they share."""
    rng = random.Random(7)
    base = prose(rng, 90)
    texts = [changed(base, set(rng.sample(range(90), k))) for k in (2, 4, 6, 8) for _ in range(15)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made, divided, saved, divide = [], [], jaccard.saved, jaccard.Join._divided
    monkeypatch.setattr(jaccard, "saved", lambda df: made.append(saved(df)) or made[-1])
    monkeypatch.setattr(jaccard.Join, "_divided", lambda self, members, drawn, seen: divided.append((saved(divide(self, members, drawn, seen)), drawn)) or divided[-1][0])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(kept, ("12", "false")):
        spark.conf.set(k, v)
    try:
        assert found(spark, rows, direct=4) == brute(rows)
        assert max(df.rdd.getNumPartitions() for df in made[3:-1]) <= jaccard.LEAST_PARTS
        got, drawn = divided[0]
        near = got.where("not divided and distance > 0")
        assert 0 < near.select("region").distinct().count() <= drawn.select("pivot").distinct().count() < drawn.count()
        assert near.count() == near.select("region", "node").distinct().count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
