import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    x = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    return x - (1 << 64) if x >> 63 else x


def brute_classes(fps):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 2:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return {d: find(d) for d in fps}


def test_hash_is_sparks_xxhash64(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("one two drei")).alias("h")).first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("one two drei".encode(), 42)


def test_masks_cover_every_pair():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert all(any(all(not m >> i & 1 for i in c) for m in masks) for c in combinations(range(64), radius))


def test_documents_with_odd_values(spark):
    rows = [(1, None, None, "x"), (2, "", "en", "y"), (3, " \t\n", "en", None), (4, "One  two\nTHREE four", "en", "z"), (5, "one two three four", None, ""), (6, "a", "en", ""), (None, "a", "en", ""), (7, "Ä " * 3000, "de", ""), (4, "One  two\nTHREE four", "en", "z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            assert by[doc_id].fp == brute_fingerprint(text), doc_id
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 4, 6]
    assert by[None].component_id == 6
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_equal_brute_force_on_chains_and_large_buckets(spark):
    rng = random.Random(5)
    fps = {}
    for base in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):  # a walk: neighbours differ in 1 to 3 bits
            fps[len(fps) * 3 + 1] = x
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    dense = rng.getrandbits(64)
    for _ in range(150):
        y = dense
        for _ in range(rng.randint(0, 4)):
            y ^= 1 << rng.randrange(20)
        fps[len(fps) * 3 + 1] = y
    keep = {}
    for d, x in fps.items():
        keep.setdefault(x, d)
    nodes = {d: x for x, d in keep.items()}
    df = spark.createDataFrame([(d, simhash._signed(x)) for d, x in nodes.items()], "node long, fp long")
    want = brute_classes(nodes)
    for limit in (0, 4, 64):
        got = {d: d for d in nodes} | {r.node: r.root for r in simhash.components(simhash.links(df, pairwise_limit=limit)).collect()}
        assert got == want, limit


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(simhash, "saved", lambda df, own=simhash.saved: rounds.append(1) or own(df))
    path = [(i + 1, i) for i in range(40)]
    cases = [([], {}, 1), ([(2, 1), (3, 1), (5, 4)], {2: 1, 3: 1, 5: 4}, 1), ([(2, 1), (3, 2)], {2: 1, 3: 1}, 2), ([*path, (90, 80)], {a: 0 for a, _ in path} | {90: 80}, 7)]
    for edges, want, most in cases:
        rounds.clear()
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want and len(rounds) <= most, (edges, len(rounds))
