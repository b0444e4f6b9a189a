import random
from itertools import combinations

import corpus_pipeline
from quarry.llm import nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)


def prose(n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def changed(words, places):
    return [w + "x" if i in places else w for i, w in enumerate(words)]


def brute(texts, similarity=0.8):
    """The root of each text by all pairs of sets of five-word runs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) >= similarity * both:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_stage_drops_near_copies(spark, tmp_path):
    base, other = prose(200), prose(100)
    copy, unlike = changed(base, {50, 100, 150}), changed(base, set(range(0, 200, 20)))
    assert bin((simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(copy))) & (2**64 - 1)).count("1") > simhash.RADIUS
    texts = [(1, base), (2, copy), (3, unlike), (4, other), (None, other), (None, prose(50)), (7, prose(60)), (7, prose(60)), (9, [])]
    rows = [(i, " ".join(w), "en", "s", len(w)) for i, w in texts] + [(10, None, None, None, None), (4, " ".join(other), "en", "s", 100)]
    got = corpus_pipeline.near_duplicates_out(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, " ".join(w)) for i, w in [texts[0], texts[2], texts[3], texts[5], texts[6], texts[7], texts[8]])
    assert corpus_pipeline.near_duplicates_out(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_classes_equal_brute_force_with_large_groups(spark):
    texts = [" ".join(prose(40)) for _ in range(30)]
    base = prose(150)
    texts += [" ".join(changed(base, {rng.randrange(150)})) for _ in range(150)]  # each near its neighbours
    for i in range(60):  # a chain: ends are unlike
        base = changed(base, {i * 2 + 5})
        texts.append(" ".join(base))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row as doc_id", "text")
    want = brute(texts)
    for limit in (4, 32):
        got = {r.row: r.root for r in nearcopies.classes(rows, pairwise_limit=limit).collect()}
        assert len({(got[i], want[i]) for i in range(len(texts))}) == len(set(want)) == len(set(got.values())), limit


def test_rounds_give_up_what_earlier_ones_left_on_the_driver(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    base = prose(150)
    texts = [" ".join(changed(base, {rng.randrange(150)})) for _ in range(60)]
    before = whole()
    got = nearcopies.classes(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), pairwise_limit=4).collect()
    assert len({r.root for r in got}) == len(set(brute(texts))) and len(got) == 60
    assert whole() >= before + 2
