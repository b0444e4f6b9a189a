import numpy as np

from pyspark.sql import functions as F

from quarry.llm import ann


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=20):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df, **options):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], "x") for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], "hot") for i in range(300, 420)]
    rows += [(500, None, ""), (520, [0.0] * 6, ""), (540, [float("nan")] + [1.0] * 5, ""), (560, [float("inf")] + [1.0] * 5, ""), (580, [None] + [1.0] * 5, ""), (None, [1.0] * 6, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, entry string")
    got, want = found(df), brute(rows)
    assert got == want
    assert found(df.where("vec_id < 8")) == brute([r for r in rows if r[0] is not None and r[0] < 8])
    assert found(df.limit(0)) == {}


def test_recall_in_many_ranges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df, block_rows=100), brute(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_near_equal_vectors_are_searched_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate((np.ones((1500, 8)) + 1e-7 * rng.normal(size=(1500, 8)), rng.normal(size=(200, 8))))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    sizes = []
    parted = ann._parted

    def watched(dealt, visits, block_rows):
        out = parted(dealt, visits, block_rows)
        for side in out:
            sizes.append(max(r["count"] for r in side.groupBy("curve", "block", "part").count().collect()))
        return out

    monkeypatch.setattr(ann, "_parted", watched)
    got, want = found(df, block_rows=50), brute([(i, r.tolist()) for i, r in enumerate(x)])
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert sizes[0] < 200 and sizes[1] < 60
