"""The two trained models against naive versions of their equations, and texts longer than a piece."""

import math
import random

import numpy as np

from quarry.llm import quality, textfeatures, toxicity


def noisy_or_loss(w, bias, documents, y, weight):
    """documents: for each a list of sentences, each a list of features."""
    total = 0.0
    for sentences, label, k in zip(documents, y, weight):
        clean = 1.0
        for features in sentences:
            clean *= 1 - 1 / (1 + math.exp(-(sum(w[f] for f in features) + bias)))
        whole = min(max(1 - clean, 1e-9), 1 - 1e-9)
        total -= k * math.log(whole if label else 1 - whole)
    return total / len(y)


def test_noisy_or_gradient_equals_finite_differences():
    rng = random.Random(5)
    documents = [[[rng.randrange(9) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(0, 4))] for _ in range(25)]
    y, weight = np.array([i % 3 == 0 for i in range(25)], float), np.array([1.0 + i % 2 for i in range(25)])
    w, bias = np.array([rng.uniform(-1, 1) for _ in range(9)]), -0.5
    flat = [(i, s) for i, d in enumerate(documents) for s in d]
    rows = np.concatenate([[k] * len(s) for k, (_, s) in enumerate(flat)]).astype(int)
    features, bag = np.concatenate([s for _, s in flat]), np.array([i for i, _ in flat])
    loss, by_w, by_bias = toxicity.gradient(w, bias, rows, features, bag, y, weight)
    assert abs(loss - noisy_or_loss(w, bias, documents, y, weight)) < 1e-9
    step = 1e-6
    for f in range(9):
        up, down = w.copy(), w.copy()
        up[f] += step
        down[f] -= step
        assert abs((noisy_or_loss(up, bias, documents, y, weight) - noisy_or_loss(down, bias, documents, y, weight)) / (2 * step) - by_w[f]) < 1e-6
    assert abs((noisy_or_loss(w, bias + step, documents, y, weight) - noisy_or_loss(w, bias - step, documents, y, weight)) / (2 * step) - by_bias) < 1e-6
    trained, b = toxicity.train(rows, features, bag, y, 9, rounds=300)
    assert toxicity.gradient(trained, b, rows, features, bag, y, weight)[0] < loss


def test_dual_coordinate_descent_equals_projected_gradient():
    rng = np.random.default_rng(2)
    x = (rng.random((40, 12)) < 0.4).astype(float)
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + 0.3 * rng.normal(size=40) > 0.5, 1.0, -1.0)
    scale, cost = rng.uniform(0.2, 1.5, 12), 0.3
    w, bias = quality.dual_coordinate_descent([np.flatnonzero(r) for r in x], y, scale, cost, 2000)
    full = np.column_stack((x * scale, np.ones(40))) * y[:, None]
    q = full @ full.T
    alpha = np.zeros(40)
    for _ in range(200_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    want = full.T @ alpha
    assert np.abs(np.append(w, bias) - want).max() < 5e-3
    objective = lambda v: v @ v / 2 + cost * np.maximum(0, 1 - full @ v).sum()
    assert abs(objective(np.append(w, bias)) - objective(want)) < 1e-4


def long_text(n):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "Sigma", "12"]
    return " ".join("".join([rng.choice(words), rng.choice([".", "", "", "", "!", ","])]) for _ in range(n)).encode()


def test_long_texts_score_as_wholes(monkeypatch):
    text = long_text(3000) + b" " + b"x" * 900 + b". end " + b"? more words " * 20
    rng = np.random.default_rng(1)
    tox = toxicity.Model(rng.normal(size=1 << 18) * 0.3, -4.0, 18)
    qual = quality.Model(rng.normal(size=1 << 18), 0.0, 0.01, 0.0, 18)
    want, (_, start, end, p) = tox.scores([text])
    best = qual.scores([text])
    monkeypatch.setattr(textfeatures, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(textfeatures.pieces, "__defaults__", (2000,))
    got, (_, s, e, q) = tox.scores([text])
    assert np.allclose(got, want) and s.tolist() == start.tolist() and e.tolist() == end.tolist() and np.allclose(p, q)
    assert np.allclose(qual.scores([text]), best)
    no_stops = text.replace(b".", b" ").replace(b"!", b" ").replace(b"?", b" ")
    got, (_, s, e, _) = tox.scores([no_stops])
    monkeypatch.undo()
    want, (_, start, end, _) = tox.scores([no_stops])
    assert np.allclose(got, want) and len(s) == len(start) == 1 and (s[0], e[0]) == (start[0], end[0])


def test_packed_features_come_back():
    rows, features = np.array([4, 4, 7, 7, 7, 9]), np.array([3, 3, 1, 2, 1, 200_000])
    counts, flat = toxicity.unpack(toxicity.pack(rows, features))
    assert counts.tolist() == [1, 2, 1] and flat.tolist() == [3, 1, 2, 200_000]
    assert [x.tolist() for x in toxicity.unpack(toxicity.pack(rows[:0], features[:0]))] == [[], []]


def test_gradient_reads_pairs_in_blocks():
    """The same numbers as over all pairs at once, without copies of them all."""
    import tracemalloc

    rng = np.random.default_rng(4)
    pairs, many = 3 * toxicity.BLOCK + 5, 5000
    rows, features = np.sort(rng.integers(0, many, pairs)).astype(np.int32), rng.integers(0, 900, pairs).astype(np.int32)
    bag, y, w = np.arange(many) // 5, rng.integers(0, 2, many // 5).astype(float), rng.normal(size=900) / 100
    tracemalloc.start()
    loss, by_w, _ = toxicity.gradient(w, -1.0, rows, features, bag, y, np.ones(len(y)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = toxicity._sigmoid(np.bincount(rows, weights=w[features], minlength=many) - 1.0)
    whole = 1 - np.array([np.prod(1 - p[bag == i]) for i in range(len(y))])
    assert np.isclose(loss, -np.mean(np.where(y == 1, np.log(np.clip(whole, 1e-9, 1 - 1e-9)), np.log(np.clip(1 - whole, 1e-9, 1)))))
    assert by_w.shape == w.shape and most < 10 * pairs
