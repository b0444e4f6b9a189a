import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + more, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest, siblings = leaf(r, int(hit)), []
            for levels, at in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings += [other] if other else []
                    digest = h(other, digest) if at & 1 else h(digest, other)
                    at >>= 1
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*siblings), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "2 as place", "'x' as digest", "3 as total", "4 as block")
    return sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.randrange(30)))
    return [(i, text(), rng.choice(["en"] * 6 + ["de", "éé", "z", ""]), f"s{i % 3}", i % 50) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_equals_brute_force(spark, monkeypatch, levels):
    """Blocks of few levels take many rounds."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    for n in (1, 2, 3, 37) if levels > 1 else (9,):
        rows = corpus(n)
        assert found(spark, rows) == brute(rows), (levels, n)


def test_edge_cases(spark):
    rows = corpus(20) + [(None, "x", None, None, None), (None, "x", "en", "s", 3), (5000, None, None, None, None), (5001, "", None, "s", 2**63 - 1), (7, "y", "en", "s", 1), (7, "y", "en", "s", 1), (7, "x", "en", "s", 1), (6000, "long " * 200_000, "fr", "s", 9)]
    rows += [(i, "t", None, "s", 2**63 - 1) for i in range(6001, 6020)]
    got = found(spark, rows)
    assert got == brute(rows) and {r[6] for r in got} == {True, False}
    assert found(spark, []) == []


def test_proofs_hold_and_changes_show(spark):
    """Each leaf folds to the root by its path; with any other leaf it doesn't."""
    rows = corpus(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.verified for r in manifest.manifest(docs.where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 0"))).collect()} == {True}
    digests = {i: bytes([i]) * 32 for i in range(11)}
    levels = manifest.swept_up(digests, 4)
    paths = manifest.swept_down(levels, b"")
    top = levels[-1][0]
    assert all(manifest.folded(d, paths[i]) == top for i, d in digests.items())
    assert all(manifest.folded(bytes(32), paths[i]) != top for i in digests if i)
