import hashlib
import random

import numpy as np
import pytest

from quarry.llm import bwt, suffix


def brute(rows, span=50):
    first = {}
    datas = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    for d, b in datas:
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            first[w] = min(first.get(w, float("inf")), key(d))
    out = []
    for d, b in datas:
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < key(d):
                gone[i : i + span] = [True] * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_merged_transforms_give_classes_of_equal_prefixes():
    rng = random.Random(3)
    for alphabet in (b"ab", b"abcdef"):
        texts = sorted({bytes(rng.choice(alphabet) for _ in range(rng.randint(6, 40))) for _ in range(60)})
        parts = [texts[s::4] for s in range(4)]
        shards = [bwt.transform(p) for p in parts]
        joined = [b"\0".join(p) + b"\0" for p in parts]
        for part, (places, symbols), whole in zip(parts, shards, joined):
            keys = [(whole[p : whole.index(b"\0", p)], p) for p in places]
            assert [k[0] for k in keys] == sorted(k[0] for k in keys)
        for depth in (1, 3, 6):
            shard, row, classes = bwt.merge(shards, depth)
            seen, prior = {}, None
            for s, r, c in zip(shard, row, classes):
                p = shards[s][0][r]
                tail = joined[s][p : p + depth]
                if b"\0" in tail or len(tail) < depth:
                    continue
                assert seen.setdefault(c, tail) == tail and (prior is None or prior <= tail)
                prior = tail
            assert len(set(seen.values())) == len(seen)


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(30), "The same footer stands under every one of these pages, 2024.\n"
    rows = [(i, prose(rng.randint(0, 60))) for i in range(20)]
    rows += [(100 + i, prose(9) + passage[i % 5 :] + prose(4) + line + prose(i % 3)) for i in range(25)]
    rows += [(200 + i, rows[7][1]) for i in range(5)] + [(300, "x" * 400), (301, "x" * 120 + "y" + "x" * 60), (302, "ab" * 90), (303, "zz" + "ab" * 60)]
    rows += [(304, ""), (305, None), (306, passage), (2, rows[25][1]), (306, passage), (None, passage + "tail"), (None, rows[3][1]), (307, "\0" * 60 + "q"), (308, "p" + "\0" * 70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("common,batch", [(2000, 1 << 22), (2, 1 << 22), (3, 2000)])
def test_dedup_equals_brute_force(spark, monkeypatch, common, batch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int").repartition(3)
    monkeypatch.setattr(suffix.batches_of, "__defaults__", (batch, ()))
    got = suffix.dedup(df, common=common)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table_and_kept_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.dedup(df).count() == 0
    df = spark.createDataFrame([(2, "a" * 10 + "b" * 60), (1, "b" * 60)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix.dedup(df, with_text=True).collect()}
    assert got == {1: b"b" * 60, 2: b"a" * 10}


def test_runs_cover_every_string_once():
    rng = np.random.default_rng(5)
    lengths = np.array([0, 10, 49, 50, 51, 200, 0, 333])
    data = rng.integers(97, 100, lengths.sum()).astype(np.uint8)
    start, count, value, _ = suffix.runs(data, lengths, 50, 20)
    got = sorted(i for s, n in zip(start, count) for i in range(s, s + n))
    ends = np.cumsum(lengths)
    want = [i for e, n in zip(ends, lengths) for i in range(e - n, e - 49) if n >= 50]
    assert got == want


@pytest.mark.parametrize("common", [1, 2000])
def test_long_texts_in_stretches_and_a_line_in_every_document(spark, monkeypatch, common):
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = "the very same line of text is under each of the documents here"
    long = prose(900)
    rows = [(i, prose(rng.randint(0, 80)) + line + prose(5)) for i in range(40)] + [(50, long + line + long[:300]), (49, prose(30) + long[100:700]), (51, line * 8)]
    monkeypatch.setattr(suffix, "STEP_BYTES", 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in suffix.dedup(df, common=common).collect()), key=str) == brute(rows)


def test_a_common_text_is_one_entry_a_batch(spark):
    line = "the very same line of text is under each of the documents here"
    df = spark.createDataFrame([(i, f"{i} {line}") for i in range(400)], "doc_id long, text string").repartition(2)
    batches = suffix.batches_of(df).persist()
    codes = suffix.repeated(batches, 4, 50, 20, 10)
    sent = suffix.stretches(batches, codes, 4, 50, 20).collect()
    opened = [suffix._opened(r.data) for r in sent]
    assert all(len(own) == len(texts) for texts, own, *_ in opened) and sum(r.local is not None for r in sent) == batches.count()


def test_a_batch_without_repeats(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "".join(rng.choice("abcdefgh") for _ in range(120))) for i in range(6)], "doc_id long, text string").repartition(2)
    assert [r.n_removed for r in suffix.dedup(df).collect()] == [0] * 6
