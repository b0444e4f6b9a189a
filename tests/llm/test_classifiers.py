import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, textfeatures, toxicity
from quarry.llm.common import crc_part

BAD = ["vileword", "nastyterm", "foulthing"]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) for _ in range(8)) for _ in range(6)]
        toxic = int(i % 4 == 0)
        if toxic:
            at = rng.randrange(6)
            sentences[at] += " " + rng.choice(BAD)
        poor = int(i % 3 == 0)
        text = "! ".join(s.upper() for s in sentences) if poor else ". ".join(sentences)
        docs.append((i, text + ".", "x", 1.0))
        labels.append((i, 1 - poor, toxic))
    odd = [(9001, None, "x", 1.0), (9002, "", "x", 1.0), (None, "alpha beta", "x", 1.0), (5, docs[5][1], "x", 1.0)]
    return docs + odd, labels + [(9001, None, 1), (None, 1, 1), (5, labels[5][1], labels[5][2])]


@pytest.mark.parametrize("label,parts,held,how", [("toxic", 3, 1, toxicity.detect), ("quality", 4, 2, quality.classify)])
def test_held_out_accuracy_and_odd_rows(spark, label, parts, held, how):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string, score double")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.held_out_queries(d, y, label, parts, held, how).collect()
    assert len(rows) == len(docs)
    truth = {i: (q, t)[label == "toxic"] for i, q, t in labels if i is not None}
    test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    expected = {r.doc_id: r.h for r in d.select("doc_id", (crc_part("doc_id", parts) == held).alias("h")).collect()}
    assert all(r.held_out == (expected[r.doc_id] or False) for r in rows)
    assert how(d.limit(0), y.select("doc_id", F.col(label).alias("label")), F.lit(True)).count() == 0
    none = how(d, y.limit(0).select("doc_id", F.col(label).alias("label")), F.lit(True)).collect()
    assert len({r.score for r in none}) == 1


def test_offending_sentence_is_located(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string, score double")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", F.col("toxic").alias("label"))
    texts = {i: t for i, t, *_ in docs}
    toxic = {i for i, _, t in labels if t and i is not None and i < 9000}
    hits = misses = 0
    for r in toxicity.detect(d, y, F.lit(True)).collect():
        if r.doc_id in toxic:
            spans = [texts[r.doc_id].encode()[s.start : s.end].decode().lower() for s in r.offending]
            hits += any(b in s for s in spans for b in BAD)
            misses += any(not any(b in s for b in BAD) for s in spans)
    assert hits >= 0.95 * len(toxic) and misses <= 0.05 * len(toxic)


def test_hashes_depend_on_the_token_alone():
    t = textfeatures.Tokens([b"Word other", b"", b"x word\tWORD 12!!", b"word"])
    words = [bytes(t.raw[a:b]).lower() for a, b in zip(t.start, t.end)]
    assert words == [b"word", b"other", b"x", b"word", b"word", b"12", b"!!", b"word"]
    assert len({h for w, h in zip(words, t.hash) if w == b"word"}) == 1 and len(set(t.hash)) == 5
    assert t.doc.tolist() == [0, 0, 2, 2, 2, 2, 2, 3]
