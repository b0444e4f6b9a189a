"""The pipeline on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing
from quarry.llm.common import DOCUMENT_COLUMNS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(tmp_path, spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, labels = [], []
    passage = prose(60)
    for i in range(240):
        text = prose(80)
        toxic = i % 6 == 0
        if toxic:
            text += ". you vileword. " + prose(10)
        if i in (101, 103, 105):
            text = prose(20) + " " + passage + " " + prose(20)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(500, rows[50][1], "en", "s1", 9), (501, rows[51][1] + " more", "de", "s1", 9), (502, None, None, None, None), (None, prose(30), "en", "s2", 5), (503, "", "fr", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, {i for i, _, t in labels if t}, passage


def test_stages(spark, tmp_path):
    rows, toxic, passage = planted(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in got} for name, got in kept.items()}
    clean = {r[0] for r in rows} - toxic
    assert ids["toxicity"] == clean
    assert 500 not in ids["simhash"] and 51 in ids["simhash"] and {None, 502} <= ids["simhash"] and 503 not in ids["simhash"]
    assert clean - ids["simhash"] <= {500, 501, 503}
    texts = {r.doc_id: r.text for r in kept["suffix"]}
    assert ids["suffix"] == ids["simhash"] and passage in texts[101] and passage not in texts[103] and passage not in texts[105]
    before = {r.doc_id: r.text for r in kept["simhash"]}
    assert all(texts[i] == (before[i] or "") for i in ids["suffix"] - {101, 103, 105, 501})
    assert ids["mixing"] <= ids["suffix"] and len(ids["mixing"]) < len(ids["suffix"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(kept["mixing"]) and all(r.n_tokens == len(r.ids) for r in last)


def test_run_and_empty_table(spark, tmp_path):
    planted(tmp_path, spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_repeated_and_missing_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    same, rows = prose(50), []
    rows += [(7, prose(40), "en", f"s{i % 3}", 1) for i in range(6)] + [(None, prose(40), "de", "s1", 1) for _ in range(5)] + [(8, same, "en", "s0", 1)] * 3 + [(9, "word " * 150_000, "en", "s2", 1), (10, None, None, None, None), (11, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as times", "3 as time", "'x' as batch", "4 as domain", "'y' as taken")
    near = corpus_pipeline.near_duplicates_out(spark, docs, str(tmp_path)).collect()
    assert len(near) == 6 + 5 + 1 + 1 + 1  # copies of 8 and the two texts without words are one each
    cut = corpus_pipeline.repeats_out(spark, docs, str(tmp_path))
    assert cut.count() == len(rows)
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    words = lambda t: len((t or "").split())
    total, longest = sum(words(r[1]) for r in rows), max(words(r[1]) for r in rows)
    assert total * 0.9 <= sum(words(r.text) for r in mixed) <= total + 12 * longest
    counts = {}
    for r in mixed:
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(n for (i, _), n in counts.items() if i != 8) <= mixing.MAX_EPOCHS + 1
    encoded = corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(rows) and sum(r.n_tokens == 0 for r in encoded) == 2


def test_repeats_out_has_one_python_function_a_stage(spark, tmp_path):
    """Two in a row have a worker each at the same time, and the workers outlive the stage."""
    docs = spark.createDataFrame([(1, "é" * 60, "en", "s", 60), (2, "xé" + "é" * 60 + "ö", "en", "s", 63)], SCHEMA)
    cut = corpus_pipeline.repeats_out(spark, docs, str(tmp_path))
    found = []

    def walk(node, before):
        name = node.nodeName()
        here = "Arrow" in name
        found.append(name if here and before else "")
        before = (before or here) and "Exchange" not in name
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), before)

    plan = cut._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if "Adaptive" in plan.nodeName() else plan, False)
    assert len(found) > 5 and not any(found)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "é" * 60, 2: "x"}  # the first byte of the last letter ends a repeated string, so its second goes too
