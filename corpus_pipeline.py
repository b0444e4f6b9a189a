"""A training corpus from the table documents: toxic documents go, near duplicates go, repeated passages go, sources are mixed to
target weights, and what stays is encoded. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes
each stage's rows as Parquet in the folder that driver and executors share and reads them as the next one's docs."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, nearcopies, suffix, toxicity
from quarry.llm.common import DOCUMENT_COLUMNS, sampled_labels, saved, shared_folder, table

VOCABULARY = "word_bpe_49k.json"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It is learnt from a bounded sample of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, sampled_labels(labels, F.lit(True), toxicity.MAX_FIT_ROWS, balanced=True))
    return toxicity.score(docs, model, columns=DOCUMENT_COLUMNS).where("predicted = 0").select(*DOCUMENT_COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (Jaccard of five-word shingles 0.8 or more, see nearcopies) one row stays: that with the smallest id, a row without an id
    only if the class has no other. Texts without words are one class. Rows are told apart by 128 bits of hash over all their columns; rows that are equal in all of them are copies."""
    columns = [F.col(c) for c in DOCUMENT_COLUMNS]
    named = docs.select(*DOCUMENT_COLUMNS, F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("other"), *columns).alias("h2"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    first = nearcopies.classes(named.select(row.alias("row"), "text")).groupBy("root").agg(F.min("row").alias("first")).select("first.h1", "first.h2")
    return named.join(first.hint("merge"), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select(*DOCUMENT_COLUMNS)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; parts of a character at a cut go with them; n_chars is counted anew."""
    cut = suffix.dedup(docs, with_text=True, carry=("lang", "source"), decoded=True)
    texts = cut.select("doc_id", F.col("kept").alias("text"), F.element_at("carried", 1).alias("lang"), F.element_at("carried", 2).alias("source"))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mixture takes them: as many tokens as there are, so sources above their weight lose documents and those below come
    up to mixing.MAX_EPOCHS times. Each row counts by itself, whatever its id. A document in which a budget ends comes whole."""
    rows = saved(docs.select(*DOCUMENT_COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    taken = mixing.mix(rows.drop("doc_id").withColumnRenamed("row", "doc_id").withColumn("domain", mixing.domain_of(F.col("source"))))
    times = taken.groupBy(F.col("doc_id").alias("row")).agg(F.countDistinct("epoch").alias("times"))
    return rows.join(times, "row").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*DOCUMENT_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each whole text, a row for each row of docs; null and empty texts have no tokens."""
    got = bpe.encode(docs, public_tokenizers.path(VOCABULARY), with_decoded=False)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic_out), ("simhash", near_duplicates_out), ("suffix", repeats_out), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of encoded() for what the stages keep of the table documents. An empty table gives no rows; rows with null ids or texts and repeated ids
    go through like others (each stage says how). The stages' Parquet stays in the folder of checkpoints, as the result is read from it lazily."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
