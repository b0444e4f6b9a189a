"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, importance, jaccard, licenses, manifest, media, mixing, quality, simhash, suffix, toxicity, urlfilter
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.held_out_queries(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 3, 1, toxicity.detect)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.held_out_queries(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 4, 2, quality.classify)
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs.withColumn("domain", mixing.domain_of(F.col("source"))))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_from(pages))


VOCABULARY = "word_bpe_49k.json"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_media": op5_media,
    "op6_urlfilter": op6_urlfilter,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_suffix": op9_suffix,
    "op10_ann": op10_ann,
    "op11_importance": op11_importance,
    "op12_jaccard": op12_jaccard,
    "op13_manifest": op13_manifest,
}
ORACLES = {"op2_licenses": licenses.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op6_urlfilter": urlfilter.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_jaccard": jaccard.ORACLE_SQL, "op13_manifest": manifest.ORACLE_SQL}
