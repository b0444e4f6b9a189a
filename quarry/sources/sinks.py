"""Sinks: snapshots replaced by repository, tables that only grow, reports."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


VERSION = "repo_id string, version string, committed_at timestamp"


def _manifest(path: str, spark: SparkSession) -> DataFrame:
    """(repo_id, version): the version of each repository that holds. Of the manifest's rows, which only grow, the last counts."""
    rows = spark.read.schema(VERSION).parquet(f"{path}/manifest")
    return rows.groupBy("repo_id").agg(F.max_by("version", F.struct("committed_at", "version")).alias("version"))


def replace_snapshot(df: DataFrame, path: str, repositories: DataFrame | None = None) -> str:
    """Write df (repo_id, ...) as the new state of the given repositories (repo_id), or else of those that df has; other repositories keep theirs. One of the given that has no rows in df is empty from then on.

    Rows go to a folder of their own version first; then one file of the manifest, which Spark's committer shows whole or not at all, names that version for the repositories. Readers never see a state in
    between, and a run that is lost before leaves nothing that counts. Gives the version."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/rows")
    named = repositories if repositories is not None else df
    named.select("repo_id").distinct().withColumns({"version": F.lit(version), "committed_at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of replace_snapshot() that hold: each repository's in the version that the manifest names last. schema: that of the rows."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", StringType())])).parquet(f"{path}/rows")
    return rows.join(_manifest(path, spark), ["repo_id", "version"], "left_semi").select(*schema.names)


def append_run(df: DataFrame, path: str, run_id: str, version: str = "1") -> None:
    df.withColumns({"run_id": F.lit(run_id), "analyzer_version": F.lit(version), "written_at": F.current_timestamp()}).write.mode("append").parquet(path)


def report(evaluations: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """One nested row for each evaluation_id: the evaluation, its category scores and evidence, best first."""
    s = scores.groupBy("evaluation_id").agg(F.sort_array(F.collect_list(F.struct("score", "category")), asc=False).alias("scores"))
    e = evidence.groupBy("evaluation_id").agg(F.sort_array(F.collect_list(F.struct("confidence", "claim")), asc=False).alias("evidence"))
    return evaluations.join(s, "evaluation_id", "left").join(e, "evaluation_id", "left")


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("evaluation_id", F.to_json(F.struct("*")).alias("report"))


def report_markdown(reports: DataFrame) -> DataFrame:
    """(evaluation_id, report): heading, score line, a table of categories, a list of claims."""
    rows = F.array_join(F.transform("scores", lambda s: F.concat(F.lit("| "), s.category, F.lit(" | "), F.coalesce(F.format_number(s.score, 1), F.lit("not measured")), F.lit(" |"))), "\n")
    claims = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e.claim)), "\n")
    parts = [F.concat(F.lit("# Evaluation "), F.col("evaluation_id").cast("string")), F.lit(""), F.lit("| category | score |\n|---|---|"), F.coalesce(rows, F.lit("")), F.lit(""), F.coalesce(claims, F.lit(""))]
    return reports.select("evaluation_id", F.concat_ws("\n", *parts).alias("report"))
