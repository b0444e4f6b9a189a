"""Readers of checked-out trees, commit-log dumps, hosting exports and résumés."""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .trees import TreeSource

RECORD, FIELD = "\x1e", "\x1f"
NUMSTAT = r"^(\d+|-)\t(\d+|-)\t(.+)$"


def other_encoding(content: pd.Series) -> pd.Series:
    """Text of files that aren't valid UTF-8: UTF-16 by its byte-order mark, or little-endian without one, if all of it is valid; else Latin-1. Nulls stay."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            return data.decode("utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-16-le")
        except UnicodeDecodeError:
            return data.decode("latin-1")

    return content.map(one)


def decoded(content: Column) -> Column:
    """Text of a file: null where the first 8192 bytes hold a zero byte; else UTF-8, or other_encoding() where it isn't valid. Only files that aren't UTF-8 go to Python."""
    binary = F.hex(F.substring(content, 1, 8192)).rlike("^(..)*00")
    utf8 = F.try_validate_utf8(content.cast("string"))
    rest = F.pandas_udf(other_encoding, "string")(F.when(~binary & utf8.isNull(), content))
    return F.when(~binary, F.coalesce(utf8, rest))


def read_files(spark: SparkSession, root: str, max_bytes: int = 1 << 20) -> DataFrame:
    """(repo_id, path, text, size_bytes, content_hash) of the trees root/<repo_id>/...: ignored folders and larger files are left out at the listing."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("trees").option("path", root).option("maxbytes", max_bytes).load()
    return found.select("repo_id", "path", decoded(F.col("content")).alias("text"), "size_bytes", F.sha2("content", 256).alias("content_hash"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from dumps of records (0x1E) of fields (0x1F): sha, author, e-mail, ISO time, parents, body with numstat lines at its end.

    (repo_id: the dump's file name, sha, author_name, author_email, committed_at, is_merge, message, files array<struct<path, added, removed>>)."""
    raw = spark.read.option("lineSep", RECORD).text(path).withColumn("file", F.col("_metadata.file_name"))
    f = F.split("value", FIELD)
    rows = raw.where(F.size(f) >= 6).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("repo_id"), f.alias("f"))
    lines = F.split(F.rtrim(F.col("f")[5]), "\n")
    # The trailing run of numstat lines: everything after the last line that is neither one nor blank.
    last = F.array_max(F.transform(lines, lambda x, i: F.when(~x.rlike(NUMSTAT) & (F.trim(x) != ""), i + 1).otherwise(0)))
    split = rows.withColumns({"lines": lines, "last": last})
    stats = F.filter(F.slice("lines", F.col("last") + 1, F.greatest(F.size("lines") - F.col("last"), F.lit(0))), lambda x: x.rlike(NUMSTAT))
    number = lambda x, g: F.coalesce(F.regexp_extract(x, NUMSTAT, g).try_cast("long"), F.lit(0).cast("long"))
    return split.select(
        "repo_id", F.trim(F.col("f")[0]).alias("sha"), F.col("f")[1].alias("author_name"), F.lower(F.col("f")[2]).alias("author_email"), F.col("f")[3].try_cast("timestamp").alias("committed_at"),
        (F.size(F.filter(F.split(F.trim(F.col("f")[4]), " "), lambda x: x != "")) > 1).alias("is_merge"), F.trim(F.array_join(F.slice("lines", F.lit(1), F.col("last")), "\n")).alias("message"),
        F.transform(stats, lambda x: F.struct(F.regexp_extract(x, NUMSTAT, 3).alias("path"), number(x, 1).alias("added"), number(x, 2).alias("removed"))).alias("files"),
    )


def commit_files(log: DataFrame, most: int = 200) -> DataFrame:
    """(repo_id, sha, path, added, removed): at most `most` paths a commit, in the log's order."""
    return log.select("repo_id", "sha", F.explode(F.slice("files", 1, most)).alias("f")).select("repo_id", "sha", "f.*")


def read_hosting_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repository payloads of a hosting API, exported as JSON lines."""
    schema = "id long, full_name string, description string, fork boolean, archived boolean, stargazers_count long, forks_count long, default_branch string, topics array<string>, license struct<name:string>, pushed_at string, created_at string"
    raw = spark.read.schema(schema).json(path)
    return raw.select("id", "full_name", "description", F.coalesce("fork", F.lit(False)).alias("is_fork"), F.coalesce("archived", F.lit(False)).alias("is_archived"), F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.coalesce("forks_count", F.lit(0)).alias("forks"), "default_branch", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.col("license.name").alias("license"), F.to_timestamp("pushed_at").alias("pushed_at"), F.to_timestamp("created_at").alias("created_at"))


def read_hosting_users(spark: SparkSession, path: str) -> DataFrame:
    """User payloads of a hosting API, exported as JSON lines: who they are and the counts that the API gives. Blank names and addresses are null."""
    schema = "id long, login string, name string, email string, bio string, company string, location string, blog string, avatar_url string, html_url string, public_repos long, followers long, following long, created_at string"
    raw = spark.read.schema(schema).json(path)
    text = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("public_repos", "followers", "following")]
    return raw.select("id", "login", text("name"), F.lower(F.nullif(F.trim("email"), F.lit(""))).alias("email"), *[text(c) for c in ("bio", "company", "location", "blog")], "avatar_url", "html_url", *counts, F.try_to_timestamp("created_at").alias("created_at"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of an export without its pull requests."""
    return spark.read.schema("number long, title string, state string, pull_request struct<url:string>").json(path).where("pull_request is null").drop("pull_request")


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id: the file's name, text) of plain or markdown résumés."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("candidate_id"), F.col("value").alias("text"))


def new_rows(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose (repo_id, path, content_hash) no earlier run has."""
    return now.join(before.select("repo_id", "path", "content_hash"), ["repo_id", "path", "content_hash"], "left_anti")


def sections(texts: DataFrame, headings: str) -> DataFrame:
    """texts (id, text) as lines with the last heading above each: headings is a pattern whose first group names the section."""
    rows = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    head = F.when(F.col("line").rlike(headings), F.lower(F.regexp_extract("line", headings, 1)))
    return rows.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no")), F.lit("intro")))
