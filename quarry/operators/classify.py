"""Paths to language, category and ignore reason: one projection, no shuffle."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import col, line_count
from ..tables import running


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path) -> Column:
    """Lower-case extension without the dot; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(F.lower(base_name(path)), r"^.+\.([^.]+)$", 1)


def ignore_reason(path) -> Column:
    """Why a path is ignored, or null."""
    parts = F.split(col(path), "/")
    first = F.try_element_at(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(fixed.IGNORED_DIRECTORIES)), F.lit(1))
    name = base_name(path)
    return (
        F.when(first.isNotNull(), F.concat(F.lit("inside ignored directory '"), first, F.lit("'")))
        .when(name.isin(fixed.IGNORED_DIRECTORIES), F.concat(F.lit("ignored directory '"), name, F.lit("'")))
        .when(suffix(path).isin(fixed.BINARY_SUFFIXES), F.concat(F.lit("binary extension '."), suffix(path), F.lit("'")))
        .when(name.endswith(".min.js") | name.endswith(".min.css") | name.endswith(".map"), "minified or source-map artefact")
    )


def language(path, first_line=None) -> Column:
    name = F.lower(base_name(path))
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_name = F.when(name.startswith("dockerfile"), "dockerfile").otherwise(F.try_element_at(pairs(fixed.FILE_NAMES), name))
    out = F.coalesce(by_name, F.try_element_at(pairs(fixed.EXTENSIONS), suffix(path)))
    if first_line is not None:
        called = F.regexp_extract(F.coalesce(col(first_line), F.lit("")), fixed.SHEBANG, 1)
        out = F.coalesce(out, F.when(called.startswith("python"), "python").when(called == "node", "javascript").when(called.isin("bash", "sh"), "bash").when(called != "", called))
    return out


def is_lock_file(path) -> Column:
    return F.lower(base_name(path)).isin(fixed.LOCK_FILES)


def is_manifest(path) -> Column:
    return base_name(path).isin(fixed.MANIFESTS)


def is_test_path(path) -> Column:
    return col(path).rlike(fixed.TEST_PATH)


def is_generated(path, head=None) -> Column:
    by_path = col(path).rlike(fixed.GENERATED_PATH)
    return by_path if head is None else by_path | F.coalesce(F.substring(col(head), 1, 800).rlike(fixed.GENERATED_BANNER), F.lit(False))


def category(path, head=None, lang=None) -> Column:
    """The category of a file; the first rule that holds decides."""
    lang = language(path) if lang is None else col(lang)
    name = F.lower(base_name(path))
    stem = F.regexp_replace(name, r"(.)\.[^.]+$", "$1")
    isin = lambda names: F.coalesce(lang.isin(names), F.lit(False))
    return (
        F.when(ignore_reason(path).isNotNull(), "ignored")
        .when(is_lock_file(path), "dependency_code")
        .when(is_generated(path, head), "generated_code")
        .when(is_test_path(path) & isin(fixed.PROGRAMMING), "test_code")
        .when(is_manifest(path) | name.isin(fixed.CONFIG_NAMES), "configuration")
        .when(stem.isin(fixed.DOC_NAMES) | isin(fixed.DOCS), "documentation")
        .when(isin(fixed.PROGRAMMING) | isin(fixed.MARKUP), "candidate_code")
        .when(isin(fixed.DATA) | isin(fixed.BUILD), "configuration")
        .otherwise("asset")
    )


def classified(files: DataFrame) -> DataFrame:
    """files (repo_id, path, text, size_bytes) with language, category, skipped_reason, line_count and content_hash."""
    first = F.element_at(F.split("text", "\n"), 1)
    out = files.withColumns({"language": language("path", first), "skipped_reason": ignore_reason("path"), "line_count": F.coalesce(line_count("text"), F.lit(0)), "content_hash": F.sha2("text", 256)})
    return out.withColumn("category", category("path", "text", "language"))


def scan_summary(files: DataFrame) -> DataFrame:
    """Files and bytes by repository and category."""
    return files.groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def within_budget(files: DataFrame, max_files: int = 12_000, max_bytes: int = 1 << 20, max_total: int = 256 << 20) -> DataFrame:
    """Files small enough, by path; `kept` tells which are within the repository's budget of files and of bytes together, `exceeded` that the file is the first beyond its bytes or follows it."""
    laid = running(files.where(F.col("size_bytes") <= max_bytes), "repo_id", ["path"], F.col("size_bytes"))
    beyond = F.col("before") + F.col("size_bytes") > max_total
    return laid.withColumns({"exceeded": beyond, "kept": (F.col("place") < max_files) & ~beyond}).drop("place", "before")


def language_share(files: DataFrame) -> DataFrame:
    """Share of bytes by language over each repository's source files; an empty file counts one byte."""
    by = files.where(F.col("category").isin("candidate_code", "test_code")).groupBy("repo_id", "language").agg(F.sum(F.greatest(F.lit(1), F.col("size_bytes"))).alias("n_bytes"))
    return by.withColumn("share", F.col("n_bytes") / F.sum("n_bytes").over(Window.partitionBy("repo_id")))
