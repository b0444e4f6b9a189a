"""Operators over the lines of files."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import normalised_line


def lines_of(files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no from 1, line)."""
    return files.select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("repo_id", "path", (F.col("at") + 1).alias("line_no"), "line")


def line_accounting(lines: DataFrame) -> DataFrame:
    """Blank, comment and code lines of each file, by line shape."""
    blank, comment = F.trim("line") == "", F.col("line").rlike(fixed.COMMENT_LINE)
    return lines.groupBy("repo_id", "path").agg(
        F.count_if(blank).alias("blank_lines"), F.count_if(~blank & comment).alias("comment_lines"), F.count_if(~blank & ~comment).alias("code_lines")
    )


def duplicate_blocks(lines: DataFrame, window: int = 6, min_chars: int = 60, min_line: int = 3) -> DataFrame:
    """(repo_id, path, line_no, block): a hash of each run of `window` meaningful lines of a file that has at least min_chars.

    Rows of a file go to one task, which a file's size bounds."""
    meaningful = lines.withColumn("norm", normalised_line("line")).where(F.length("norm") > min_line)
    run = Window.partitionBy("repo_id", "path").orderBy("line_no").rowsBetween(0, window - 1)
    blocks = meaningful.withColumns({"parts": F.collect_list("norm").over(run), "n": F.count(F.lit(1)).over(run)}).where(F.col("n") == window)
    text = F.array_join("parts", "\n")
    return blocks.where(F.length(text) >= min_chars).select("repo_id", "path", "line_no", F.md5(text.cast("binary")).alias("block"))


def duplication_ratio(lines: DataFrame, window: int = 6, min_chars: int = 60) -> DataFrame:
    """1 - distinct blocks / blocks for each repository."""
    by = duplicate_blocks(lines, window, min_chars).groupBy("repo_id", "block").agg(F.count(F.lit(1)).alias("n"))  # pre-aggregated: a common block is one row a task
    return by.groupBy("repo_id").agg(F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_distinct")).withColumn("ratio", 1 - F.col("n_distinct") / F.col("n_blocks"))


def duplicate_examples(lines: DataFrame, window: int = 6, min_chars: int = 60, most: int = 8) -> DataFrame:
    """For each repository the first `most` blocks that stand in several files, with their first place and how often they occur."""
    first = F.min(F.struct("path", "line_no"))
    by = duplicate_blocks(lines, window, min_chars).groupBy("repo_id", "block").agg(first.alias("at"), F.count(F.lit(1)).alias("n"), F.max("path").alias("last_path"))
    shared = by.where(F.col("last_path") > F.col("at.path"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "at.path", "at.line_no", "block"))
    return shared.withColumn("place", place).where(F.col("place") <= most).select("repo_id", "place", F.col("at.path").alias("path"), F.col("at.line_no").alias("line_no"), "n")


STYLE_KEYS = ["indent_width", "uses_tabs", "avg_length", "comment_ratio", "doc_ratio", "snake_ratio", "camel_ratio", "avg_function_length", "annotation_ratio"]


def style_profile(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines, and found: their entities (repo_id, path, symbol, kind, start_line, end_line, has_doc). One row a file: commonest indentation (the smallest of equals; 4 without
    any), tabs, line lengths, comments, trailing commas, preferred quotes, names in snake or camel case, length, documentation and annotations of functions."""
    indent = F.regexp_extract("line", r"^([ \t]+)", 1)
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p)))
    width = F.when((indent != "") & ~indent.contains("\t"), F.length(indent))
    length = F.when(F.trim("line") != "", F.length("line"))
    widths = lines.select("repo_id", "path", width.alias("w")).where("w > 0").groupBy("repo_id", "path", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("repo_id", "path").agg(F.max_by("w", F.struct("n", (-F.col("w")).alias("less"))).alias("indent_width"))
    annotated = count(r"\)\s*->|:\s*(?:str|int|float|bool|list|dict|[A-Z]\w+)\s*(?:[,)=]|$)")
    by = lines.groupBy("repo_id", "path").agg(
        F.max(F.when(indent.contains("\t"), 1).otherwise(0)).alias("uses_tabs"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"), F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
        F.avg((F.col("line").rlike(fixed.COMMENT_LINE) & (F.trim("line") != "")).cast("int")).alias("comment_ratio"), count("'").alias("single"), count('"').alias("double"),
        F.avg(F.col("line").endswith(",").cast("int")).alias("trailing_comma_ratio"), annotated.alias("annotated"),
    )
    function, size = F.col("kind") != "class", F.col("end_line") - F.col("start_line") + 1
    share = lambda p: F.avg(F.col("symbol").rlike(p).cast("int"))
    names = found.groupBy("repo_id", "path").agg(
        share("^[a-z][a-z0-9_]*$").alias("snake_ratio"), share("^[a-z]+(?:[A-Z][a-z0-9]*)+$").alias("camel_ratio"), F.avg(F.when(function, size)).alias("avg_function_length"),
        F.avg(F.when(function, F.col("has_doc").cast("int"))).alias("doc_ratio"), F.count_if(function).alias("functions"),
    )
    wide = by.join(widths, ["repo_id", "path"], "left").join(names, ["repo_id", "path"], "left").fillna(0, ["snake_ratio", "camel_ratio", "avg_function_length", "doc_ratio", "functions"]).fillna(4, ["indent_width"])
    quotes = F.when(F.col("single") > F.col("double") * 1.5, "single").when(F.col("double") > F.col("single") * 1.5, "double").otherwise("mixed")
    return wide.withColumns({"quote_preference": quotes, "annotation_ratio": F.when(F.col("functions") > 0, F.least(F.lit(1.0), F.col("annotated") / F.col("functions"))).otherwise(0.0)}).drop("single", "double", "annotated", "functions")


def style_discontinuity(profiles: DataFrame, keys: list[str], least_files: int = 3, outlier: float = 1.5) -> DataFrame:
    """profiles (repo_id, path, keys): how far each file is from its repository's median in standard deviations, on average over keys;
    share of files beyond `outlier`, doubled and at most 1. Null with fewer than least_files files."""
    long = profiles.select("repo_id", "path", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys])).alias("kv")).select("repo_id", "path", "kv.key", "kv.v")
    centre = long.groupBy("repo_id", "key").agg(F.median("v").alias("middle"), F.stddev_pop("v").alias("spread"))
    away = long.join(centre, ["repo_id", "key"]).withColumn("z", F.abs(F.col("v") - F.col("middle")) / F.when(F.col("spread") > 1e-9, F.col("spread")).otherwise(1.0))
    files = away.groupBy("repo_id", "path").agg(F.avg("z").alias("z"))
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("z") > outlier).alias("n_outliers")).withColumn(
        "discontinuity", F.when(F.col("n_files") >= least_files, F.least(F.lit(1.0), 2.0 * F.col("n_outliers") / F.col("n_files")))
    )
