"""Scores of code quality, testing, architecture and security hygiene, each with the measures that it weighs: one row a repository."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, scale, test_cases
from . import classify, graph, lines, security, structure


def weighed(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return clamp(reduce(lambda a, b: a + b, [w * parts[k] for k, w in weights.items()]))


def _any(column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(column.contains(m), F.lit(False)) for m in markers])


def code_metrics(files: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """files with category and language, rows: their lines, found: their entities. Counts, means and shares that code_quality() weighs. Functions are
    entities that aren't classes; a repository without entities has null measures."""
    size = F.col("end_line") - F.col("start_line") + 1
    profiled = found.join(structure.entity_complexity(found, rows).select("repo_id", "path", "start_line", "complexity"), ["repo_id", "path", "start_line"]).join(structure.entity_nesting(found, rows).select("repo_id", "path", "start_line", "nesting"), ["repo_id", "path", "start_line"], "left")
    function = F.col("kind") != "class"
    of = lambda c: F.when(function, c)
    by = profiled.groupBy("repo_id").agg(
        F.count_if(function).alias("functions"), F.count_if(~function).alias("classes"), F.avg(of(F.col("complexity"))).alias("avg_complexity"), F.max(of(F.col("complexity"))).alias("max_complexity"),
        F.count_if(function & (F.col("complexity") > 15)).alias("high_complexity"), F.avg(of(size)).alias("avg_lines"), F.count_if(function & (size > 80)).alias("long_functions"),
        F.max("nesting").alias("max_nesting"), F.count_if(function & F.col("has_doc")).alias("documented"),
        F.count_if(function & (size <= 4) & (F.col("complexity") == 1)).alias("trivial"), F.count_if(function & (size <= 4) & (F.col("complexity") == 1) & F.col("has_doc")).alias("trivial_documented"),
    )
    accounts = lines.line_accounting(rows)
    long = F.col("blank_lines") + F.col("comment_lines") + F.col("code_lines") > 600
    totals = accounts.groupBy("repo_id").agg(F.sum("comment_lines").alias("comment_lines"), F.sum("code_lines").alias("code_lines"), F.count_if(long).alias("large_files"), F.count(F.lit(1)).alias("n_files"))
    parsed = files.groupBy("repo_id").agg(F.avg(F.coalesce(F.col("language").isin(fixed.PARSED), F.lit(False)).cast("int")).alias("parsed_share"))
    handling = files.groupBy("repo_id").agg(F.sum(F.regexp_count("text", F.lit(r"\b(try|catch|except|rescue|recover|finally)\b"))).alias("handlers"), F.sum(F.regexp_count("text", F.lit(fixed.STRUCTURED_DOC))).alias("structured_docs"))
    wide = totals
    for part in (by, lines.duplication_ratio(rows).select("repo_id", F.col("ratio").alias("duplication")), structure.naming_quality(found).select("repo_id", F.col("share").alias("naming")), parsed, handling):
        wide = wide.join(part, "repo_id", "left")
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return wide.withColumns({
        "duplication": F.coalesce("duplication", F.lit(0.0)), "high_complexity_ratio": share("high_complexity", "functions"), "long_ratio": share("long_functions", "functions"),
        "documented_ratio": share("documented", "functions"), "comment_ratio": F.col("comment_lines") / F.greatest(F.lit(1), F.col("code_lines") + F.col("comment_lines")),
        "handling": F.when(F.col("functions") > 0, F.col("handlers") / F.col("functions")).otherwise(0.0), "large_ratio": share("large_files", "n_files"),
    })


def comment_score(ratio: Column) -> Column:
    """Too few comments 35, up to 100 from 2 to 6 %, 100 to 35 %, less towards 60 %, then 60."""
    return F.when(ratio < 0.02, 35.0).when(ratio < 0.06, 35.0 + 65.0 * (ratio - 0.02) / 0.04).when(ratio <= 0.35, 100.0).when(ratio <= 0.60, 100.0 - 30.0 * (ratio - 0.35) / 0.25).otherwise(60.0)


def code_quality(metrics: DataFrame) -> DataFrame:
    """metrics as of code_metrics(): (repo_id, score, confidence); a null score where there are no entities."""
    c = F.col
    parts = {
        "complexity": 0.6 * scale(F.coalesce("avg_complexity", F.lit(1.0)), 12.0, 3.0) + 0.4 * scale("high_complexity_ratio", 0.25, 0.0),
        "function_size": 0.6 * scale(F.coalesce("avg_lines", F.lit(1.0)), 90.0, 20.0) + 0.4 * scale("long_ratio", 0.30, 0.0),
        "nesting": scale(F.coalesce("max_nesting", F.lit(0)), 8.0, 3.0), "duplication": scale("duplication", 0.25, 0.02), "naming": scale(F.coalesce("naming", F.lit(1.0)), 0.5, 0.9),
        "comments": comment_score(c("comment_ratio")), "error_handling": scale(F.least(c("handling"), F.lit(0.12)), 0.0, 0.12), "modularity": clamp(100.0 - c("large_ratio") * 180.0),
    }
    has = F.coalesce(c("functions") + c("classes"), F.lit(0)) > 0
    return metrics.select("repo_id", F.when(has, weighed(parts, fixed.QUALITY_WEIGHTS)).alias("score"), F.when(has, clamp(0.5 + 0.5 * F.coalesce("parsed_share", F.lit(0.0)), 0.0, 1.0)).otherwise(0.2).alias("confidence"))


def test_frameworks(files: DataFrame) -> DataFrame:
    """(repo_id, framework, n): markers of test frameworks in test files."""
    count = lambda m: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(m)))) / len(m)
    found = F.array(*[F.struct(F.lit(name).alias("framework"), reduce(lambda a, b: a + b, map(count, marks)).cast("long").alias("n")) for name, marks in fixed.TEST_FRAMEWORKS.items()])
    hits = files.where("category = 'test_code' and text is not null").select("repo_id", F.explode(F.filter(found, lambda x: x.n > 0)).alias("f"))
    return hits.groupBy("repo_id", F.col("f.framework").alias("framework")).agg(F.sum("f.n").alias("n"))


def testing_metrics(files: DataFrame) -> DataFrame:
    """files with category: one row a repository with counts of tests and lines, kinds of tests, CI and coverage."""
    test, source = F.col("category") == "test_code", F.col("category") == "candidate_code"
    path, text = F.lower("path"), F.coalesce("text", F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    ci = F.col("path").startswith(".github/workflows/") | F.col("path").isin(fixed.CI_FILES)
    settings = F.col("path").rlike("(toml|cfg|ini|json)$")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    wide = files.groupBy("repo_id").agg(
        F.count_if(test).alias("test_files"), F.count_if(source).alias("source_files"), F.coalesce(F.sum(F.when(test, test_cases(text))), F.lit(0)).alias("test_cases"),
        F.coalesce(F.sum(F.when(test, breaks)), F.lit(0)).alias("test_lines"), F.coalesce(F.sum(F.when(source, breaks)), F.lit(0)).alias("source_lines"),
        some(test & path.rlike(fixed.INTEGRATION_HINTS)).alias("has_integration"), some(test & (path.rlike(fixed.E2E_HINTS) | _any(text, fixed.TEST_FRAMEWORKS["playwright"] + fixed.TEST_FRAMEWORKS["cypress"]))).alias("has_e2e"),
        some(ci).alias("has_ci"), some(ci & _any(text, fixed.CI_TEST_MARKERS)).alias("ci_runs_tests"), some(_any(F.col("path"), fixed.COVERAGE_FILES) | ((ci | settings) & _any(text, fixed.COVERAGE_MARKERS))).alias("coverage_tracked"),
    )
    return wide.withColumns({"has_unit": F.col("test_cases") > 0, "ratio": F.when(F.col("source_lines") > 0, F.col("test_lines") / F.col("source_lines")).otherwise(0.0)})


def testing_score(metrics: DataFrame) -> DataFrame:
    """metrics as of testing_metrics(): (repo_id, score, confidence)."""
    c = F.col
    parts = {
        "presence": F.when(c("test_cases") > 0, 100.0).when(c("test_files") > 0, 40.0).otherwise(0.0), "volume": scale(F.least(c("ratio"), F.lit(0.6)), 0.0, 0.35),
        "breadth": 100 * (F.when(c("has_unit"), 0.45).otherwise(0.0) + F.when(c("has_integration"), 0.35).otherwise(0.0) + F.when(c("has_e2e"), 0.20).otherwise(0.0)),
        "ci": F.when(c("ci_runs_tests"), 100.0).when(c("has_ci"), 45.0).otherwise(0.0), "coverage_tracking": F.when(c("coverage_tracked"), 100.0).otherwise(0.0),
    }
    return metrics.select("repo_id", weighed(parts, fixed.TESTING_WEIGHTS).alias("score"), F.when(c("source_files") > 0, 0.9).otherwise(0.5).alias("confidence"))


def architecture_metrics(files: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """files with category, edges (repo_id, src, dst), cycles (repo_id, one row each or repeated): layers, depth, root files, fan-out, cycles, entry points."""
    source = files.where(F.col("category").isin("candidate_code", "test_code"))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))
    by = source.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.avg(depth).alias("avg_depth"), F.max(depth).alias("max_depth"), F.avg((depth == 0).cast("int")).alias("root_ratio"))
    core = structure.layers(source).where(~F.col("layer").isin("tests", "shared")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("core_layers"))
    entry = files.groupBy("repo_id").agg(F.bool_or(F.element_at(F.split("path", "/"), -1).isin(fixed.ENTRY_NAMES) | F.col("path").isin(fixed.ENTRY_PATHS)).alias("entry"))
    out = edges.select("repo_id", "src", "dst").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_edges"))
    loops = cycles.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_cycles"))
    wide = entry
    for part in (by, core, out, loops):
        wide = wide.join(part, "repo_id", "left")
    return wide.fillna(0, ["n_files", "avg_depth", "max_depth", "root_ratio", "core_layers", "n_edges", "n_cycles"]).withColumn("fan_out", F.col("n_edges") / F.greatest(F.lit(1), F.col("n_files")))


def architecture_score(metrics: DataFrame) -> DataFrame:
    """metrics as of architecture_metrics(): (repo_id, score, confidence)."""
    c = F.col
    parts = {
        "layering": scale("core_layers", 0.0, 4.0), "modularity": F.when(c("n_files") > 3, scale("root_ratio", 0.9, 0.15)).otherwise(55.0),
        "coupling": clamp(100.0 - 12.0 * F.greatest(F.lit(0.0), c("fan_out") - 4.0) - 10.0 * c("n_cycles")), "structure_depth": F.when(c("max_depth") > 0, scale("avg_depth", 0.0, 2.0)).otherwise(20.0),
        "entry_points": F.when(c("entry"), 100.0).otherwise(40.0),
    }
    return metrics.select("repo_id", weighed(parts, fixed.ARCHITECTURE_WEIGHTS).alias("score"), F.when(c("n_files") > 0, 0.75).otherwise(0.35).alias("confidence"))


def security_metrics(files: DataFrame, secrets: DataFrame, patterns: DataFrame) -> DataFrame:
    """files with text, secrets as of security.dedupe_findings(), patterns as of security.scan_patterns(): penalties, committed environment files, hygiene."""
    lost = reduce(lambda out, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(out), fixed.PENALTIES.items(), F.lit(0.0)) * security.confidence_weight()
    both = secrets.select("repo_id", "severity", "confidence", F.lit("secret").alias("kind")).unionByName(patterns.select("repo_id", "severity", "confidence", F.lit("pattern").alias("kind")))
    counts = both.groupBy("repo_id").agg(F.sum(lost).alias("penalty"), F.count_if(F.col("kind") == "secret").alias("secret_findings"), F.count_if(F.col("kind") == "pattern").alias("pattern_findings"))
    name, path = F.element_at(F.split("path", "/"), -1), F.col("path")
    ends = reduce(lambda a, b: a | b, [path.endswith(x) for x in fixed.ENV_EXAMPLES])
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    by = files.groupBy("repo_id").agg(
        F.count_if(name.isin(fixed.ENV_FILES)).alias("env_files"), some((path == ".gitignore") & F.col("text").contains(".env")).alias("ignores_env"), some(ends).alias("env_example"),
        some(F.upper("path").startswith("SECURITY")).alias("policy"), some(classify.is_lock_file("path")).alias("locked"), F.count_if(F.col("text").isNotNull()).alias("n_texts"),
    )
    return by.join(counts, "repo_id", "left").fillna(0, ["penalty", "secret_findings", "pattern_findings"])


def security_score(metrics: DataFrame) -> DataFrame:
    """100 less the findings' penalties and 25 for each committed environment file, plus 6, 4, 3 and 3 for hygiene."""
    c = F.col
    bonus = reduce(lambda a, b: a + b, [F.when(c(k), w).otherwise(0.0) for k, w in (("ignores_env", 6.0), ("env_example", 4.0), ("policy", 3.0), ("locked", 3.0))])
    return metrics.select("repo_id", clamp(100.0 - c("penalty") - 25.0 * c("env_files") + bonus).alias("score"), F.when(c("n_texts") > 0, 0.8).otherwise(0.2).alias("confidence"))


def imports(files: DataFrame) -> DataFrame:
    """files with language: (repo_id, path, target), see graph.import_targets()."""
    return graph.import_targets(files)
