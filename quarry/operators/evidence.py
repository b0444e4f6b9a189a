"""Evidence rows, category scores, recommendations, limits and summaries: what a report is put together from."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAIN_TARGET = 85.0
MOST_SKILL_GAPS = 4
MOST_DETAILS = 8


def evidence_id(*parts) -> Column:
    """ev_ and the first 16 hex digits of the sha256 of the parts as JSON: equal evidence has one id in any run."""
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16))


def category_scores(results: DataFrame, categories: dict[str, str], first: float = 0.65) -> DataFrame:
    """results (repo_id, analyzer, score, confidence): (repo_id, category, score, confidence, available). categories: analyzer to category, in order. Where two analyzers
    feed one category the earlier counts `first` and the later the rest, with the lesser confidence; if only one has a score, that one counts alone."""
    order = {name: i for i, name in enumerate(categories)}
    table = F.broadcast(results.sparkSession.createDataFrame([(k, v, order[k]) for k, v in categories.items()], "analyzer string, category string, at int"))
    joined = results.join(table, "analyzer").withColumn("there", F.col("score").isNotNull())
    place = F.row_number().over(Window.partitionBy("repo_id", "category").orderBy(F.desc("there"), "at"))
    ranked = joined.withColumn("place", place).where((F.col("place") == 1) | F.col("there"))
    n = F.count_if("there")
    one, two = F.max(F.when(F.col("place") == 1, F.col("score"))), F.max(F.when(F.col("place") == 2, F.col("score")))
    surest = F.max(F.when(F.col("place") == 1, F.col("confidence")))
    by = ranked.where("place <= 2").groupBy("repo_id", "category").agg(one.alias("one"), two.alias("two"), n.alias("n"), F.min("confidence").alias("least"), surest.alias("own"))
    return by.select("repo_id", "category", F.when(F.col("n") == 2, F.col("one") * first + F.col("two") * (1 - first)).otherwise(F.col("one")).alias("score"), F.when(F.col("n") == 2, F.col("least")).otherwise(F.col("own")).alias("confidence"), (F.col("n") > 0).alias("available"))


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# Fixed values: (category, condition, title, impact, effort), over a row a repository of measures; see recommendations().
RULES = [
    ("testing", lambda: _n("test_cases") == 0, "Add a first automated test suite", "high", "medium"),
    ("testing", lambda: (_n("test_cases") > 0) & ~F.coalesce("has_integration", F.lit(False)), "Add integration tests across module boundaries", "medium", "medium"),
    ("testing", lambda: ~F.coalesce("ci_runs_tests", F.lit(False)), "Run the test suite in CI", "medium", "low"),
    ("documentation", lambda: _n("readme_words") < 150, "Expand the README into something a stranger can follow", "high", "low"),
    ("documentation", lambda: ~F.coalesce("shows_architecture", F.lit(False)), "Document the architecture and the decisions behind it", "medium", "low"),
    ("technical_quality", lambda: _n("high_complexity") > 0, "Break up the most complex functions", "medium", "medium"),
    ("technical_quality", lambda: _n("duplication") > 0.12, "Remove duplicated blocks", "medium", "medium"),
    ("technical_quality", lambda: _n("handling") < 0.02, "Handle failure paths explicitly", "medium", "medium"),
    ("security", lambda: _n("secret_findings") > 0, "Remove hardcoded credentials and rotate them", "high", "low"),
    ("security", lambda: _n("pattern_findings") > 0, "Address the flagged insecure patterns", "high", "medium"),
    ("architecture", lambda: _n("core_layers") == 0, "Introduce a clear module structure", "medium", "high"),
    ("architecture", lambda: _n("n_cycles") > 0, "Break the circular imports", "medium", "medium"),
    ("architecture", lambda: ~F.coalesce("locked", F.lit(False)), "Commit a dependency lock file", "low", "low"),
    ("git_engineering", lambda: _n("low_effort") > 0.3, "Write commit messages that describe intent", "medium", "low"),
    ("git_engineering", lambda: _n("commit_count") <= 3, "Develop in visible increments", "high", "low"),
    ("ownership", lambda: F.coalesce("ownership", F.lit(100.0)) < 60, "Strengthen the evidence that this is your work", "high", "medium"),
]


def recommendations(measures: DataFrame, scores: DataFrame, weights: DataFrame, gaps: DataFrame, most: int = 12) -> DataFrame:
    """measures: a row a repository with the columns that RULES read; scores (repo_id, category, score); weights (category, weight); gaps (repo_id, skill): missing skills,
    of which the first four by name count. (repo_id, place, category, title, impact, effort, gain), by impact, then gain, then title; at most `most`.

    gain is what the overall score would move if the category came to 85; null where the category has no score or no weight."""
    rows = F.array_compact(F.array(*[F.when(cond(), F.struct(F.lit(c).alias("category"), F.lit(title).alias("title"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"))) for c, cond, title, impact, effort in RULES]))
    ruled = measures.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*", F.lit(1).alias("shared_by"))
    ordered = Window.partitionBy("repo_id").orderBy("skill")
    named = gaps.select("repo_id", "skill").distinct().withColumns({"at": F.row_number().over(ordered), "shared_by": F.count(F.lit(1)).over(Window.partitionBy("repo_id"))}).where(F.col("at") <= MOST_SKILL_GAPS)
    skill = named.select("repo_id", F.lit("job_relevance").alias("category"), F.concat(F.lit("Build something that demonstrates "), "skill").alias("title"), F.lit("high").alias("impact"), F.lit("high").alias("effort"), F.col("shared_by").cast("int"))
    every = ruled.unionByName(skill).join(scores.select("repo_id", "category", "score"), ["repo_id", "category"], "left").join(F.broadcast(weights), "category", "left")
    gain = F.when(F.col("score").isNotNull() & (F.coalesce("weight", F.lit(0.0)) > 0), F.greatest(F.lit(0.0), GAIN_TARGET - F.col("score")) * F.col("weight") / F.col("shared_by"))
    rank = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(rank, F.desc(F.coalesce("gain", F.lit(0.0))), "title"))
    return every.withColumn("gain", gain).withColumn("place", place).where(F.col("place") <= most).select("repo_id", "place", "category", "title", "impact", "effort", "gain")


def distinct_recommendations(rows: DataFrame, owners: DataFrame, most: int | None = None) -> DataFrame:
    """rows (repo_id, title, gain, impact, category), owners (repo_id, owner_id): of equal (repository, title) the one of largest gain; with most, the first of each owner."""
    best = rows.groupBy("repo_id", "title").agg(F.max_by(F.struct("category", "impact", "gain"), F.coalesce("gain", F.lit(-1.0))).alias("b")).select("repo_id", "title", "b.*").join(owners, "repo_id")
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc_nulls_last("gain"), "repo_id", "title"))
    ranked = best.withColumn("place", place)
    return ranked if most is None else ranked.where(F.col("place") <= most)


# (analyzer, category, tag, condition, claim, severity, supports, confidence) over the same rows.
CLAIMS = [
    ("code_metrics", "technical_quality", "complexity", lambda: _n("high_complexity") > 0, lambda: F.format_string("%d function(s) exceed a cyclomatic complexity of 15", _n("high_complexity").cast("int")), "medium", "weakness", 0.85),
    ("code_metrics", "technical_quality", "complexity", lambda: (_n("high_complexity") == 0) & (_n("functions") > 0), lambda: F.format_string("No function of %d exceeds a cyclomatic complexity of 15", _n("functions").cast("int")), "info", "strength", 0.85),
    ("code_metrics", "technical_quality", "duplication", lambda: _n("duplication") > 0.12, lambda: F.format_string("%.0f%% of code blocks are duplicated", _n("duplication") * 100.0), "medium", "weakness", 0.8),
    ("testing", "testing", "tests", lambda: _n("test_cases") > 0, lambda: F.format_string("%d test case(s) in %d file(s)", _n("test_cases").cast("int"), _n("test_files").cast("int")), "info", "strength", 0.9),
    ("testing", "testing", "tests", lambda: _n("test_cases") == 0, lambda: F.lit("No test cases were detected"), "medium", "weakness", 0.9),
    ("testing", "testing", "ci", lambda: F.coalesce("ci_runs_tests", F.lit(False)), lambda: F.lit("Continuous integration runs the tests"), "info", "strength", 0.9),
    ("documentation", "documentation", "readme", lambda: _n("readme_words") >= 150, lambda: F.format_string("The README has %d words and %d sections", _n("readme_words").cast("int"), _n("readme_features").cast("int")), "info", "strength", 0.85),
    ("documentation", "documentation", "readme", lambda: _n("readme_words") < 150, lambda: F.format_string("The README has %d words", _n("readme_words").cast("int")), "low", "weakness", 0.85),
    ("security", "security", "secrets", lambda: _n("secret_findings") > 0, lambda: F.format_string("%d credential-shaped value(s) in files", _n("secret_findings").cast("int")), "critical", "weakness", 0.8),
    ("security", "security", "env", lambda: _n("env_files") > 0, lambda: F.format_string("%d environment file(s) are committed", _n("env_files").cast("int")), "critical", "weakness", 0.95),
    ("security", "security", "patterns", lambda: _n("pattern_findings") > 0, lambda: F.format_string("%d insecure pattern(s) were flagged", _n("pattern_findings").cast("int")), "high", "weakness", 0.7),
    ("architecture", "architecture", "layers", lambda: _n("core_layers") > 0, lambda: F.format_string("%d layer(s) are told apart by folders", _n("core_layers").cast("int")), "info", "strength", 0.75),
    ("architecture", "architecture", "cycles", lambda: _n("n_cycles") > 0, lambda: F.format_string("%d circular import(s)", _n("n_cycles").cast("int")), "medium", "weakness", 0.75),
    ("git_history", "git_engineering", "history", lambda: _n("commit_count") >= 20, lambda: F.format_string("%d commits on %d days", _n("commit_count").cast("int"), _n("active_days").cast("int")), "info", "strength", 0.9),
    ("git_history", "git_engineering", "history", lambda: _n("commit_count") <= 3, lambda: F.format_string("Only %d commit(s) of history", _n("commit_count").cast("int")), "medium", "weakness", 0.9),
    ("git_history", "git_engineering", "messages", lambda: _n("low_effort") > 0.3, lambda: F.format_string("%.0f%% of commit messages say nothing", _n("low_effort") * 100.0), "low", "weakness", 0.85),
]


def evidence_rows(measures: DataFrame) -> DataFrame:
    """measures: a row a repository, as for recommendations(). (evidence_id, repo_id, analyzer, category, tag, claim, severity, supports, confidence), a row for each claim that holds."""
    rows = F.array_compact(F.array(*[F.when(cond(), F.struct(F.lit(a).alias("analyzer"), F.lit(c).alias("category"), F.lit(tag).alias("tag"), claim().alias("claim"), F.lit(s).alias("severity"), F.lit(sup).alias("supports"), F.lit(conf).alias("confidence"))) for a, c, tag, cond, claim, s, sup, conf in CLAIMS]))
    said = measures.select("repo_id", F.explode(rows).alias("e")).select("repo_id", "e.*")
    return said.withColumn("evidence_id", evidence_id("repo_id", "analyzer", "claim"))


def union_evidence(*parts: DataFrame) -> DataFrame:
    """Evidence of several analyzers, each id once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates(["evidence_id"])


def top_evidence(evidence: DataFrame, weights: dict[str, float], most: int = MOST_DETAILS) -> DataFrame:
    """The `most` rows of each repository by confidence times the weight of their category; ties by id. Categories without weight count 1."""
    w = reduce(lambda out, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(out), weights.items(), F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc(F.col("confidence") * w), "evidence_id"))
    return evidence.withColumn("place", place).where(F.col("place") <= most)


def limitations(results: DataFrame, failures: DataFrame) -> DataFrame:
    """results (repo_id, analyzer, score), failures (repo_id, analyzer, reason): (repo_id, analyzer, reason) of what couldn't be measured: a failure's own reason first, else that
    there was nothing to measure."""
    empty = results.where("score is null").select("repo_id", "analyzer", F.lit("nothing to measure").alias("given"))
    both = empty.join(failures, ["repo_id", "analyzer"], "full")
    return both.select("repo_id", "analyzer", F.coalesce("reason", "given").alias("reason")).distinct()


def with_failures(scores: DataFrame, failures: DataFrame, categories: dict[str, str]) -> DataFrame:
    """category scores with reason: a category whose analyzer failed has no score, whatever was measured beside it."""
    table = F.broadcast(scores.sparkSession.createDataFrame(list(categories.items()), "analyzer string, category string"))
    lost = failures.join(table, "analyzer").groupBy("repo_id", "category").agg(F.min("reason").alias("reason"))
    joined = scores.join(lost, ["repo_id", "category"], "left")
    return joined.withColumns({"score": F.when(F.col("reason").isNull(), F.col("score")), "available": F.col("available") & F.col("reason").isNull()})


def narrative(overall: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """overall (repo_id, score, status, reasons), scores (repo_id, category, score), evidence (repo_id, claim, supports, confidence): (repo_id, summary): the overall score, the two best categories, three
    strengths, three gaps, and the first reason of the status. The same rows give the same text."""
    best = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("score"), "category"))
    ordered = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x.said), ", ")
    top = scores.where("score is not null").withColumn("place", best).where("place <= 2").groupBy("repo_id").agg(ordered("place", F.format_string("%s (%.0f)", F.replace(F.col("category"), F.lit("_"), F.lit(" ")), "score").alias("said")).alias("top"))
    place = F.row_number().over(Window.partitionBy("repo_id", "supports").orderBy(F.desc("confidence"), "claim"))
    few = evidence.where("supports in ('strength', 'weakness')").withColumn("place", place).where("place <= 3")
    lists = few.groupBy("repo_id").pivot("supports", ["strength", "weakness"]).agg(ordered("place", F.col("claim").alias("said")))
    wide = overall.join(top, "repo_id", "left").join(lists, "repo_id", "left")
    parts = [
        F.when(F.col("score").isNull(), "No overall score could be computed.").otherwise(F.format_string("Overall score %.0f of 100.", "score")), F.concat(F.lit("Best: "), "top", F.lit(".")), F.concat(F.lit("Strengths: "), "strength", F.lit(".")),
        F.concat(F.lit("Gaps: "), "weakness", F.lit(".")), F.when(F.col("status") != "CLEAR", F.concat(F.col("status"), F.lit(": "), F.element_at(F.split("reasons", "; "), 1), F.lit("."))),
    ]
    return wide.select("repo_id", F.concat_ws(" ", *parts).alias("summary"))
