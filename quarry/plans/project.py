"""Measures of whole repositories, put together from the domain tables: what the registered queries of scores, signals and evidence start from."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import classify, dependencies, graph, history, lines, measures, ownership, security, skills, structure
from ..tables import written

Tables = Callable[[str], DataFrame]


def once(build):
    """build(t), written the first time that one query asks for it and read from there afterwards: measures of a repository are read by many others."""

    @wraps(build)
    def get(t: Tables) -> DataFrame:
        held = t.__dict__.setdefault("held", {})
        if build.__name__ not in held:
            held[build.__name__] = written(build(t))
        return held[build.__name__]

    return get


@once
def code(t: Tables) -> DataFrame:
    return t("code")


@once
def rows(t: Tables) -> DataFrame:
    return lines.lines_of(code(t))


@once
def files(t: Tables) -> DataFrame:
    return classify.classified(code(t).withColumn("size_bytes", F.length("text").cast("long")))


@once
def found(t: Tables) -> DataFrame:
    return structure.parsed_entities(files(t), rows(t))


@once
def code_metrics(t: Tables) -> DataFrame:
    return measures.code_metrics(files(t), rows(t), found(t))


@once
def edges(t: Tables) -> DataFrame:
    own = files(t)
    return graph.import_edges(graph.import_targets(own), own.where(F.col("category").isin("candidate_code", "test_code")))


@once
def architecture_metrics(t: Tables) -> DataFrame:
    links = edges(t)
    return measures.architecture_metrics(files(t), links, graph.short_cycles(links))


@once
def secrets(t: Tables) -> DataFrame:
    return security.dedupe_findings(security.scan_secrets(rows(t)))


@once
def patterns(t: Tables) -> DataFrame:
    return security.scan_patterns(rows(t), files(t))


@once
def security_metrics(t: Tables) -> DataFrame:
    return measures.security_metrics(files(t), secrets(t), patterns(t))


def locks(t: Tables) -> DataFrame:
    return code(t).where(classify.is_lock_file("path"))


@once
def documentation(t: Tables) -> DataFrame:
    documented = code_metrics(t).select("repo_id", F.col("documented_ratio").alias("documented"))
    docs = code(t).where(F.col("path").startswith("docs/")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return structure.documentation_score(code(t).select("repo_id").distinct(), structure.readmes(code(t)), documented.join(docs, "repo_id", "left"))


def readme_facts(t: Tables) -> DataFrame:
    return structure.readme_facts(structure.readmes(code(t)))


@once
def facts(t: Tables) -> DataFrame:
    """A row a repository with what signals and factors read."""
    own, entities = files(t), found(t)
    clones = structure.clone_groups(entities, rows(t)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("clone_groups"))
    profiled = entities.join(structure.entity_complexity(entities, rows(t)).select("repo_id", "path", "start_line", "complexity"), ["repo_id", "path", "start_line"])
    style = lines.style_discontinuity(lines.style_profile(rows(t), entities), lines.STYLE_KEYS).select("repo_id", F.coalesce("discontinuity", F.lit(0.0)).alias("discontinuity"))
    metrics = code_metrics(t).select("repo_id", "functions", "documented_ratio", "trivial", "trivial_documented", "structured_docs", "duplication", "handling", "high_complexity")
    tests = measures.testing_metrics(own).select("repo_id", "test_cases", "test_files", F.col("source_files"), "has_integration", "ci_runs_tests")
    architecture = architecture_metrics(t)
    score = lambda df, name: df.select("repo_id", F.col("score").alias(name))
    wide = own.select("repo_id").distinct()
    for part in (
        history.history_signals(t("code_commits"), t("emails")), style, metrics, clones, tests, readme_facts(t).drop("path"), structure.own_references(own), ownership.complexity_variation(profiled),
        structure.assistant_artifacts(own).select("repo_id", F.col("strength").alias("artifacts")), history.rework(t("code_commit_files")).select("repo_id", F.col("share").alias("rework")),
        architecture.select("repo_id", "n_cycles", "core_layers"), score(measures.architecture_score(architecture), "architecture_score"), score(measures.security_score(security_metrics(t)), "security_score"),
        score(dependencies.dependency_score(t("packages"), locks(t)), "dependency_score"), score(documentation(t), "documentation_score"),
    ):
        wide = wide.join(part, "repo_id", "left")
    return wide.withColumn("verification_score", F.lit(None).cast("double"))


def signals(t: Tables) -> DataFrame:
    return ownership.assistance_signals(facts(t))


@once
def evidence(t: Tables) -> DataFrame:
    own = files(t)
    seen = skills.skill_signals(t("code_commits").select("repo_id").distinct(), measures.testing_metrics(own), own, structure.layers(own), patterns(t))
    texts = structure.readmes(code(t)).select("repo_id", F.lit("readme").alias("source"), "text")
    return skills.repository_evidence(own, t("packages"), seen, texts)


ANALYZERS = {"code_metrics": "technical_quality", "testing": "testing", "documentation": "documentation", "architecture": "architecture", "dependencies": "architecture", "security": "security", "git_history": "git_engineering", "ownership": "ownership", "ai_utilization": "ai_utilization"}


@once
def analyzer_results(t: Tables) -> DataFrame:
    """(repo_id, analyzer, score, confidence) of every analyzer."""
    own = facts(t)
    weighted = lambda rows, weights: _weighted(rows, weights)
    parts = {
        "code_metrics": measures.code_quality(code_metrics(t)), "testing": measures.testing_score(measures.testing_metrics(files(t))), "documentation": documentation(t).withColumn("confidence", F.lit(0.8)),
        "architecture": measures.architecture_score(architecture_metrics(t)), "dependencies": dependencies.dependency_score(t("packages"), locks(t)).withColumn("confidence", F.lit(0.8)),
        "security": measures.security_score(security_metrics(t)), "git_history": history.history_score(t("code_commits"), t("code_branches"), t("code_tags"), t("emails"), code(t)),
        "ownership": weighted(ownership.ownership_factors(own), fixed.OWNERSHIP_WEIGHTS), "ai_utilization": weighted(ownership.utilization_factors(own), fixed.UTILIZATION_WEIGHTS).withColumn("confidence", F.lit(0.65)),
    }
    out = None
    for name, df in parts.items():
        rows = df.select("repo_id", F.lit(name).alias("analyzer"), F.col("score").cast("double").alias("score"), F.col("confidence").cast("double").alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _weighted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    from ..operators import scoring

    return scoring.weighted_factors(rows.withColumnRenamed("repo_id", "id"), weights).withColumnRenamed("id", "repo_id")
