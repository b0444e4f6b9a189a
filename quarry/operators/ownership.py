"""Assistance signals, ownership factors and utilisation factors, from measured tables: one row a repository and signal."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, log_scale, scale


def complexity_variation(profiled: DataFrame, least_functions: int = 2, least_files: int = 4) -> DataFrame:
    """profiled (repo_id, path, kind, complexity): (repo_id, variation): spread over mean of the files' mean complexity, over files of at least least_functions
    functions; null with fewer than least_files of them."""
    files = profiled.where("kind <> 'class'").groupBy("repo_id", "path").agg(F.avg("complexity").alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_functions)
    by = files.groupBy("repo_id").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread"), F.count(F.lit(1)).alias("n"))
    return by.select("repo_id", F.when((F.col("n") >= least_files) & (F.col("mean") > 0), F.col("spread") / F.col("mean")).alias("variation"))


def assistance_signals(facts: DataFrame) -> DataFrame:
    """(repo_id, factor, value 0 to 1) of the seven signals. facts has a row a repository with

    commit_count, active_days, single_commit, largest_share, phases, burst_days (history); discontinuity; functions, documented_ratio, trivial, trivial_documented,
    structured_docs, duplication (code); clone_groups; variation; artifacts; readme_words. Nulls count as not seen."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    best = lambda *c: F.greatest(*c)
    when = lambda cond, v: F.when(cond, v).otherwise(0.0)
    commits, phases = n("commit_count"), F.coalesce("phases", F.array().cast("array<string>"))
    shape = F.when(n("commit_count") <= 1, 0.85).otherwise(best(when(n("largest_share") > 0.7, 0.6), when((n("active_days") <= 2) & (commits < 15), 0.5), when(F.size(F.array_except(phases, F.array(F.lit("initial_implementation")))) == 0, 0.45)))
    shape = F.when((commits > 40) & (n("active_days") > 10), F.least(shape, F.lit(0.2))).otherwise(shape)
    functions = n("functions")
    trivial = n("trivial_documented") / F.greatest(F.lit(1), n("trivial"))
    docs = best(when((n("documented_ratio") > 0.9) & (trivial > 0.85) & (n("trivial") > 0), 0.6), when(F.least(F.lit(1.0), n("structured_docs") / F.greatest(F.lit(1), functions)) > 0.8, 0.55))
    docs = F.when((docs > 0) & (n("readme_words") < 120), F.least(F.lit(1.0), docs + 0.2)).otherwise(docs)
    clones, duplicates = n("clone_groups"), n("duplication")
    values = {
        "history_shape": when(commits > 0, shape), "style_discontinuity": n("discontinuity") * 1.0, "structured_docs": when(functions >= 5, docs),
        "boilerplate": best(when(clones >= 3, F.least(F.lit(0.8), 0.2 + clones * 0.1)), when(duplicates > 0.15, F.least(F.lit(0.7), duplicates * 2.5))),
        "abstraction": F.coalesce(clamp((F.col("variation") - 0.55) / 0.9, 0.0, 1.0), F.lit(0.0)), "artifacts": n("artifacts") * 1.0, "bursts": when(commits > 0, clamp(n("burst_days") / 4.0, 0.0, 0.8)),
    }
    return _long(facts, values)


def _long(facts: DataFrame, values: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("factor"), v.cast("double").alias("value")) for k, v in values.items()])
    return facts.select("repo_id", F.explode(rows).alias("f")).select("repo_id", "f.factor", "f.value")


def ownership_factors(facts: DataFrame) -> DataFrame:
    """(repo_id, factor, value 0 to 1, null where it can't be assessed) of the eight factors. facts has a row a repository with

    commit_count, active_days, phases, evolution_score, quality, conventional, share (history); test_cases, references_own; readme_words, readme_features,
    readme_is_placeholder; discontinuity; source_files; verification_score (0 to 100 or null)."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    phases = F.coalesce("phases", F.array().cast("array<string>"))
    has = lambda *names: F.size(F.array_intersect(phases, F.array(*[F.lit(x) for x in names])))
    commits = n("commit_count") > 0
    tests = F.when(n("test_cases") > 0, 0.55 + F.when(F.coalesce("references_own", F.lit(False)), 0.25).otherwise(0.0) + F.when(has("testing") > 0, 0.2).otherwise(0.0)).otherwise(0.0)
    readme = F.when(n("readme_words") > 0, (scale(n("readme_words"), 30.0, 400.0) / 100 * 0.6 + F.least(F.lit(0.4), n("readme_features") * 0.05)) * F.when(F.coalesce("readme_is_placeholder", F.lit(False)), 0.35).otherwise(1.0)).otherwise(0.0)
    values = {
        "incremental_development": F.when(commits, 0.55 * log_scale(n("commit_count").cast("double"), 40) + 0.45 * log_scale(n("active_days").cast("double"), 15)),
        "iteration_evidence": F.when(commits, clamp(F.greatest(has("bug_fixes", "refactoring", "optimization") / 3.0, n("evolution_score") / 100.0 * 0.8), 0.0, 1.0)),
        "test_evolution": clamp(tests, 0.0, 1.0), "project_specific_docs": clamp(readme, 0.0, 1.0),
        "commit_quality": F.when(commits, clamp(n("quality") + F.when(n("conventional") > 0.4, 0.1).otherwise(0.0), 0.0, 1.0)),
        "style_consistency": F.when(n("source_files") >= 3, clamp(1.0 - n("discontinuity"), 0.0, 1.0)), "attribution": F.when(commits, clamp(n("share") * 1.0, 0.0, 1.0)),
        "candidate_explanation": clamp(F.col("verification_score") / 100.0, 0.0, 1.0),
    }
    return _long(facts, values)


def utilization_factors(facts: DataFrame) -> DataFrame:
    """(repo_id, factor, value 0 to 1) of the six factors. facts has a row a repository with

    source_files, rework (share of files changed again, or null), phases, test_cases, ci_runs_tests, handling, security_score, architecture_score, n_cycles,
    documentation_score, dependency_score, verification_score."""
    n = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    phases = F.coalesce("phases", F.array().cast("array<string>"))
    intent = F.size(F.array_intersect(phases, F.array(F.lit("refactoring"), F.lit("bug_fixes")))) / 2.0
    some = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(0.0)
    documentation = n("documentation_score") / 100.0
    values = {
        "delivery": scale(n("source_files"), 0.0, 25.0) / 100, "integration": clamp(F.coalesce(F.col("rework") / 0.5, intent), 0.0, 1.0),
        "verification": some(F.col("test_cases") > 0, 0.45) + some(F.col("ci_runs_tests"), 0.25) + some(F.col("handling") >= 0.05, 0.15) + some(F.col("security_score") >= 70, 0.15),
        "architectural_ownership": clamp(n("architecture_score") / 100.0 * F.when(n("n_cycles") > 0, 0.85).otherwise(1.0), 0.0, 1.0),
        "understanding": clamp(F.coalesce(documentation * 0.6 + F.col("verification_score") / 100.0 * 0.4, documentation), 0.0, 1.0), "dependency_discipline": clamp(F.coalesce(F.nullif(F.col("dependency_score"), F.lit(0.0)), F.lit(50.0)) / 100.0, 0.0, 1.0),
    }
    return _long(facts, values)


def assistance_likelihood(signals: DataFrame, weights: dict[str, float] = fixed.ASSISTANCE_WEIGHTS) -> DataFrame:
    """signals (repo_id, factor, value): (repo_id, likelihood 0 to 100, active: signals of 0.3 or more)."""
    table = F.broadcast(signals.sparkSession.createDataFrame(sorted(weights.items()), "factor string, weight double"))
    return signals.join(table, "factor").groupBy("repo_id").agg((100 * F.sum(F.col("value") * F.col("weight"))).alias("likelihood"), F.count_if(F.col("value") >= 0.3).alias("active"))


def likelihood_confidence(signals: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo_id, confidence): 0.25, more for signals above 0.05 and for commits, profiled files and functions to judge from, at most 0.8.
    facts (repo_id, commit_count, source_files, functions)."""
    firing = signals.groupBy("repo_id").agg(F.avg((F.col("value") > 0.05).cast("int")).alias("breadth"))
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    steps = F.when(n("commit_count") >= 5, 0.35).when(n("commit_count") > 0, 0.1).otherwise(0.0) + F.when(n("source_files") >= 5, 0.25).when(n("source_files") > 0, 0.1).otherwise(0.0) + F.when(n("functions") >= 20, 0.2).otherwise(0.05) + 0.2
    return facts.join(firing, "repo_id").select("repo_id", clamp(0.25 + 0.4 * steps + 0.25 * F.col("breadth"), 0.0, 0.8).alias("confidence"))
