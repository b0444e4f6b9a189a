"""Scores: a missing measurement leaves both the sum and its weights; nothing missing counts as zero."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, utilization_class


def policy_weights(policies: DataFrame) -> DataFrame:
    """(policy_key, category, weight) with weights made to sum to one; a policy with a negative or only zero weights fails."""
    total = F.sum("weight").over(Window.partitionBy("policy_key"))
    least = F.min("weight").over(Window.partitionBy("policy_key"))
    ok = policies.withColumns({"total": total, "least": least})
    checked = F.when((F.col("least") >= 0) & (F.col("total") > 0), F.col("weight") / F.col("total")).otherwise(F.raise_error(F.lit("policy weights must not be negative or all zero")))
    return ok.select("policy_key", "category", checked.alias("weight"))


def overall_score(category_scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over available categories; coverage is the share of weight they hold; confidence sinks with missing coverage."""
    joined = category_scores.join(weights, "category")
    there = F.col("score").isNotNull()
    by = joined.groupBy("evaluation_id").agg(
        F.sum(F.when(there, F.col("score") * F.col("weight"))).alias("s"), F.sum(F.when(there, F.col("weight"))).alias("w"),
        F.sum("weight").alias("all_w"), F.sum(F.when(there, F.col("confidence") * F.col("weight"))).alias("c"),
    )
    coverage = F.coalesce("w", F.lit(0.0)) / F.col("all_w")
    return by.select("evaluation_id", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("score"), coverage.alias("coverage"), F.when(F.col("w") > 0, F.col("c") / F.col("w") * (0.55 + 0.45 * coverage)).alias("confidence"))


def repository_score(category_scores: DataFrame) -> DataFrame:
    return category_scores.groupBy("evaluation_id").agg(F.avg("score").alias("score"), F.count("score").alias("n_available"))


def verification_status(evaluations: DataFrame, least_categories: int = 4, verify_below: float = 45.0, review_below: float = 65.0, similarity_verify: float = 0.75, similarity_review: float = 0.55, likelihood_review: float = 65.0) -> DataFrame:
    """evaluations (evaluation_id, n_available, ownership, similarity, likelihood, disclosed): an advisory status and its reasons.

    Too few categories: incomplete, whatever else holds. Else the strictest of the signals; a missing signal says nothing."""
    has = lambda c: F.coalesce(c, F.lit(False))
    incomplete = F.col("n_available") < least_categories
    owner_verify, owner_review = has(F.col("ownership") < verify_below), has(F.col("ownership") < review_below)
    like_verify, like_review = has(F.col("similarity") >= similarity_verify), has(F.col("similarity") >= similarity_review)
    high = has(F.col("likelihood") >= likelihood_review)
    dependent = assistance_class(F.col("likelihood"), F.col("ownership")).isin("AI_DEPENDENT", "AI_DOMINATED")
    verify, review = owner_verify | like_verify | (high & dependent), owner_review | like_review | (high & ~F.col("disclosed"))
    status = F.when(incomplete, "ANALYSIS_INCOMPLETE").when(verify, "VERIFICATION_REQUIRED").when(review, "REVIEW_RECOMMENDED").otherwise("CLEAR")
    reasons = F.when(incomplete, F.array(F.lit("too few categories"))).otherwise(F.array_compact(F.array(F.when(owner_verify, "ownership insufficient").when(owner_review, "ownership limited"), F.when(like_verify, "close external match").when(like_review, "external match"), F.when(high & dependent, "dependent on assistance").when(high & ~F.col("disclosed"), "undisclosed assistance"))))
    return evaluations.select("evaluation_id", status.alias("status"), F.array_join(reasons, "; ").alias("reasons"))


def weighted_factors(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """values (id, factor, value in 0..1 or null): 100 * weighted mean over the factors that are there, and a confidence of 0.3 + 0.7 times the
    weight that is there, at most 0.95. Unknown factors don't count; a factor given twice counts once, with its largest value."""
    table = F.broadcast(values.sparkSession.createDataFrame(sorted(weights.items()), "factor string, weight double"))
    once = values.groupBy("id", "factor").agg(F.max("value").alias("value")).join(table, "factor")
    there = F.when(F.col("value").isNotNull(), F.col("weight"))
    by = once.groupBy("id").agg(F.sum(F.col("value") * F.col("weight")).alias("s"), F.sum(there).alias("w"))
    return by.select("id", (100 * F.col("s") / F.col("w")).alias("score"), F.least(F.lit(0.95), 0.3 + 0.7 * F.coalesce("w", F.lit(0.0)) / sum(weights.values())).alias("confidence"))


def utilization(scored: DataFrame, context: DataFrame) -> DataFrame:
    """scored (id, score), context (id, likelihood, ownership): six more points where assistance was used and owned, and the class."""
    bonus = F.when((F.col("likelihood") >= 45) & (F.col("ownership") >= 65) & (F.col("score") >= 55), 6.0).otherwise(0.0)
    return scored.join(context, "id").withColumn("score", clamp(F.col("score") + bonus)).select("id", "score", utilization_class("score").alias("class"))


def disclosure_alignment(declared: Column, likelihood: Column) -> Column:
    n = F.coalesce(likelihood, F.lit(0.0))
    return F.when(declared & (n >= 45), "consistent").when(declared, "declared_more_than_observed").when(n >= 65, "signals_above_declaration").otherwise("consistent")


def recommendations(scores: DataFrame, weights: DataFrame, most: int = 12) -> DataFrame:
    """scores (evaluation_id, category, score), weights (category, weight): for each evaluation the categories that gain most from work:
    gain = max(0, 85 - score) * weight; at most `most`, largest first."""
    gain = F.greatest(F.lit(0.0), 85.0 - F.col("score")) * F.col("weight")
    rows = scores.where("score is not null").join(weights, "category").withColumn("gain", gain).where("gain > 0")
    place = F.row_number().over(Window.partitionBy("evaluation_id").orderBy(F.desc("gain"), "category"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("evaluation_id", "place", "category", "gain")


def weighted_over_repositories(results: DataFrame) -> DataFrame:
    """results (owner_id, category, score, n_files): mean by evidence weight min(3, 0.5 + files / 60)."""
    w = F.least(F.lit(3.0), 0.5 + F.col("n_files") / 60.0)
    got = results.where("score is not null")
    return got.groupBy("owner_id", "category").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


def assistance_class(likelihood: Column, ownership: Column) -> Column:
    """Ownership tells using assistance well from not owning the result; without it nothing is said."""
    return (
        F.when(ownership.isNull(), "INSUFFICIENT_EVIDENCE").when(likelihood < 35, "AI_ASSISTED").when((likelihood < 60) & (ownership >= 75), "AI_ASSISTED").when(likelihood < 60, "AI_AUGMENTED")
        .when(ownership >= 70, "AI_AUGMENTED").when((likelihood < 78) | (ownership >= 45), "AI_DEPENDENT").otherwise("AI_DOMINATED")
    )


def job_match(requirements: DataFrame, strengths: DataFrame, matched_from: float = 0.2) -> DataFrame:
    """requirements (job_id, skill, importance, required), strengths (repo_id, skill, strength): 100 * sum(strength * importance) / sum(importance)
    for each job and repository that has any of its skills; matched and missing counts, coverage of required skills. Skills that a repository
    lacks come from the job's totals, so only equal skills are joined."""
    totals = requirements.groupBy("job_id").agg(F.sum("importance").alias("weight"), F.count_if("required").alias("n_required"), F.count(F.lit(1)).alias("n"))
    matched = F.col("strength") >= matched_from
    met = requirements.join(strengths, "skill").groupBy("job_id", "repo_id").agg(F.sum(F.col("strength") * F.col("importance")).alias("s"), F.count_if(matched).alias("n_matched"), F.count_if(matched & F.col("required")).alias("n_covered"))
    return met.join(totals, "job_id").select(
        "job_id", "repo_id", (100 * F.col("s") / F.col("weight")).alias("score"), "n_matched", (F.col("n_required") - F.col("n_covered")).alias("n_missing"),
        F.when(F.col("n_required") > 0, F.col("n_covered") / F.col("n_required")).alias("required_coverage"),
    )


def engineering_dna(strengths: DataFrame, dimensions: DataFrame, top: int = 4) -> DataFrame:
    """(repo_id, dimension, value): sum of the `top` best skill strengths of the dimension, halved, at most 1."""
    place = F.row_number().over(Window.partitionBy("repo_id", "dimension").orderBy(F.desc("strength"), "skill"))
    best = strengths.join(dimensions, "skill").withColumn("place", place).where(F.col("place") <= top)
    return best.groupBy("repo_id", "dimension").agg(clamp(F.sum("strength") / 2.0, 0.0, 1.0).alias("value"))


def policy_versions(events: DataFrame) -> DataFrame:
    """events (policy_key, organization_id, created_at, event_id): version numbers, and which is current."""
    w = Window.partitionBy("organization_id", "policy_key").orderBy("created_at", "event_id")
    return events.withColumns({"version": F.row_number().over(w), "is_current": F.lead("event_id").over(w).isNull()})


def apply_overrides(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """The latest override of each (evaluation_id, category) replaces the score; the original stays beside it."""
    last = overrides.groupBy("evaluation_id", "category").agg(F.max_by("new_score", F.struct("created_at", "override_id")).alias("new_score"))
    return scores.join(last, ["evaluation_id", "category"], "left").select("evaluation_id", "category", F.coalesce("new_score", "score").alias("score"), F.col("score").alias("original_score"), F.col("new_score").isNotNull().alias("overridden"))
