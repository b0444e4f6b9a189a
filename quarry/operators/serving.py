"""Reads over produced tables: latest rows, rankings, pages, visibility, comparisons, counts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must end in a unique column."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def ranked(df: DataFrame, by: list[str], tie: str, most: int) -> DataFrame:
    """The `most` best rows, nulls last, with their place. Each task keeps its best; only those are numbered."""
    order = [*[F.desc_nulls_last(c) for c in by], F.asc(tie)]
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: list[Column], size: int, start: int) -> DataFrame:
    """Rows start .. start + size in order, with the total count."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(start + size).withColumn("_at", F.row_number().over(Window.orderBy(*order))).where(F.col("_at") > start).drop("_at").join(F.broadcast(total))


def compare(scores: DataFrame, ids: list[int]) -> DataFrame:
    """A column e<id> for each evaluation, a row for each category."""
    return scores.groupBy("category").agg(*[F.avg(F.when(F.col("evaluation_id") == i, F.col("score"))).alias(f"e{i}") for i in ids])


def recent_counts(events: DataFrame, key: str, hours: int) -> DataFrame:
    """Rows and actors by key in the last hours before the newest row."""
    newest = events.agg(F.max("created_at").alias("newest"))
    return events.join(F.broadcast(newest)).where(F.col("created_at") > F.col("newest") - F.make_interval(hours=F.lit(hours))).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor_id").alias("n_actors"))


def over_limit(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(actor_id, window_start, n): fixed windows in which an actor has more than `most` rows."""
    start = F.floor(F.unix_micros("created_at") / (seconds * 1_000_000)) * seconds
    return events.groupBy("actor_id", start.alias("window_start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in columns]))


def visible(df: DataFrame, members: DataFrame, user_id: int, is_admin: bool = False, own_candidate=None) -> DataFrame:
    """Rows (owner_id, organization_id) that a user owns, whose organisation the user belongs to, or that are about the user as a candidate (candidate_id = own_candidate)."""
    if is_admin:
        return df
    mine = members.where(F.col("user_id") == user_id).select(F.col("organization_id").alias("_org")).distinct()
    about = F.lit(False) if own_candidate is None else F.coalesce(F.col("candidate_id") == own_candidate, F.lit(False))
    return df.join(mine, F.col("organization_id") == F.col("_org"), "left").where(F.coalesce(F.col("owner_id") == user_id, F.lit(False)) | F.col("_org").isNotNull() | about).drop("_org")


def answer_features(answers: DataFrame) -> DataFrame:
    """Sentences, words, words a sentence, and words of reasoning of each user answer."""
    text = F.col("answer_text")
    sentences, words = F.regexp_count(text, F.lit(r"[^.!?]+")), F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    markers = F.regexp_count(text, F.lit(r"(?i)\b(because|therefore|trade-?off|instead|measured)\b"))
    return answers.where("role = 'user'").select("session_id", "question_id", sentences.alias("n_sentences"), words.alias("n_words"), (words / F.greatest(F.lit(1), sentences)).alias("avg_sentence"), markers.alias("n_markers"))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


# -- filters


def filtered(rows: DataFrame, equal: dict[str, object] | None = None, least: dict[str, float] | None = None, holds: dict[str, str] | None = None) -> DataFrame:
    """rows where each column of `equal` has its value, each of `least` at least its value, each of `holds` its text, whatever the case. A value of None asks for nothing."""
    out = rows
    for name, value in (equal or {}).items():
        out = out if value is None else out.where(F.col(name) == value)
    for name, value in (least or {}).items():
        out = out if value is None else out.where(F.col(name) >= value)
    for name, value in (holds or {}).items():
        out = out if value is None else out.where(F.contains(F.lower(name), F.lit(value.lower())))
    return out


def importable(repositories: DataFrame, imported: DataFrame, forks: bool = False, archived: bool = False) -> DataFrame:
    """repositories (full_name, is_fork, is_archived, ...) that may be imported, with already_imported: whether imported (full_name) has it."""
    some = repositories if forks else repositories.where(~F.col("is_fork"))
    some = some if archived else some.where(~F.col("is_archived"))
    known = imported.select("full_name").distinct().withColumn("already_imported", F.lit(True))
    return some.join(known, "full_name", "left").withColumn("already_imported", F.coalesce("already_imported", F.lit(False)))


def visible_notes(notes: DataFrame, private: bool) -> DataFrame:
    """notes (evaluation_id, created_at, visible_to_candidate, ...), newest first within an evaluation; private ones only where asked for."""
    some = notes if private else notes.where("visible_to_candidate")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("evaluation_id").orderBy(F.desc("created_at"), "note_id")))


# -- repositories


def repository_page(repositories: DataFrame, members: DataFrame, user_id, limit: int, offset: int = 0, candidate_id=None) -> DataFrame:
    """Repositories that a user may see, last analysed first, never analysed last: a page with the total."""
    seen = filtered(visible(repositories, members, user_id), {"candidate_id": candidate_id})
    return page(seen, [F.desc_nulls_last("last_analyzed_at"), F.asc("id")], limit, offset)


def analyses(rows: DataFrame, most: int = 20) -> DataFrame:
    """rows (repo_id, analysis_id, created_at, ...): each repository's newest, numbered; place 1 is the latest."""
    return top_per_group(rows, ["repo_id"], [F.desc("created_at"), F.desc("analysis_id")], most)


def of_latest_analysis(details: DataFrame, rows: DataFrame, **equal) -> DataFrame:
    """details (analysis_id, ...) of each repository's latest analysis, with its repo_id, where the named columns have the given values."""
    return filtered(details.join(analyses(rows, 1).select("analysis_id", "repo_id"), "analysis_id"), equal)


def findings_by_severity(findings: DataFrame, rows: DataFrame, most: int = 200, severity: str | None = None) -> DataFrame:
    """The latest analysis's findings of each repository: gravest first, then surest; at most `most`."""
    rank = F.array_position(F.array(*[F.lit(x) for x in fixed.PENALTIES]), F.col("severity"))
    return top_per_group(of_latest_analysis(findings, rows, severity=severity), ["repo_id"], [rank.asc(), F.desc("confidence"), F.asc("finding_id")], most)


def similarity_rows(similar: DataFrame, rows: DataFrame, most: int = 100, scope: str | None = None) -> DataFrame:
    """The latest analysis's similar chunks of each repository, closest first; at most `most`."""
    return top_per_group(of_latest_analysis(similar, rows, scope=scope), ["repo_id"], [F.desc("similarity"), F.asc("row_id")], most)


def newest_commits(commits: DataFrame, most: int = 100) -> DataFrame:
    return top_per_group(commits, ["repo_id"], [F.desc("committed_at"), F.asc("sha")], most)


def file_inventory(files: DataFrame, most: int = 500, category: str | None = None) -> DataFrame:
    """Files of each repository, largest first; at most `most`."""
    return top_per_group(filtered(files, {"category": category}), ["repo_id"], [F.desc("size_bytes"), F.asc("path")], most)


ACTIVE = ["QUEUED", "RUNNING"]


def repository_jobs(runs: DataFrame) -> DataFrame:
    """runs (run_id, repo_id, status, created_at): one row a repository with its last run's status, how many runs it has had, and whether one is active."""
    last = F.struct("created_at", "run_id")
    return runs.groupBy("repo_id").agg(F.max_by("status", last).alias("status"), F.max_by("run_id", last).alias("run_id"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status").isin(ACTIVE)).alias("active"))


# -- evaluations


def evaluation_page(evaluations: DataFrame, limit: int, offset: int = 0, min_score: float | None = None, **equal) -> DataFrame:
    """Evaluations with the total: best first, those without score last, then newest; by any of job_id, candidate_id, repo_id, status, and a least score."""
    return page(filtered(evaluations, equal, {"overall": min_score}), [F.desc_nulls_last("overall"), F.desc("created_at"), F.asc("evaluation_id")], limit, offset)


def evaluation_details(evaluations: DataFrame, repositories: DataFrame, jobs: DataFrame, candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """evaluations with the names of their repository (repo_id, full_name), job (job_id, title) and candidate (candidate_id, display_name), null where there is none, and scores (evaluation_id,
    category, score, weight) as a list, heaviest first."""
    listed = scores.groupBy("evaluation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "category", "score"))), lambda x: F.concat(x.category, F.lit("="), F.coalesce(F.format_number(x.score, 1), F.lit("-")))), ",").alias("scores"))
    wide = evaluations.join(repositories.select("repo_id", "full_name"), "repo_id", "left").join(jobs.select("job_id", "title"), "job_id", "left").join(candidates.select("candidate_id", "display_name"), "candidate_id", "left")
    return wide.join(listed, "evaluation_id", "left")


def evidence_list(evidence: DataFrame, category: str | None = None, supports: str | None = None) -> DataFrame:
    """Evidence of each repository, surest first."""
    rows = filtered(evidence, {"category": category, "supports": supports})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("confidence"), "evidence_id")))


def override_list(overrides: DataFrame) -> DataFrame:
    return overrides.withColumn("place", F.row_number().over(Window.partitionBy("evaluation_id").orderBy(F.desc("created_at"), F.desc("override_id"))))


# -- people, jobs, policies


def candidate_page(candidates: DataFrame, evaluations: DataFrame, limit: int, offset: int = 0, text: str | None = None, organization_id=None) -> DataFrame:
    """candidates (candidate_id, display_name, email, headline, organization_id) by name, each with its best evaluation; text is looked for in name, e-mail and headline."""
    some = filtered(candidates, {"organization_id": organization_id})
    some = some if text is None else search(some, text, ["display_name", "email", "headline"])
    best = evaluations.where("overall is not null").groupBy("candidate_id").agg(F.max_by("evaluation_id", F.struct("overall", "evaluation_id")).alias("best_evaluation"), F.max("overall").alias("best_score"))
    return page(some.join(best, "candidate_id", "left"), [F.asc("display_name"), F.asc("candidate_id")], limit, offset)


def visible_jobs(jobs: DataFrame, members: DataFrame, user_id, public: bool = True) -> DataFrame:
    """jobs (job_id, owner_id, organization_id, is_public): one's own, those of one's organisations, and public ones where asked for."""
    own = visible(jobs.where(~F.col("is_public")) if public else jobs, members, user_id)
    return own.unionByName(jobs.where("is_public")) if public else own


def taxonomy_listing(spark, skills=fixed.SKILLS) -> DataFrame:
    """(skill, label, dimension, sources): the kinds of evidence that a skill can have."""
    kinds = [(4, "dependencies"), (5, "imports"), (6, "languages"), (7, "paths")]
    return spark.createDataFrame([(r[0], r[1], r[2], ",".join(n for i, n in kinds if r[i])) for r in skills], "skill string, label string, dimension string, sources string")


def taxonomy_usage(spark, mentions: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """taxonomy_listing() with how many texts name each skill and how often; mentions: (id, skill, n_mentions). Skills that no text names have zeros."""
    used = mentions.groupBy("skill").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_mentions").cast("long").alias("n_mentions"))
    return taxonomy_listing(spark, skills).join(used, "skill", "left").fillna(0, ["n_texts", "n_mentions"])


def policy_listing(versions: DataFrame, organization_id=None, history: bool = False) -> DataFrame:
    """versions (policy_key, organization_id, version, is_current): an organisation's and the shared ones; only current ones unless history is asked for; newest version first."""
    some = versions if organization_id is None else versions.where(F.col("organization_id").isNull() | (F.col("organization_id") == organization_id))
    some = some if history else some.where("is_current")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("policy_key", "organization_id").orderBy(F.desc("version"))))


def resolved_policy(versions: DataFrame, wanted: DataFrame, default: str = "default") -> DataFrame:
    """wanted (request_id, event_id, organization_id): the version with that event_id; without one the organisation's newest current; else the newest current of the default key."""
    current = versions.where("is_current")
    named = versions.select(F.col("event_id").alias("by_id"))
    own = current.where("organization_id is not null").groupBy("organization_id").agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("by_organization"))
    shared = current.where(F.col("policy_key") == default).agg(F.max_by("event_id", F.struct("created_at", "event_id")).alias("by_default"))
    met = wanted.join(named, F.col("event_id") == F.col("by_id"), "left").join(own, "organization_id", "left")
    return met.join(F.broadcast(shared)).select("request_id", F.coalesce("by_id", "by_organization", "by_default").alias("event_id"))


# -- portfolios


def best_categories(scores: DataFrame, strong: float = 75.0, weak: float = 55.0) -> DataFrame:
    """scores (owner_id, category, score): each owner's categories of at least `strong` and below `weak`, best first and worst first."""
    side = F.when(F.col("score") >= strong, "strength").when(F.col("score") < weak, "gap")
    rows = scores.withColumn("side", side).where("side is not null")
    order = F.when(F.col("side") == "strength", -F.col("score")).otherwise(F.col("score"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner_id", "side").orderBy(order, "category")))


def portfolio_dna(dna: DataFrame, owners: DataFrame) -> DataFrame:
    """dna (repo_id, dimension, value), owners (repo_id, owner_id): each owner's best value by dimension."""
    return dna.join(owners, "repo_id").groupBy("owner_id", "dimension").agg(F.max("value").alias("value"))


def best_strengths(strengths: DataFrame, owners: DataFrame) -> DataFrame:
    """strengths (repo_id, skill, strength): each owner's best by skill, and in how many repositories it shows."""
    return strengths.join(owners, "repo_id").groupBy("owner_id", "skill").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n_repositories"))


def readiness(requirements: DataFrame, strengths: DataFrame, owners: DataFrame, matched_from: float = 0.2) -> DataFrame:
    """requirements (job_id, skill, importance, required), strengths (repo_id, skill, strength), owners (repo_id, owner_id): for each job and owner the match of their best strengths and the
    required skills that are missing. Only owners with any of a job's skills have a row."""
    best = best_strengths(strengths, owners)
    totals = requirements.groupBy("job_id").agg(F.sum("importance").alias("weight"), F.array_sort(F.collect_set(F.when(F.col("required"), F.col("skill")))).alias("required"))
    met = requirements.join(best, "skill").groupBy("job_id", "owner_id").agg(F.sum(F.col("importance") * F.col("strength")).alias("s"), F.collect_set(F.when(F.col("strength") >= matched_from, F.col("skill"))).alias("have"))
    return met.join(totals, "job_id").select("job_id", "owner_id", (100 * F.col("s") / F.col("weight")).alias("score"), F.array_join(F.array_except("required", "have"), ",").alias("missing"))


def best_repositories(matches: DataFrame, owners: DataFrame, most: int = 5) -> DataFrame:
    """matches (job_id, repo_id, score): each owner's best repositories for a job. Scores that are equal to six places are ties, as sums come in any order."""
    place = F.row_number().over(Window.partitionBy("job_id", "owner_id").orderBy(F.desc(F.round("score", 6)), "repo_id"))
    return matches.join(owners, "repo_id").withColumn("place", place).where(F.col("place") <= most).select("job_id", "owner_id", "place", "repo_id", "score")


# -- interviews, operations


def interview_list(sessions: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """sessions (session_id, ...) with how many questions and answers they have, and the last question."""
    q = questions.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_questions"), F.max_by("question", "question_id").alias("last_question"))
    a = answers.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_answers"))
    return sessions.join(q, "session_id", "left").join(a, "session_id", "left").fillna(0, ["n_questions", "n_answers"])


def job_durations(runs: DataFrame, hours: int = 24) -> DataFrame:
    """runs (status, created_at, duration): of the last `hours` before the newest run, by status: how many, mean and longest duration."""
    newest = runs.agg(F.max("created_at").alias("newest"))
    recent = runs.join(F.broadcast(newest)).where(F.col("created_at") > F.col("newest") - F.expr(f"interval {hours} hours"))
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean_duration"), F.max("duration").alias("longest"))


def job_monitor(runs: DataFrame, repositories: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """Runs with the names of their repositories, newest first: a page with the total."""
    named = filtered(runs, {"status": status}).join(repositories.select("repo_id", "full_name"), "repo_id", "left")
    return page(named, [F.desc("created_at"), F.desc("run_id")], limit, offset)


def failure_list(failures: DataFrame, limit: int = 100) -> DataFrame:
    return failures.orderBy(F.desc("created_at"), F.desc("failure_id")).limit(limit)


def commonest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): each key's commonest value, the least of equally common ones."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_n")).alias("less"), value)).alias(value))
