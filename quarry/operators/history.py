"""Commit history: intents, messages, cadence, bursts, timelines, contributors, scores. One row a repository unless said otherwise."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, intent, message_quality, scale
from ..tables import running

EPOCH_DAYS = 86_400.0


def _seconds(ts: str = "committed_at") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _size() -> Column:
    return F.col("insertions") + F.col("deletions")


def _known(emails: DataFrame) -> DataFrame:
    return emails.select(F.lower("email").alias("known")).distinct()


def _own(commits: DataFrame) -> DataFrame:
    """Commits that aren't merges."""
    return commits.where(~F.coalesce("is_merge", F.lit(False)))


def candidate_commits(commits: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """Commits that aren't merges and, where e-mails are given, whose author is one of them or an alias of the form id+email.

    Each author's address is brought to the endings that follow its plus signs, so the match is a join on equal text. Null addresses match nothing."""
    own = _own(commits)
    if emails is None:
        return own
    address = F.lower("author_email")
    parts = F.split("address", r"\+")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "+"))
    authors = own.select(address.alias("address")).where("address is not null").distinct().select("address", F.explode(endings).alias("known"))
    mine = authors.join(_known(emails), "known", "left_semi").select("address").distinct()
    return own.withColumn("address", address).join(mine, "address", "left_semi").drop("address")


def intents(commits: DataFrame) -> DataFrame:
    """Commits that aren't merges by repository and intent of their subject."""
    return _own(commits).groupBy("repo_id", intent("message").alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def judged_commits(commits: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """The candidate's commits; of a repository in which they have none, all that aren't merges."""
    if emails is None:
        return _own(commits)
    mine = candidate_commits(commits, emails)
    return mine.unionByName(_own(commits).join(mine.select("repo_id").distinct(), "repo_id", "left_anti"))


def message_scores(commits: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """Means over judged_commits() of message quality, and the shares of low-effort and conventional subjects."""
    subject = F.trim(F.element_at(F.split("message", "\n"), 1))
    low = subject.rlike(fixed.LOW_EFFORT)
    return judged_commits(commits, emails).groupBy("repo_id").agg(
        F.avg(message_quality("message")).alias("quality"), F.avg(low.cast("int")).alias("low_effort"), F.avg((subject.rlike(fixed.CONVENTIONAL) & ~low).cast("int")).alias("conventional")
    )


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two times in seconds, downwards."""
    return F.floor((later - earlier) / EPOCH_DAYS)


def longest_gap(commits: DataFrame) -> DataFrame:
    """Whole days between neighbouring commits, merges among them: the longest."""
    after = F.lead(_seconds()).over(Window.partitionBy("repo_id").orderBy("committed_at", "sha"))
    return commits.withColumn("gap", whole_days(after, _seconds())).groupBy("repo_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"))


def burst_days(commits: DataFrame, times: float = 8.0, least: int = 1500) -> DataFrame:
    """(repo_id, day, size): days whose changed lines, merges left out, pass both `least` and `times` the median day's; none where that median is zero."""
    days = _own(commits).groupBy("repo_id", F.to_date(F.col("committed_at").cast("timestamp")).alias("day")).agg(F.sum(_size()).alias("size"))
    middle = days.groupBy("repo_id").agg(F.median("size").alias("middle"))
    return days.join(middle, "repo_id").where("middle > 0").where(F.col("size") > F.greatest(F.col("middle") * times, F.lit(float(least)))).select("repo_id", "day", "size")


def timeline(commits: DataFrame, buckets: int = 24) -> DataFrame:
    """(repo_id, bucket, n_commits, n_lines): equal parts of the project's life, of a day at least in all; empty ones are kept. Merges are left out."""
    commits = _own(commits)
    ends = commits.groupBy("repo_id").agg(F.min(_seconds()).alias("a"), F.max(_seconds()).alias("b"))
    step = F.greatest(F.col("b") - F.col("a"), F.lit(EPOCH_DAYS)) / buckets
    placed = commits.join(ends, "repo_id").withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((_seconds() - F.col("a")) / step)).cast("int"))
    found = placed.groupBy("repo_id", "bucket").agg(F.count(F.lit(1)).alias("n_commits"), F.sum(_size()).alias("n_lines"))
    grid = ends.select("repo_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(found, ["repo_id", "bucket"], "left").na.fill(0, ["n_commits", "n_lines"])


def commit_shares(commits: DataFrame) -> DataFrame:
    """Share of all changed lines in the first commit, and in the largest; merges left out. Zero where no line was changed."""
    first, total = F.min_by(_size(), F.struct("committed_at", "sha")), F.greatest(F.sum(_size()), F.lit(1))
    return _own(commits).groupBy("repo_id").agg((first / total).alias("first_share"), (F.max(_size()) / total).alias("largest_share"))


def contributors(commits: DataFrame, most: int = 5) -> DataFrame:
    """The authors with most commits that aren't merges; ties by address."""
    by = _own(commits).groupBy("repo_id", F.lower("author_email").alias("author_email")).agg(F.count(F.lit(1)).alias("n_commits"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n_commits"), "author_email"))).where(F.col("place") <= most)


def candidate_share(commits: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """Share of commits that aren't merges by known e-mails; 0 where none match, 1 where none are known."""
    every = _own(commits).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    if emails is None:
        return every.select("repo_id", F.lit(1.0).alias("share"))
    mine = candidate_commits(commits, emails).groupBy("repo_id").agg(F.count(F.lit(1)).alias("mine"))
    return every.join(mine, "repo_id", "left").select("repo_id", (F.coalesce("mine", F.lit(0)) / F.col("n")).alias("share"))


def newest_commits(commits: DataFrame, most: int = 5_000) -> DataFrame:
    """The newest `most` commits of each repository, ties by sha; `truncated` tells that it has as many or more."""
    aged = commits.withColumn("age", -F.unix_micros(F.col("committed_at").cast("timestamp")))
    laid = running(aged, "repo_id", ["age", "sha"], F.lit(1))
    counts = commits.groupBy("repo_id").agg((F.count(F.lit(1)) >= most).alias("truncated"))
    return laid.where(F.col("place") < most).drop("age", "place", "before").join(counts, "repo_id")


def history_signals(commits: DataFrame, emails: DataFrame | None = None) -> DataFrame:
    """One wide row a repository with commits: counts, days, shares, messages, phases, bursts. Days and span take merges in, the rest leaves them out."""
    at = F.col("committed_at").cast("timestamp")
    whole = commits.groupBy("repo_id").agg(F.countDistinct(F.to_date(at)).alias("active_days"), F.greatest(F.lit(1), whole_days(F.max(_seconds()), F.min(_seconds()))).alias("span_days"), F.count(F.lit(1)).alias("all_commits"))
    counts = _own(commits).groupBy("repo_id").agg(F.count(F.lit(1)).alias("commit_count"), F.countDistinct(F.lower("author_email")).alias("contributor_count"), F.median(_size()).alias("median_commit_size"))
    bursts = burst_days(commits).groupBy("repo_id").agg(F.count(F.lit(1)).alias("burst_days"))
    phases = evolution_score(commits).select("repo_id", F.col("score").alias("evolution_score"), "phases")
    wide = whole
    for part in (counts, commit_shares(commits), message_scores(commits, emails), candidate_share(commits, emails), longest_gap(commits), bursts, phases):
        wide = wide.join(part, "repo_id", "left")
    wide = wide.fillna(0, ["commit_count", "contributor_count", "first_share", "largest_share", "quality", "low_effort", "conventional", "burst_days", "evolution_score"])
    return wide.withColumns({"share": F.coalesce("share", F.lit(1.0 if emails is None else 0.0)), "phases": F.coalesce("phases", F.array().cast("array<string>")), "single_commit": F.col("commit_count") <= 1})


def history_score(commits: DataFrame, branches: DataFrame, tags: DataFrame, emails: DataFrame | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """Weighted sum of volume, cadence, messages, commit size, branching and releases; confidence by the number of commits.

    A row for each of repositories (repo_id), or else for each repository that has commits, branches or tags; those without commits have a null score and no
    confidence: not measured is not zero."""
    feature = ~F.element_at(F.split("name", "/"), -1).isin(fixed.KNOWN_BRANCHES)
    b = branches.groupBy("repo_id").agg(F.count_if(feature).alias("n_branches"))
    t = tags.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_tags"))
    wide = history_signals(commits, emails).join(b, "repo_id", "left").join(t, "repo_id", "left").na.fill(0, ["n_branches", "n_tags"])
    cadence = 0.6 * scale(F.col("active_days"), 1, 30) + 0.4 * scale(F.col("active_days") / F.col("span_days"), 0, 0.35)
    parts = {"volume": scale(F.col("commit_count"), 1, 60), "cadence": cadence, "message_quality": F.col("quality") * 100, "commit_size": scale(F.col("largest_share"), 0.95, 0.25), "branching": scale(F.col("n_branches"), 0, 4), "releases": scale(F.col("n_tags"), 0, 3)}
    total = reduce(lambda x, y: x + y, [w * parts[k] for k, w in fixed.HISTORY_WEIGHTS.items()])
    scored = wide.select("repo_id", clamp(total).alias("score"), F.when(F.col("commit_count") >= 5, 0.9).otherwise(0.55).alias("confidence"))
    if repositories is None:
        repositories = reduce(DataFrame.unionByName, [x.select("repo_id").distinct() for x in (commits, branches, tags)])
    return repositories.select("repo_id").distinct().join(scored, "repo_id", "left").fillna(0.0, ["confidence"])


# Fixed values: (phase, intents, weight).
PHASES = [("initial_implementation", ["feature"], 0.10), ("bug_fixes", ["fix"], 0.22), ("refactoring", ["refactor"], 0.18), ("testing", ["test"], 0.20), ("optimization", ["perf"], 0.08), ("documentation", ["docs"], 0.12), ("deployment", ["deploy"], 0.10)]


def evolution_score(commits: DataFrame) -> DataFrame:
    """100 times the weights of the phases that the intents of a repository's commits, merges left out, show."""
    seen = _own(commits).groupBy("repo_id").agg(*[F.bool_or(intent("message").isin(names)).alias(phase) for phase, names, _ in PHASES])
    total = reduce(lambda x, y: x + y, [F.when(F.col(p), w * 100).otherwise(0.0) for p, _, w in PHASES])
    return seen.select("repo_id", total.alias("score"), F.array_compact(F.array(*[F.when(F.col(p), p) for p, _, _ in PHASES])).alias("phases"))


def rework(commit_files: DataFrame) -> DataFrame:
    """Share of files that more than one commit changed, and that share scaled to 1 at one half."""
    per = commit_files.groupBy("repo_id", "path").agg(F.countDistinct("sha").alias("n"))
    return per.groupBy("repo_id").agg(F.avg((F.col("n") > 1).cast("int")).alias("share")).withColumn("strength", clamp(F.col("share") / 0.5, 0.0, 1.0))
