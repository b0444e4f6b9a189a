"""Job descriptions as weighted requirements."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import col
from . import skills

MOST_BULLETS = 20


def _first(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    return reduce(lambda out, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(out), reversed(rules), otherwise)


def min_years(text) -> Column:
    """The least number of years that a text asks for; null where it names none."""
    return F.array_min(F.transform(F.regexp_extract_all(col(text), F.lit(fixed.YEARS), 1), lambda x: x.try_cast("int")))


def experience_level(text) -> Column:
    """The first level whose words stand in the text; without one, by years."""
    years = min_years(text)
    return _first(col(text), fixed.LEVELS, F.when(years >= 6, "senior").when(years >= 3, "mid").when(years.isNotNull(), "entry").otherwise("unspecified"))


def domain(text) -> Column:
    return _first(col(text), fixed.DOMAINS, F.lit("general"))


def bullets(body) -> Column:
    """Items of a list without their marks, at most MOST_BULLETS; a text without list gives its sentences of more than 20 characters."""
    items = F.filter(F.split(col(body), "\n"), lambda x: x.rlike(r"^\s*[-*•]|^\s*\d+[.)]"))
    clean = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•\d.)\s]+", ""))), lambda x: F.length(x) > 3)
    sentences = F.filter(F.transform(F.split(F.regexp_replace(col(body), r"([.!?])\s+", "$1\u0001"), "\u0001"), F.trim), lambda x: F.length(x) > 20)
    return F.slice(F.when(F.size(items) > 0, clean).otherwise(sentences), 1, MOST_BULLETS)


def sections(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, description): (job_id, section, kind, body). A heading opens a section of its kind; what stands before the first is general."""
    lines = jobs.select("job_id", F.posexplode(F.split("description", "\n")).alias("at", "line"))
    kind = _first(F.col("line"), list(fixed.JOB_HEADINGS.items()), F.lit(None).cast("string"))
    ordered = Window.partitionBy("job_id").orderBy("at")
    placed = lines.withColumn("heading", kind).withColumns({"section": F.count("heading").over(ordered), "kind": F.coalesce(F.last("heading", ignorenulls=True).over(ordered), F.lit("general"))})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("at", "line")))), lambda x: x.line), "\n")
    return placed.groupBy("job_id", "section", "kind").agg(body.alias("body"))


def requirements(jobs: DataFrame, taxonomy=fixed.SKILLS) -> DataFrame:
    """jobs (job_id, title, description): (job_id, skill, label, dimension, required, importance, n_terms, source in explicit, title, implied).

    Skills of required sections and of the title are required; those of general text only if it asks for them and doesn't soften it; implied skills come
    with little weight. Importance adds up to one a job: 1, 0.45 if preferred, 0.2 if implied, more for several forms, twice for a form in the title."""
    parts = sections(jobs)
    found = skills.extract(parts.select(F.struct("job_id", "section").alias("id"), F.col("body").alias("text")), taxonomy).select("id.job_id", "id.section", "skill", "terms")
    asks = F.col("body").rlike(fixed.REQUIRED_WORDS) & ~F.col("body").rlike(fixed.PREFERRED_WORDS)
    judged = found.join(parts.select("job_id", "section", "kind", F.when(F.col("kind") == "general", asks).otherwise(F.col("kind") == "required").alias("required")), ["job_id", "section"])
    explicit = judged.groupBy("job_id", "skill").agg(F.bool_or("required").alias("required"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    titled = skills.extract(jobs.select(F.col("job_id").alias("id"), F.coalesce("title", F.lit("")).alias("text")), taxonomy).select(F.col("id").alias("job_id"), "skill", F.col("terms").alias("title_terms"))
    named = explicit.join(titled, ["job_id", "skill"], "full").withColumns({"source": F.when(F.col("terms").isNull(), "title").otherwise("explicit"), "required": F.coalesce("required", F.lit(False)) | F.col("title_terms").isNotNull(), "terms": F.coalesce("terms", "title_terms")})
    implied = skills.with_implied(named.select(F.col("job_id").alias("id"), "skill"), taxonomy).where("not direct").select(F.col("id").alias("job_id"), "skill", F.lit(False).alias("required"), F.array().cast("array<string>").alias("terms"), F.lit("implied").alias("source"))
    every = named.select("job_id", "skill", "required", "terms", "source").unionByName(implied).join(jobs.select("job_id", F.lower(F.coalesce("title", F.lit(""))).alias("title")), "job_id")
    base = F.when(F.col("source") == "implied", 0.2).when(F.col("required"), 1.0).otherwise(0.45)
    in_title = F.exists("terms", lambda t: F.col("title").contains(t))
    raw = base * (1.0 + 0.15 * F.log1p(F.greatest(F.lit(0), F.size("terms") - 1).cast("double"))) * F.when(in_title, 2.0).otherwise(1.0)
    weighed = every.withColumn("raw", raw).withColumn("importance", F.col("raw") / F.sum("raw").over(Window.partitionBy("job_id")))
    return weighed.join(F.broadcast(skills.catalogue(jobs.sparkSession, taxonomy)), "skill").select("job_id", "skill", "label", "dimension", "required", "importance", F.size("terms").alias("n_terms"), "source")


def parsed(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, title, description): (job_id, level, min_years, domain, responsibilities). Duties are the items of the sections for them, else the first
    eight of the whole text."""
    whole = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    duties = sections(jobs).where("kind = 'responsibilities'").groupBy("job_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", bullets("body").alias("b")))), lambda x: x.b)).alias("duties"))
    own = jobs.select("job_id", experience_level(whole).alias("level"), min_years(whole).alias("min_years"), domain(whole).alias("domain"), F.slice(bullets(F.coalesce("description", F.lit(""))), 1, 8).alias("items"))
    return own.join(duties, "job_id", "left").select("job_id", "level", "min_years", "domain", F.when(F.size("duties") > 0, F.col("duties")).otherwise(F.col("items")).alias("responsibilities"))


def overridden(wanted: DataFrame, edits: DataFrame) -> DataFrame:
    """wanted (job_id, skill, required, importance) with manual edits (job_id, skill, required, importance; importance zero takes the skill out; nulls keep what
    was there); importance adds up to one again."""
    new = edits.select("job_id", "skill", F.col("required").alias("new_required"), F.col("importance").alias("new_importance"))
    both = wanted.select("job_id", "skill", "required", "importance").join(new, ["job_id", "skill"], "full")
    kept = both.select("job_id", "skill", F.coalesce("new_required", "required", F.lit(False)).alias("required"), F.coalesce("new_importance", "importance", F.lit(0.0)).alias("raw")).where("raw > 0")
    return kept.select("job_id", "skill", "required", (F.col("raw") / F.sum("raw").over(Window.partitionBy("job_id"))).alias("importance"))


def dimension_coverage(wanted: DataFrame, strengths: DataFrame) -> DataFrame:
    """wanted (job_id, skill, dimension), strengths (repo_id, skill, strength): mean strength, 0 to 100, by job, repository and dimension."""
    totals = wanted.groupBy("job_id", "dimension").agg(F.count(F.lit(1)).alias("n"))
    met = wanted.join(strengths, "skill").groupBy("job_id", "repo_id", "dimension").agg(F.sum("strength").alias("s"))
    return met.join(totals, ["job_id", "dimension"]).select("job_id", "repo_id", "dimension", (100 * F.col("s") / F.col("n")).alias("coverage"))
