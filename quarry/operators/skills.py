"""Skills named in texts, what they imply, and how they compare with what repositories show."""

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import split_words

WORD = r"[^A-Za-z0-9+#_]+"


def skill_terms(skills=fixed.SKILLS) -> list[tuple[str, str, int, int, int]]:
    """(term as words, skill, characters, order, words): keys, labels and aliases, with a plural ending where a term ends in a letter, and with
    underscores in place of its gaps. Longer terms go first, then earlier ones."""
    out: dict[str, tuple[str, int, int, int]] = {}
    at = 0
    for key, label, _, aliases, *_ in skills:
        for term in (key, label.lower(), *aliases):
            words = split_words(term.replace("_", " ") if term == key else term)
            for ending in ("", "s", "es") if term[-1].isalpha() else ("",):
                for gaps in product((" ", "_"), repeat=len(words) - 1):
                    form = words[0] + "".join(g + w for g, w in zip(gaps, words[1:])) + ending
                    out.setdefault(form, (key, len(term), at, form.count(" ") + 1))
            at += 1
    return [(form, *rest) for form, rest in out.items()]


def closure(skills=fixed.SKILLS) -> dict[str, list[str]]:
    """Each skill with all that it implies, over any number of steps."""
    direct = {row[0]: row[8] for row in skills}
    out = {}
    for key in direct:
        found, open_ = {key}, [key]
        while open_:
            for x in direct.get(open_.pop(), []):
                if x not in found:
                    found.add(x)
                    open_.append(x)
        out[key] = sorted(found)
    return out


def catalogue(spark, skills=fixed.SKILLS) -> DataFrame:
    """(skill, label, dimension) of the taxonomy."""
    return spark.createDataFrame([row[:3] for row in skills], "skill string, label string, dimension string")


def mentions(docs: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """docs (id, text): (id, skill, term, at, n): runs of n words, from word `at`, that are a term. Where terms overlap, those of more characters are taken first,
    and a run that touches a taken one is passed over.

    Runs of up to the longest term's words are joined with the broadcast terms (a fixed table), so texts are read once; the hits of one text are
    settled in one fold."""
    known = skill_terms(skills)
    terms = F.broadcast(docs.sparkSession.createDataFrame(known, "term string, skill string, size int, rank int, words int"))
    longest = max(k[4] for k in known)
    words = docs.select("id", F.filter(F.split(F.lower(F.regexp_replace("text", WORD, " ")), " "), lambda w: w != "").alias("w"))
    at = F.sequence(F.lit(1), F.size("w"))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("term"), (i + n - 1 <= F.size("w")).alias("ok")))))
    hits = words.where(F.size("w") > 0).select("id", F.explode(runs).alias("r")).where("r.ok").select("id", "r.at", "r.n", F.col("r.term").alias("term")).join(terms.select("term", "skill", "size", "rank"), "term")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "rank", "at", "n", "term", "skill")))
    none = F.filter("hits", lambda x: F.lit(False))
    free = lambda taken, x: ~F.exists(taken, lambda y: (y.at < x.at + x.n) & (x.at < y.at + y.n))
    kept = F.aggregate("hits", none, lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    return hits.groupBy("id").agg(ordered.alias("hits")).select("id", F.explode(kept).alias("h")).select("id", "h.skill", "h.term", "h.at", "h.n")


def extract(docs: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """docs (id, text): (id, skill, n_mentions, terms): the forms in which the skill is named, sorted."""
    return mentions(docs, skills).groupBy("id", "skill").agg(F.count(F.lit(1)).alias("n_mentions"), F.array_sort(F.collect_set("term")).alias("terms"))


def with_implied(found: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """found (id, skill) and all that these skills imply; direct tells which were found themselves."""
    rows = [(a, b) for a, all_ in closure(skills).items() for b in all_]
    table = F.broadcast(found.sparkSession.createDataFrame(rows, "skill string, implied string"))
    return found.join(table, "skill").groupBy("id", F.col("implied").alias("skill")).agg(F.bool_or(F.col("skill") == F.col("implied")).alias("direct"))


def repository_languages(files: DataFrame) -> DataFrame:
    """files with language, category, size_bytes: (repo_id, language, share) over source files; an empty file counts one byte."""
    by = files.where(F.col("category").isin("candidate_code", "test_code") & F.col("language").isNotNull()).groupBy("repo_id", "language").agg(F.sum(F.greatest(F.lit(1), F.col("size_bytes"))).alias("n"))
    return by.select("repo_id", "language", (F.col("n") / F.sum("n").over(Window.partitionBy("repo_id"))).alias("share"))


def repository_evidence(files: DataFrame, dependencies: DataFrame, signals: DataFrame, texts: DataFrame, skills=fixed.SKILLS) -> DataFrame:
    """(repo_id, skill, source, weight): what each kind of evidence adds to each skill, one row a kind.

    files (repo_id, path, language, category, size_bytes); dependencies (repo_id, name); signals (repo_id, skill, strength): first-hand observations, see
    skill_signals(); texts (repo_id, source in topic, readme, description, text)."""
    spark, w = files.sparkSession, fixed.EVIDENCE_WEIGHTS
    table = lambda place, name: F.broadcast(spark.createDataFrame([(row[0], x) for row in skills for x in row[place]], f"skill string, {name} string"))
    share = repository_languages(files).join(table(6, "language"), "language").groupBy("repo_id", "skill").agg(F.max("share").alias("share"))
    language = share.select("repo_id", "skill", F.lit("language").alias("source"), F.least(F.lit(0.9), 0.35 + F.col("share") * 1.1).alias("weight"))
    # A declared package counts for a skill by its whole name, the part before a hyphen, the part after a slash, or its scope.
    name = F.col("name")
    parts = F.split(name, "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split(name, "/"))), lambda i: F.array_join(F.slice(F.split(name, "/"), i, F.size(F.split(name, "/"))), "/"))
    keys = F.array_distinct(F.concat(heads, tails, F.when(name.startswith("@"), F.array(F.expr("substring(name, 2)"))).otherwise(F.array().cast("array<string>"))))
    declared = dependencies.select("repo_id", "name").distinct()
    named = declared.withColumn("package", F.explode(keys)).join(table(4, "package"), "package").groupBy("repo_id", "skill").agg(F.countDistinct("name").alias("n"))
    packages = named.select("repo_id", "skill", F.lit("dependency").alias("source"), (w["dependency"] * F.least(F.lit(1.0), 0.6 + 0.2 * F.col("n"))).alias("weight"))
    module = F.replace(F.element_at(F.split(name, "/"), -1), F.lit("-"), F.lit("_"))
    once = lambda df, source: df.select("repo_id", "skill").distinct().select("repo_id", "skill", F.lit(source).alias("source"), F.lit(w[source]).alias("weight"))
    imports = once(declared.withColumn("module", module).join(table(5, "module"), "module"), "import")
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike("|".join(f"(?:{x})" for x in row[7])), row[0]) for row in skills if row[7]]))
    paths = once(files.select("repo_id", F.explode(hits).alias("skill")), "path")
    seen = signals.where("strength > 0").groupBy("repo_id", "skill").agg(F.max("strength").alias("s")).select("repo_id", "skill", F.lit("signal").alias("source"), (w["signal"] * F.least(F.lit(1.0), F.col("s"))).alias("weight"))
    named = extract(texts.select(F.struct("repo_id", "source").alias("id"), "text"), skills).select("id.repo_id", "skill", "id.source").distinct()
    weight = F.when(F.col("source") == "topic", w["topic"]).when(F.col("source") == "readme", w["readme"]).otherwise(w["description"])
    out = language.unionByName(packages).unionByName(imports).unionByName(paths).unionByName(seen)
    return out.unionByName(named.select("repo_id", "skill", "source", weight.alias("weight")))


def skill_signals(history: DataFrame, testing: DataFrame, files: DataFrame, layers: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo_id, skill, strength) of what was measured itself: history (repo_id), testing (repo_id, test_cases, ci_runs_tests), files (repo_id, path),
    layers (repo_id, layer), findings (repo_id, category)."""
    name, upper = F.lower(F.element_at(F.split("path", "/"), -1)), F.upper("path")
    rows = lambda df, skill, strength: df.select("repo_id", F.lit(skill).alias("skill"), (F.lit(strength) if isinstance(strength, float) else strength).alias("strength")).distinct()
    by_path = [
        ("docker", name.startswith("dockerfile") | F.lower("path").contains("docker-compose"), 1.0),
        ("research", F.col("path").endswith(".ipynb") | F.col("path").contains("/notebooks/") | F.col("path").startswith("notebooks/"), 0.8),
        ("open_source", upper.startswith("CONTRIBUTING"), 0.7),
    ]
    out = rows(history, "git", 1.0).unionByName(rows(testing.where("test_cases > 0"), "testing", F.least(F.lit(1.0), 0.5 + F.col("test_cases") / 60.0)))
    out = out.unionByName(rows(testing.where("ci_runs_tests"), "ci_cd", 1.0)).unionByName(rows(layers.where("layer = 'api_layer'"), "rest_api", 0.8)).unionByName(rows(findings.where("category = 'auth'"), "security", 0.5))
    for skill, holds, strength in by_path:
        out = out.unionByName(rows(files.where(holds), skill, strength))
    return out


def skill_strength(evidence: DataFrame) -> DataFrame:
    """evidence (repo_id, skill, source, weight): (repo_id, skill, strength in 0..1, sources)."""
    return evidence.groupBy("repo_id", "skill").agg(F.least(F.lit(1.0), F.sum("weight")).alias("strength"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def resume_consistency(claims: DataFrame, strengths: DataFrame, unclaimed_from: float = 0.5, most: int = 10) -> DataFrame:
    """claims (candidate_id, skill, expected), strengths (candidate_id, skill, strength): supported, partial or verify for each claim, and
    the strongest unclaimed skills as unclaimed."""
    judged = claims.join(strengths, ["candidate_id", "skill"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    state = F.when(F.col("strength") >= F.col("expected"), "supported").when(F.col("strength") >= F.col("expected") / 2, "partial").otherwise("verify")
    free = strengths.where(F.col("strength") >= unclaimed_from).join(claims, ["candidate_id", "skill"], "left_anti")
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("strength"), "skill"))
    top = free.withColumn("place", place).where(F.col("place") <= most).select("candidate_id", "skill", "strength", F.lit("unclaimed").alias("state"))
    return judged.select("candidate_id", "skill", "strength", state.alias("state")).unionByName(top)
