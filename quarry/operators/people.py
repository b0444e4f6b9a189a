"""Résumés, interview questions and answers."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, words
from . import skills

QUALIFIER = r"^[^\S\n]*[\(\[\-–:][^\S\n]*([a-z ]{3,20})"


def level_in(fragment: Column) -> Column:
    """struct(level, floor) of the longest proficiency word in a fragment; null without one."""
    ranked = sorted(fixed.PROFICIENCY.items(), key=lambda kv: -len(kv[0]))
    return reduce(lambda out, kv: F.when(fragment.contains(kv[0]), F.struct(F.lit(kv[0]).alias("level"), F.lit(kv[1]).alias("floor"))).otherwise(out), reversed(ranked), F.lit(None).cast("struct<level:string,floor:double>"))


def resume_sections(resumes: DataFrame) -> DataFrame:
    """resumes (candidate_id, text): (candidate_id, section, line_no, line) of lines that aren't blank; section is the heading above, header before the first."""
    rows = resumes.select("candidate_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heading = F.when(F.col("line").rlike(fixed.RESUME_HEADINGS), F.lower(F.regexp_extract("line", fixed.RESUME_HEADINGS, 1)))
    placed = rows.withColumns({"heading": heading, "section": F.coalesce(F.last(heading, ignorenulls=True).over(Window.partitionBy("candidate_id").orderBy("line_no")), F.lit("header"))})
    return placed.where("heading is null and trim(line) <> ''").select("candidate_id", "section", "line_no", "line")


def resume_entries(resumes: DataFrame) -> DataFrame:
    """(candidate_id, kind in project, experience, education, achievement; entry): the lines of such sections without their marks, if long enough."""
    s = F.col("section")
    kind = F.when(s.contains("project"), "project").when(s.rlike("experience|employment|internship"), "experience").when(s.contains("education"), "education").when(s.rlike("achievement|certification|publication"), "achievement")
    entry = F.trim(F.regexp_replace("line", r"^\s*[-*•●▪]\s*", ""))
    least = F.when(F.col("kind").isin("project", "experience"), 8).otherwise(4)
    return resume_sections(resumes).withColumns({"kind": kind, "entry": entry}).where(F.col("kind").isNotNull() & (F.length("entry") > least)).select("candidate_id", "kind", "line_no", "entry")


def resume_skills(resumes: DataFrame, taxonomy=fixed.SKILLS) -> DataFrame:
    """resumes (candidate_id, text): (candidate_id, skill, n_mentions, claimed_level, expected). A level right after a mention counts for it, as in "Python (Advanced)"; a level
    elsewhere on a line only if the line names a single skill. Of several the strongest holds; without one the level is null and a neutral floor is expected."""
    rows = resumes.select("candidate_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("low", F.lower("line"))
    named = skills.mentions(rows.select(F.struct("candidate_id", "line_no").alias("id"), F.col("line").alias("text")), taxonomy).select("id.candidate_id", "id.line_no", "skill", "term")
    single = named.groupBy("candidate_id", "line_no").agg((F.countDistinct("skill") == 1).alias("single"))
    met = named.join(single, ["candidate_id", "line_no"]).join(rows.select("candidate_id", "line_no", "low"), ["candidate_id", "line_no"])
    surface = F.regexp_replace(F.replace("term", F.lit("+"), F.lit("\\+")), r"[ _]", r"[^a-z0-9+#]+")
    after = F.expr("regexp_extract(low, concat('(^|[^a-z0-9+#])', surface, '([^a-z0-9+#].*)$'), 2)")
    right = level_in(F.regexp_extract(F.substring(after, 1, 24), QUALIFIER, 1))
    level = F.coalesce(right, F.when(F.col("single"), level_in(F.col("low"))))
    best = met.withColumn("surface", surface).withColumn("level", level).groupBy("candidate_id", "skill").agg(F.count(F.lit(1)).alias("n_mentions"), F.max_by("level", "level.floor").alias("level"))
    return best.select("candidate_id", "skill", "n_mentions", F.col("level.level").alias("claimed_level"), F.coalesce("level.floor", F.lit(fixed.UNKNOWN_FLOOR)).alias("expected"))


# (category, condition, question, difficulty, expected points) over a row a repository of measured facts.
_n = lambda name: F.coalesce(F.col(name), F.lit(0))
QUESTIONS = [
    ("code_specific", lambda: _n("max_complexity") > 1, lambda: F.format_string("`%s` in `%s` is the most complex function here, with a complexity of %d. What does it do, and why has it this shape?", "complex_symbol", "complex_path", _n("max_complexity").cast("int")), "medium", ["what the function is responsible for", "why the branching is necessary", "how it is tested or verified"]),
    ("code_specific", lambda: _n("duplication") > 0.1, lambda: F.format_string("About %.0f%% of the code blocks are duplicated. Where does that come from, and which would you factor out first?", _n("duplication") * 100.0), "medium", ["explains the origin of the duplication", "tells repetition by chance from repetition on purpose", "proposes a concrete abstraction"]),
    ("architecture", lambda: _n("hub_fan_in") > 0, lambda: F.format_string("`%s` is imported by %d other modules, more than anything else. How would you change its interface without breaking its callers?", "hub", _n("hub_fan_in").cast("int")), "hard", ["states a single clear responsibility", "sees how far a change of the interface reaches", "describes a migration or deprecation path"]),
    ("architecture", lambda: _n("core_layers") == 0, lambda: F.lit("No conventional layers were found. How is the code organised, and how would you restructure it if it doubled?"), "medium", ["explains the current organisation", "proposes a structure that scales", "says which caller fails first"]),
    ("architecture", lambda: _n("core_layers") > 0, lambda: F.format_string("The repository tells %d layers apart. What rule decides where a new piece of logic goes?", _n("core_layers").cast("int")), "medium", ["states which logic belongs where", "gives a concrete example", "acknowledges where the codebase breaks the rule"]),
    ("debugging", lambda: _n("handling") < 0.05, lambda: F.lit("There is almost no error handling. Pick the operation most likely to fail: what happens today when it does?"), "medium", ["picks one call that can fail", "traces the current failure path", "proposes handling with a visible consequence"]),
    ("security", lambda: _n("pattern_findings") > 0, lambda: F.format_string("%d insecure pattern(s) were flagged. Which would you fix first, and how would you show that it is fixed?", _n("pattern_findings").cast("int")), "medium", ["explains how it could be exploited", "names a concrete fix", "verifies the fix"]),
    ("system_design", lambda: _n("source_files") > 0, lambda: F.format_string("With %d source files today, what would you change first for a hundred times the load?", _n("source_files").cast("int")), "hard", ["finds what is full first", "proposes a measurable change", "considers the trade-offs"]),
    ("testing", lambda: _n("test_cases") == 0, lambda: F.lit("No tests were detected. Which module would you test first, and what would the first test assert?"), "medium", ["names a module and a behaviour", "states an assertion", "explains the choice"]),
    ("testing", lambda: _n("test_cases") > 0, lambda: F.format_string("There are %d test cases. Which behaviour that matters is not covered by them?", _n("test_cases").cast("int")), "medium", ["names an uncovered behaviour", "explains the risk", "sketches the test"]),
    ("ownership", lambda: _n("commit_count") > 0, lambda: F.format_string("The history has %d commits on %d days. Which change taught you most, and what did it replace?", _n("commit_count").cast("int"), _n("active_days").cast("int")), "easy", ["refers to a real change", "compares before and after", "reflects on the decision"]),
]


def interview_questions(facts: DataFrame, most: int = 12) -> DataFrame:
    """facts: a row a repository with the columns that QUESTIONS read: (repo_id, place, category, question, difficulty, expected_points). Each names a measured fact; a repository of
    which nothing holds gets one open question."""
    rows = F.array_compact(F.array(*[F.when(cond(), F.struct(F.lit(i).alias("at"), F.lit(c).alias("category"), text().alias("question"), F.lit(d).alias("difficulty"), F.array(*[F.lit(p) for p in points]).alias("expected_points"))) for i, (c, cond, text, d, points) in enumerate(QUESTIONS)]))
    open_ = F.array(F.struct(F.lit(0).alias("at"), F.lit("fundamentals").alias("category"), F.concat(F.lit("Walk me through what "), F.col("repo_id").cast("string"), F.lit(" does and how its pieces fit together.")).alias("question"), F.lit("easy").alias("difficulty"), F.array(F.lit("purpose of the project"), F.lit("main components"), F.lit("how data flows")).alias("expected_points")))
    return facts.select("repo_id", F.posexplode(F.slice(F.when(F.size(rows) > 0, rows).otherwise(open_), 1, most)).alias("p", "q")).select("repo_id", (F.col("p") + 1).alias("place"), "q.category", "q.question", "q.difficulty", "q.expected_points")


def answer_facts(files: DataFrame, found: DataFrame, testing: DataFrame, most: int = 400) -> DataFrame:
    """files (repo_id, path, language), found (repo_id, symbol), testing (repo_id, test_cases, ci_runs_tests): a row a repository with languages, and the first `most` file names and symbols, in lower case."""
    def first(df: DataFrame, value: Column, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("repo_id").orderBy("v"))
        rows = df.select("repo_id", value.alias("v")).where("v is not null").distinct().withColumn("place", place).where(F.col("place") <= most)
        return rows.groupBy("repo_id").agg(F.array_sort(F.collect_list("v")).alias(name))

    names = first(files, F.lower(F.element_at(F.split("path", "/"), -1)), "files")
    symbols = first(found, F.lower("symbol"), "symbols")
    languages = first(files, F.lower("language"), "languages")
    return testing.select("repo_id", "test_cases", "ci_runs_tests").join(names, "repo_id", "left").join(symbols, "repo_id", "left").join(languages, "repo_id", "left")


def assess_answers(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer_text, expected_points, anchors: file names and symbols that the question names, files, symbols, languages, test_cases, ci_runs_tests; the last five as of
    answer_facts(), null where not known): (answer_id, score, and the five dimensions it weighs), 0 to 100. An answer of fewer than five words scores zero.

    It measures what a text covers, names, contradicts and how it is built; it doesn't judge whether an explanation is right."""
    none = F.array().cast("array<string>")
    low, own = F.lower(F.coalesce("answer_text", F.lit(""))), words(F.coalesce("answer_text", F.lit("")))
    rows = answers.withColumns({"low": low, "own": own, "n": F.size(own)})

    def covers(point: Column) -> Column:
        content = F.filter(F.regexp_extract_all(F.lower(point), F.lit("([a-z][a-z0-9_]+)"), 1), lambda w: F.length(w) > 3)
        hits = F.size(F.filter(content, lambda w: F.instr(F.col("low"), w) > 0))
        return F.when(F.size(content) == 0, F.instr(F.col("low"), F.lower(point)) > 0).otherwise(hits >= F.greatest(F.lit(1), F.floor(F.size(content) / 2)))

    points = F.coalesce("expected_points", none)
    covered = F.size(F.filter(points, covers))
    correct = F.when(F.size(points) > 0, 100.0 * covered / F.size(points)).otherwise(55.0)
    stated = lambda names: F.filter(F.array_distinct(F.transform(F.coalesce(names, none), F.lower)), lambda x: (x != "") & (F.instr(F.col("low"), x) > 0))
    anchors = stated(F.col("anchors"))
    others = F.array_except(stated(F.concat(F.coalesce("files", none), F.coalesce("symbols", none))), anchors)
    concrete = F.col("answer_text").rlike(r"`[^`]+`|\w+\.\w{1,4}\b|line \d+")
    specific = clamp(30.0 * F.size(anchors) + 12.0 * F.size(others) + F.when(concrete, 18.0).otherwise(0.0))
    claims = [F.when(F.col("low").rlike(rf"\bwritten in {x}\b") & ~F.array_contains(F.coalesce("languages", none), x), 1).otherwise(0) for x in ("python", "typescript", "javascript", "java", "go", "rust")]
    wrong = F.when((F.col("test_cases") == 0) & F.col("low").rlike(r"\b(we|i) (have|wrote|added) (unit )?tests\b"), 1).otherwise(0) + F.when(~F.coalesce("ci_runs_tests", F.lit(False)) & F.col("low").contains("ci runs"), 1).otherwise(0) + F.when(reduce(lambda a, b: a + b, claims) > 0, 1).otherwise(0)
    count = lambda marks: reduce(lambda a, b: a + b, [F.col("low").contains(m).cast("int") for m in marks])
    depth = clamp(F.least(F.lit(100.0), count(fixed.DEPTH_MARKERS) * 18.0 + F.least(F.lit(40.0), F.col("n") / 4.0)) - count(fixed.HEDGE_MARKERS) * 25.0)
    mean = F.col("n") / F.greatest(F.lit(1), F.regexp_count("answer_text", F.lit(r"[.!?]+")))
    clear = clamp(45.0 + count(fixed.STRUCTURE_MARKERS) * 10.0 + F.when(mean.between(8, 30), 20.0).otherwise(0.0) + F.when(F.col("n") >= 40, 10.0).otherwise(0.0))
    parts = {"technical_correctness": correct, "specificity": specific, "repository_consistency": F.when(wrong > 0, clamp(100.0 - 35.0 * wrong)).otherwise(80.0), "depth_of_understanding": depth, "communication": clear}
    scored = rows.select("answer_id", "n", *[F.when(F.col("n") < 5, 0.0).otherwise(v).alias(k) for k, v in parts.items()])
    return scored.select("answer_id", clamp(reduce(lambda a, b: a + b, [w * F.col(k) for k, w in fixed.ANSWER_WEIGHTS.items()])).alias("score"), *parts)


def session_scores(assessed: DataFrame) -> DataFrame:
    """assessed (session_id, score, reviewer_score, the five dimensions): (session_id, score, n, reviewed and each dimension's mean). A reviewer's score goes before the measured one."""
    return assessed.groupBy("session_id").agg(F.avg(F.coalesce("reviewer_score", "score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"), F.count("reviewer_score").alias("reviewed"), *[F.avg(k).alias(k) for k in fixed.ANSWER_WEIGHTS])
