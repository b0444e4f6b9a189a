"""The whole report of each evaluation: one nested row, its sections cut to their best entries before they are gathered, as JSON or Markdown."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATEMENT = "Figures on assistance are estimates from signals in repositories. They don't show that any given code was written by a tool, and using tools is no misconduct."
DISCLAIMER = "This report supports a decision and makes none. Scores measure what the analysed repositories show; what isn't shown isn't thereby absent."


@dataclass(frozen=True)
class Section:
    """A list in the report: the table it comes from, the key that rows and evaluations share, the rows that count, their order, how many at most, and the fields of each."""

    name: str
    table: str
    key: str
    fields: tuple[str, ...]
    order: tuple[Column, ...]
    most: int
    where: str = "true"


def _sections() -> list[Section]:
    sure, evidence = F.desc_nulls_last("confidence"), ("claim", "category", "confidence", "details")
    return [
        Section("requirements", "requirements", "job_id", ("label", "required", "importance"), (F.desc("importance"), F.asc("label")), 60),
        Section("scores", "scores", "evaluation_id", ("category", "score", "weight", "confidence"), (F.desc_nulls_last("weight"), F.asc("category")), 20),
        Section("strengths", "evidence", "evaluation_id", evidence, (sure, F.asc("claim")), 40, "supports = 'strength'"),
        Section("weaknesses", "evidence", "evaluation_id", evidence, (sure, F.asc("claim")), 40, "supports = 'weakness'"),
        Section("ownership_evidence", "evidence", "evaluation_id", evidence, (sure, F.asc("claim")), 20, "category = 'ownership'"),
        Section("assistance_evidence", "evidence", "evaluation_id", evidence, (sure, F.asc("claim")), 20, "category = 'ai_utilization'"),
        Section("external_matches", "similarity", "repo_id", ("source", "matched", "similarity"), (F.desc("similarity"), F.asc("source"), F.asc("matched")), 10, "scope = 'external'"),
        Section("security", "findings", "repo_id", ("title", "severity", "path", "line_no", "confidence"), (sure, F.asc("path"), F.asc("line_no"), F.asc("title")), 25),
        Section("recommendations", "recommendations", "evaluation_id", ("title", "impact", "gain"), (F.desc_nulls_last("gain"), F.asc("title")), 30),
        Section("questions", "questions", "evaluation_id", ("category", "question"), (F.asc("place"),), 20),
        Section("sessions", "sessions", "evaluation_id", ("session_id", "status", "score", "answers"), (F.desc("created_at"), F.asc("session_id")), 20),
        Section("notes", "notes", "evaluation_id", ("author", "body", "created_at"), (F.desc("created_at"), F.asc("author"), F.asc("body")), 50),
        Section("overrides", "overrides", "evaluation_id", ("category", "old_score", "new_score", "rationale"), (F.desc("created_at"), F.asc("category")), 50),
    ]


def gathered(rows: DataFrame, section: Section) -> DataFrame:
    """(key, section's name): an array of the first `most` rows of each key. Rows beyond are dropped before any list is made, so a key with very many rows makes no large one."""
    kept = rows.where(section.where).where(F.col(section.key).isNotNull())
    place = F.row_number().over(Window.partitionBy(section.key).orderBy(*section.order))
    fields = [c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in section.fields]
    best = kept.withColumn("_place", place).where(F.col("_place") <= section.most)
    entries = F.sort_array(F.collect_list(F.struct("_place", F.struct(*fields).alias("entry"))))
    return best.groupBy(section.key).agg(F.transform(entries, lambda x: x["entry"]).alias(section.name))


def full_report(evaluations: DataFrame, tables: Mapping[str, DataFrame], private: bool = False) -> DataFrame:
    """evaluations (evaluation_id, repo_id, candidate_id, job_id, any more); tables by name, any of: repositories (repo_id), candidates (candidate_id), jobs (job_id), whose first row by text describes the evaluation's; and those of the
    sections. Null or absent tables give null descriptions and empty sections. Only with `private` are notes shown that aren't visible to the candidate."""
    out = evaluations
    for name, key in (("repositories", "repo_id"), ("candidates", "candidate_id"), ("jobs", "job_id")):
        about = name.removesuffix("ies") + "y" if name == "repositories" else name.removesuffix("s")
        if name in tables:
            one = tables[name].where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in tables[name].columns if c != key])).alias(about))
            out = out.join(one, key, "left")
        else:
            out = out.withColumn(about, F.lit(None).cast("string"))
    for section in _sections():
        if section.table in tables:
            rows = tables[section.table]
            if section.table == "notes" and not private:
                rows = rows.where("visible_to_candidate")
            out = out.join(gathered(rows, section), section.key, "left")
        else:
            out = out.withColumn(section.name, F.lit(None).cast(f"array<struct<{','.join(f'{c}:string' for c in section.fields)}>>"))
    filled = {s.name: F.coalesce(s.name, F.filter(F.array_repeat(F.get(s.name, 0), 1), lambda x: F.lit(False))) for s in _sections()}
    return out.withColumns(filled | {"statement": F.lit(STATEMENT), "disclaimer": F.lit(DISCLAIMER)})


def as_json(reports: DataFrame) -> DataFrame:
    return reports.select("evaluation_id", F.to_json(F.struct("*")).alias("report"))


def _number(value: Column, digits: int = 0) -> Column:
    return F.coalesce(F.format_number(value.cast("double"), digits), F.lit("not measured"))


def as_markdown(reports: DataFrame) -> DataFrame:
    """(evaluation_id, report): a heading, the overall figures that the table has, and a part for each section; empty ones say so."""
    share = lambda x: F.coalesce(F.concat(F.round(x.cast("double") * 100).cast("int").cast("string"), F.lit("%")), F.lit("not measured"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    claim = lambda e: F.concat(F.lit("- **"), text(e["claim"]), F.lit("** (confidence "), share(e["confidence"]), F.lit(")"))
    lines = {
        "requirements": ("Requirements", lambda e: F.concat(F.lit("- "), text(e["label"]), F.when(e["required"].cast("boolean"), " (required)").otherwise(""))),
        "scores": ("Scores", lambda e: F.concat(F.lit("| "), text(e["category"]), F.lit(" | "), _number(e["score"], 1), F.lit(" | "), share(e["weight"]), F.lit(" | "), share(e["confidence"]), F.lit(" |"))),
        "strengths": ("Strengths", claim),
        "weaknesses": ("Weaknesses", claim),
        "ownership_evidence": ("Ownership", claim),
        "assistance_evidence": ("Assistance", claim),
        "external_matches": ("Similarity", lambda e: F.concat(F.lit("- "), text(e["source"]), F.lit(" ~ "), text(e["matched"]), F.lit(": "), share(e["similarity"]))),
        "security": ("Security", lambda e: F.concat(F.lit("- "), text(e["severity"]), F.lit(": "), text(e["title"]), F.lit(" in "), text(e["path"]), F.lit(":"), text(e["line_no"]))),
        "recommendations": ("Recommendations", lambda e: F.concat(F.lit("- "), text(e["title"]), F.lit(" ("), text(e["impact"]), F.lit(")"))),
        "questions": ("Interview questions", lambda e: F.concat(F.lit("- "), text(e["question"]))),
        "sessions": ("Verification sessions", lambda e: F.concat(F.lit("- "), text(e["session_id"]), F.lit(", "), text(e["status"]), F.lit(": "), _number(e["score"], 1))),
        "notes": ("Reviewers' notes", lambda e: F.concat(F.lit("- "), text(e["author"]), F.lit(": "), text(e["body"]))),
        "overrides": ("Overrides", lambda e: F.concat(F.lit("- "), text(e["category"]), F.lit(": "), _number(e["old_score"], 1), F.lit(" to "), _number(e["new_score"], 1))),
    }
    parts = [F.concat(F.lit("# Evaluation "), F.col("evaluation_id").cast("string"))]
    for name in ("overall", "job_match", "ownership", "likelihood", "utilization", "verification_status"):
        if name in reports.columns:
            shown = text(F.col(name)) if dict(reports.dtypes)[name] == "string" else _number(F.col(name), 1)
            parts.append(F.concat(F.lit(f"- {name.replace('_', ' ')}: "), shown))
    for name, (title, line) in lines.items():
        head = f"\n## {title}\n" + ("\n| category | score | weight | confidence |\n|---|---|---|---|" if name == "scores" else "")
        parts += [F.lit(head), F.when(F.size(name) > 0, F.array_join(F.transform(name, line), "\n")).otherwise("None recorded.")]
    return reports.select("evaluation_id", F.concat_ws("\n", *parts, F.concat(F.lit("\n"), F.col("statement")), "disclaimer").alias("report"))
