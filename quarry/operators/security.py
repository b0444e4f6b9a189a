"""Secrets and insecure code, one scan over lines: every rule is a column, so no rule join and no second pass."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, entropy, masked
from .classify import is_test_path

LONGEST_LINE = 4000
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]|xxxx|dummy|\*\*\*|<[a-z_]+>|\$\{|process\.env|os\.environ)"


def scan_secrets(lines: DataFrame, min_entropy: float = 3.2) -> DataFrame:
    """(repo_id, path, line_no, rule_id, severity, confidence, masked_value, value_hash): every hit of each rule, in lines of any length. Placeholders are
    passed over hit by hit; a generic value needs min_entropy bits a character; example and test paths lower the confidence."""

    def hits(rule: str, pattern: str, severity: str, confidence: float) -> Column:
        values = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), v.alias("value")))

    found = lines.select("repo_id", "path", "line_no", F.explode(F.concat(*[hits(*x) for x in fixed.SECRETS])).alias("h")).select("repo_id", "path", "line_no", "h.*")
    inner = F.regexp_extract("value", "[\"']([^\"']*)[\"']", 1)
    real = ~F.col("value").rlike(PLACEHOLDER) & ((F.col("rule_id") != "generic_secret") | (entropy(inner) >= min_entropy))
    doubtful = is_test_path("path") | F.lower("path").contains("example")
    value = F.when(F.col("rule_id") == "generic_secret", inner).otherwise(F.col("value"))
    return found.where(real).select("repo_id", "path", "line_no", "rule_id", "severity", (F.col("confidence") * F.when(doubtful, 0.5).otherwise(1.0)).alias("confidence"), masked(value).alias("masked_value"), F.sha2(value, 256).alias("value_hash"))


def scan_patterns(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, line_no, rule_id, category, severity, confidence): rules over code and configuration, by language; comment lines and
    lines over LONGEST_LINE are passed over; test paths count 0.6."""
    scope = files.where(F.col("category").isin(fixed.CODE_CATEGORIES)).select("repo_id", "path", "language")
    code = lines.where((F.length("line") <= LONGEST_LINE) & ~F.col("line").rlike(r"^\s*(#|//|\*)")).join(scope, ["repo_id", "path"])

    def rule(r, c, p, s, conf, langs) -> Column:
        holds = F.col("line").rlike(p) if langs is None else F.col("line").rlike(p) & F.coalesce(F.col("language").isin(langs), F.lit(False))
        return F.when(holds, F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(conf).alias("confidence")))

    hits = code.select("repo_id", "path", "line_no", F.explode(F.array_compact(F.array(*[rule(*x) for x in fixed.INSECURE]))).alias("h")).select("repo_id", "path", "line_no", "h.*")
    return hits.withColumn("confidence", F.col("confidence") * F.when(is_test_path("path"), 0.6).otherwise(1.0))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """Of findings with the same file, line and value the surest; ties to the first rule."""
    place = F.row_number().over(Window.partitionBy("repo_id", "path", "line_no", "value_hash").orderBy(F.desc("confidence"), "rule_id"))
    return findings.withColumn("place", place).where("place = 1").drop("place")


def confidence_weight(c="confidence") -> Column:
    return F.greatest(F.lit(0.0), (F.col(c) - 0.3) / 0.7)


def security_score(findings: DataFrame, repositories: DataFrame) -> DataFrame:
    """100 less penalties by severity and confidence; repositories without findings have 100."""
    penalty = reduce(lambda out, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(out), fixed.PENALTIES.items(), F.lit(0.0))
    lost = findings.groupBy("repo_id").agg(F.sum(penalty * confidence_weight()).alias("lost"), F.count(F.lit(1)).alias("n_findings"))
    return repositories.join(lost, "repo_id", "left").select("repo_id", clamp(100.0 - F.coalesce("lost", F.lit(0.0))).alias("score"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("n"))
