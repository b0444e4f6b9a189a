"""Manifest readers and dependency measures."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp
from .classify import base_name

SCHEMA = ["repo_id", "manifest", "ecosystem", "name", "version_spec", "dev"]


def package_json(files: DataFrame) -> DataFrame:
    kinds = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    parsed = files.where(base_name("path") == "package.json").withColumn("j", F.from_json("text", kinds))
    one = lambda name, dev: parsed.select("repo_id", F.col("path").alias("manifest"), F.lit("npm").alias("ecosystem"), F.explode(f"j.{name}").alias("name", "version_spec"), F.lit(dev).alias("dev"))
    return one("dependencies", False).unionByName(one("devDependencies", True)).unionByName(one("peerDependencies", False))


def requirements(files: DataFrame) -> DataFrame:
    name = base_name("path")
    lines = files.where(name.startswith("requirements") & name.endswith(".txt")).select("repo_id", F.col("path").alias("manifest"), F.explode(F.split("text", "\n")).alias("line"))
    bare = F.trim(F.regexp_replace("line", r"#.*$", ""))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$"
    rows = lines.withColumn("bare", bare).where("bare <> '' and not startswith(bare, '-')")
    return rows.select("repo_id", "manifest", F.lit("pypi").alias("ecosystem"), F.regexp_extract("bare", pattern, 1).alias("name"), F.trim(F.regexp_extract("bare", pattern, 2)).alias("version_spec"), F.lower("manifest").rlike("dev|test").alias("dev")).where("name <> ''")


def _sections(files: DataFrame, manifest: str) -> DataFrame:
    lines = files.where(base_name("path") == manifest).select("repo_id", F.col("path").alias("manifest"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = F.when(F.col("line").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+\s*$", 1))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("repo_id", "manifest").orderBy("at")))


def cargo(files: DataFrame) -> DataFrame:
    """[dependencies] and [dev-dependencies], and tables of their own such as [dependencies.name]."""
    every = _sections(files, "Cargo.toml")
    spec = F.regexp_extract("line", r'"([^"]*)"', 1)
    rows = every.where(F.col("section").isin("dependencies", "dev-dependencies")).select("repo_id", "manifest", F.regexp_extract("line", r"^\s*([A-Za-z0-9_-]+)\s*=", 1).alias("name"), spec.alias("version_spec"), (F.col("section") == "dev-dependencies").alias("dev"))
    own = r"^(dev-)?dependencies\.([A-Za-z0-9_-]+)$"
    tables = every.where(F.col("section").rlike(own)).groupBy("repo_id", "manifest", "section").agg(F.coalesce(F.max(F.when(F.col("line").rlike(r"^\s*version\s*="), spec)), F.lit("")).alias("version_spec"))
    tables = tables.select("repo_id", "manifest", F.regexp_extract("section", own, 2).alias("name"), "version_spec", F.col("section").startswith("dev-").alias("dev"))
    return rows.unionByName(tables).where("name <> ''").select("repo_id", "manifest", F.lit("cargo").alias("ecosystem"), "name", "version_spec", "dev")


def pyproject(files: DataFrame) -> DataFrame:
    """project.dependencies and optional groups, as lists on one line or several (groups for dev, test and lint count as such), and poetry's tables without python."""
    rows = _sections(files, "pyproject.toml")
    key = F.when(F.col("line").rlike(r"^\s*[A-Za-z0-9_-]+\s*="), F.regexp_extract("line", r"^\s*([A-Za-z0-9_-]+)\s*=", 1))
    keyed = rows.withColumn("key", F.last(key, ignorenulls=True).over(Window.partitionBy("repo_id", "manifest", "section").orderBy("at")))
    some = keyed.where("(section = 'project' and key = 'dependencies') or section = 'project.optional-dependencies'")
    items = F.regexp_extract_all(F.regexp_replace("line", r"^\s*[A-Za-z0-9_-]+\s*=\s*", ""), F.lit("[\"']([^\"']+)[\"']"), 1)
    listed = some.select("repo_id", "manifest", F.coalesce((F.col("section") != "project") & F.lower("key").rlike("dev|test|lint"), F.lit(False)).alias("dev"), F.explode(items).alias("item"))
    pattern = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$"
    project = listed.select("repo_id", "manifest", F.lit("pypi").alias("ecosystem"), F.regexp_extract("item", pattern, 1).alias("name"), F.trim(F.regexp_extract("item", pattern, 2)).alias("version_spec"), "dev").where("name <> ''")
    poetry = rows.where(F.col("section").rlike(r"^tool\.poetry(\..*)?\.?dependencies$|^tool\.poetry\.group\..*\.dependencies$"))
    name = F.regexp_extract("line", r"^\s*([A-Za-z0-9_.-]+)\s*=", 1)
    poetry = poetry.select("repo_id", "manifest", F.lit("pypi").alias("ecosystem"), name.alias("name"), F.regexp_extract("line", r'"([^"]*)"', 1).alias("version_spec"), F.col("section").rlike(r"dev|test|lint").alias("dev")).where("name <> '' and name <> 'python'")
    return project.unionByName(poetry)


def go_mod(files: DataFrame) -> DataFrame:
    lines = files.where(base_name("path") == "go.mod").select("repo_id", F.col("path").alias("manifest"), F.explode(F.split("text", "\n")).alias("line"))
    pattern = r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)"
    return lines.select("repo_id", "manifest", F.lit("go").alias("ecosystem"), F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version_spec"), F.lit(False).alias("dev")).where("name <> ''")


def inventory(files: DataFrame) -> DataFrame:
    """All manifests of all repositories as dependency rows."""
    return package_json(files).unionByName(requirements(files)).unionByName(cargo(files)).unionByName(pyproject(files)).unionByName(go_mod(files))


def is_pinned(spec="version_spec") -> Column:
    c = F.coalesce(F.col(spec), F.lit(""))
    return (c != "") & ~c.rlike(r"^[~^>*]|^latest$")


def dependency_score(dependencies: DataFrame, locked: DataFrame) -> DataFrame:
    """0.4 of the pinned share, 0.35 for a lock file (100 or 35), 0.25 for few runtime dependencies (100 up to 40, then 0.8 less each)."""
    by = dependencies.groupBy("repo_id").agg(F.avg(is_pinned().cast("int")).alias("pinned"), F.count_if(~F.col("dev")).alias("runtime"), F.count(F.lit(1)).alias("n"))
    lock = locked.select("repo_id").distinct().withColumn("lock", F.lit(100.0))
    size = F.when(F.col("runtime") <= 40, 100.0).otherwise(clamp(100.0 - 0.8 * (F.col("runtime") - 40)))
    return by.join(lock, "repo_id", "left").select("repo_id", "n", (0.4 * 100 * F.col("pinned") + 0.35 * F.coalesce("lock", F.lit(35.0)) + 0.25 * size).alias("score"))


def categories(names: DataFrame, markers: dict[str, str] = fixed.DEPENDENCY_CATEGORIES) -> DataFrame:
    """names (repo_id, name): (repo_id, category, name) where a marker is the name, its beginning before -, its scope, or part of its last segment."""
    last = F.element_at(F.split("name", "/"), -1)
    hit = lambda m: (F.col("name") == m) | F.col("name").startswith(f"{m}-") | F.col("name").startswith(f"@{m}/") | last.contains(m)
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [hit(m) for m in ms.split()]), c) for c, ms in markers.items()]))
    return names.select("repo_id", "name").distinct().select("repo_id", F.explode(found).alias("category"), "name")
