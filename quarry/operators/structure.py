"""Entities found by their header lines, and measures of structure, names, documentation, layers and frameworks."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import clamp, dense_cosine, identifier_words, without_comments
from ..tables import saved
from . import braces


def _levels(lines: DataFrame) -> DataFrame:
    """Each line once for each indentation that a header of its file has: (repo_id, path, line_no, line, indent, level, is_head, at, at_head).

    at: the last line so far that is indented no deeper than level, at_head: whether that line is a header at just that level; the line then is in its body.
    Rows are lines times the few levels of headers, whatever the number of headers."""
    rows = lines.withColumn("indent", F.when(F.trim("line") != "", F.length(F.regexp_extract("line", r"^(\s*)", 1))))
    head = F.col("indent").isNotNull() & F.col("line").rlike(fixed.HEADER)
    rows = rows.withColumn("is_head", head)
    levels = rows.where("is_head").groupBy("repo_id", "path").agg(F.collect_set("indent").alias("levels"))
    spread = rows.join(levels, ["repo_id", "path"]).withColumn("level", F.explode("levels")).drop("levels")
    so_far = Window.partitionBy("repo_id", "path", "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.when(F.col("indent") <= F.col("level"), F.struct(F.col("line_no").alias("at"), (F.col("is_head") & (F.col("indent") == F.col("level"))).alias("head")))
    return spread.withColumn("last", F.last(stop, ignorenulls=True).over(so_far)).withColumns({"at": F.col("last.at"), "at_head": F.coalesce("last.head", F.lit(False))}).drop("last")


def bodies(lines: DataFrame) -> DataFrame:
    """(repo_id, path, start_line, line_no, line, indent): the lines of each entity, its header among them. A header line opens an entity; it ends before the next
    line that is indented no deeper, or with the file's last line that isn't blank."""
    last = F.max(F.when(F.trim("line") != "", F.col("line_no"))).over(Window.partitionBy("repo_id", "path"))
    within = lines.withColumn("last_line", last).where("line_no <= last_line").drop("last_line")
    return _levels(within).where("at_head").select("repo_id", "path", F.col("at").alias("start_line"), "line_no", "line", "indent")


def entities(lines: DataFrame) -> DataFrame:
    """(repo_id, path, symbol, kind, start_line, end_line, n_params, has_doc, parent): see bodies(). n_params: names between the brackets of the header line, self left
    out; has_doc: the first line after the header that isn't blank opens a text in three quotes, or a comment line stands right above the header;
    parent: the innermost entity around it, by its first line."""
    body = bodies(lines)
    text = F.col("line")
    above = F.lag("line").over(Window.partitionBy("repo_id", "path").orderBy("line_no"))
    heads = lines.withColumn("above", above).where(text.rlike(fixed.HEADER)).select("repo_id", "path", F.col("line_no").alias("start_line"), F.regexp_extract(text, fixed.HEADER, 2).alias("kind"), F.regexp_extract(text, fixed.HEADER, 3).alias("symbol"), F.regexp_extract(text, r"\(([^)]*)\)?", 1).alias("params"), F.coalesce(F.col("above").rlike(fixed.COMMENT_LINE), F.lit(False)).alias("commented"))
    first = F.min_by("line", F.when((F.col("line_no") > F.col("start_line")) & F.col("indent").isNotNull(), F.col("line_no")))
    ends = body.groupBy("repo_id", "path", "start_line").agg(F.max("line_no").alias("end_line"), first.alias("first"))
    around = body.where("line_no > start_line").groupBy("repo_id", "path", "line_no").agg(F.max("start_line").alias("parent")).withColumnRenamed("line_no", "start_line")
    names = F.filter(F.transform(F.split("params", ","), F.trim), lambda x: (x != "") & ~x.isin("self", "cls", "this"))
    doc = F.coalesce(F.col("first").rlike(fixed.DOC_OPEN), F.lit(False)) | F.col("commented")
    whole = heads.join(ends, ["repo_id", "path", "start_line"]).join(around, ["repo_id", "path", "start_line"], "left")
    return whole.select("repo_id", "path", "symbol", "kind", "start_line", "end_line", F.size(names).alias("n_params"), doc.alias("has_doc"), "parent")


def parsed_entities(files: DataFrame, lines: DataFrame) -> DataFrame:
    """entities() of Python files and braces.entities() of the other parsed languages; other files, whatever they look like, have none. files: repo_id, path, language, text."""
    python = entities(lines.join(files.where("language = 'python'").select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi"))
    other = braces.entities(files.where(braces.is_brace(F.col("language"))))
    around = _within(other).groupBy("repo_id", "path", "start_line").agg(F.max("parent").alias("parent"))
    return python.unionByName(other.join(around, ["repo_id", "path", "start_line"], "left"))


def _within(found: DataFrame) -> DataFrame:
    """(repo_id, path, parent, start_line): the lines behind the first of each entity, whose first line is parent."""
    return found.where("end_line > start_line").select("repo_id", "path", F.col("start_line").alias("parent"), F.explode(F.sequence(F.col("start_line") + 1, F.col("end_line"))).alias("start_line"))


def _bodies(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of found entities, by file and first line, with the indentation of those that aren't blank."""
    each = found.withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))
    indent = F.when(F.trim("line") != "", F.length(F.regexp_extract("line", r"^(\s*)", 1)))
    return each.join(lines.select("repo_id", "path", "line_no", "line", indent.alias("indent")), ["repo_id", "path", "line_no"])


def entity_complexity(found: DataFrame, lines: DataFrame) -> DataFrame:
    """One more than the decision words of an entity's lines, comment lines left out."""
    points = F.when(F.col("line").rlike(fixed.COMMENT_LINE), 0).otherwise(F.regexp_count("line", F.lit(fixed.DECISIONS)))
    return _bodies(found, lines).groupBy("repo_id", "path", "symbol", "start_line", "end_line").agg((1 + F.sum(points)).alias("complexity"))


def entity_nesting(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The deepest block below the header: lines that aren't blank are walked in order with a stack of indentations, and the largest stack counts."""
    inside = _bodies(found, lines).where((F.col("line_no") > F.col("start_line")) & F.col("indent").isNotNull())
    walked = inside.groupBy("repo_id", "path", "symbol", "start_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "indent"))), lambda x: x.indent).alias("widths"))
    none = F.filter("widths", lambda x: F.lit(False))
    step = lambda stack, x: F.array_append(F.filter(stack, lambda y: y < x), x)
    both = F.aggregate("widths", F.struct(none.alias("stack"), F.lit(0).alias("most")), lambda s, x: F.struct(step(s.stack, x).alias("stack"), F.greatest(s.most, F.size(step(s.stack, x))).alias("most")), lambda s: s.most)
    return walked.select("repo_id", "path", "symbol", "start_line", both.alias("nesting"))


def token_shape(source) -> Column:
    """The token stream of a text with V for each identifier that is no keyword, and L for strings and numbers."""
    strings = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`"
    bare = F.regexp_replace(F.regexp_replace(without_comments(source), strings, " L "), r"\b\d+(?:\.\d+)?\b", " L ")
    tokens = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_])"), 1)
    plain = F.array(*[F.lit(k) for k in [*fixed.KEYWORDS, "L"]])
    return F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z_]") & ~F.array_contains(plain, t), "V").otherwise(t))


def sources(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found with source: the text of each entity. A file bounds it."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    texts = _bodies(found.select("repo_id", "path", "start_line", "end_line"), lines).groupBy("repo_id", "path", "start_line").agg(body.alias("source"))
    return found.join(texts, ["repo_id", "path", "start_line"])


def structure_signatures(found: DataFrame, lines: DataFrame, max_tokens: int = 400) -> DataFrame:
    """found with signature: a hash of the first max_tokens of each entity's token_shape()."""
    shape = F.array_join(F.slice(token_shape("source"), 1, max_tokens), "|")
    return sources(found, lines).withColumn("signature", F.md5(shape.cast("binary"))).drop("source")


def shape_counts(files: DataFrame) -> DataFrame:
    """(repo_id, path, token, n): how often each shape token stands in a file."""
    return files.select("repo_id", "path", F.explode(token_shape("text")).alias("token")).groupBy("repo_id", "path", "token").agg(F.count(F.lit(1)).alias("n"))


def shape_similarity(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """counts as of shape_counts(), pairs (repo_id, a, b) of paths: cosine of their 1 + ln(n) histograms; 0 where a file has no token."""
    weighed = counts.select("repo_id", "path", "token", (1 + F.log(F.col("n").cast("double"))).alias("w"))
    norms = weighed.groupBy("repo_id", "path").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = lambda df, x, **names: df.select("repo_id", F.col("path").alias(x), *[F.col(k).alias(v) for k, v in names.items()])
    met = pairs.join(side(weighed, "a", token="token", w="wa"), ["repo_id", "a"]).join(side(weighed, "b", token="token", w="wb"), ["repo_id", "b", "token"])
    dots = met.groupBy("repo_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    wide = pairs.join(dots, ["repo_id", "a", "b"], "left").join(side(norms, "a", norm="na"), ["repo_id", "a"], "left").join(side(norms, "b", norm="nb"), ["repo_id", "b"], "left")
    return wide.select("repo_id", "a", "b", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"))


def profile_similarity(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """profiles (id, signature, complexity, nesting, n_params, n_lines), pairs (a, b) of ids: 1 for equal signatures, else the cosine of the four measures."""
    keys = ["complexity", "nesting", "n_params", "n_lines"]
    vector = F.array(*[F.coalesce(F.col(k), F.lit(0)).cast("double") for k in keys])
    side = lambda x: profiles.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"), vector.alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.when(F.col("sa") == F.col("sb"), 1.0).otherwise(dense_cosine("va", "vb")).alias("similarity"))


def naming_quality(found: DataFrame) -> DataFrame:
    """Share of good names: not generic, not of two letters (but a few), not one word of three."""
    name = F.lower("symbol")
    poor = ((F.length("symbol") <= 2) & ~name.isin(fixed.SHORT_NAMES)) | name.isin(fixed.GENERIC_NAMES) | ((F.size(identifier_words("symbol")) == 1) & (F.length("symbol") <= 3) & ~name.isin(fixed.SHORT_NAMES))
    return found.groupBy("repo_id").agg(F.avg((~poor).cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))


def error_handling(files: DataFrame, found: DataFrame) -> DataFrame:
    words = files.groupBy("repo_id").agg(F.sum(F.regexp_count("text", F.lit(r"\b(try|catch|except|rescue|recover|finally)\b"))).alias("n_words"))
    functions = found.where("kind <> 'class'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_functions"))
    return words.join(functions, "repo_id").select("repo_id", (F.col("n_words") / F.col("n_functions")).alias("ratio"))


def layers(files: DataFrame) -> DataFrame:
    """(repo_id, layer, n_files): files in a directory whose name marks the layer."""
    folders = F.transform(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.lower)
    hits = F.array_compact(F.array(*[F.when(F.arrays_overlap(folders, F.array(*[F.lit(m) for m in marks.split()])), name) for name, marks in fixed.LAYERS.items()]))
    return files.select("repo_id", F.explode(hits).alias("layer")).groupBy("repo_id", "layer").agg(F.count(F.lit(1)).alias("n_files"))


def frameworks(files: DataFrame, markers: dict[str, list[str]] = fixed.FRAMEWORKS) -> DataFrame:
    """(repo_id, frameworks): names with any marker in any text, sorted."""
    has = lambda marks: reduce(lambda a, b: a | b, [F.col("text").contains(m) for m in marks])
    seen = files.groupBy("repo_id").agg(*[F.coalesce(F.bool_or(has(marks)), F.lit(False)).alias(name) for name, marks in markers.items()])
    return seen.select("repo_id", F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), n) for n in markers]))), ",").alias("frameworks"))


def readmes(files: DataFrame) -> DataFrame:
    """The README of each repository: at the root first, then by preferred name, depth and path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    place = F.array_position(F.array(*[F.lit(n) for n in fixed.README_NAMES]), name)
    order = Window.partitionBy("repo_id").orderBy(F.size(F.split("path", "/")) > 1, place, F.size(F.split("path", "/")), "path")
    return files.where(name.isin(fixed.README_NAMES)).withColumn("at", F.row_number().over(order)).where("at = 1").select("repo_id", "path", "text")


def readme_facts(readme: DataFrame) -> DataFrame:
    """readme (repo_id, path, text): its words, how many of the features it shows, whether the architecture is among them, and whether scaffold text remains."""
    t = F.col("text")
    shown = {key: F.coalesce(t.rlike(p), F.lit(False)) for key, _, p in fixed.DOC_FEATURES}
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return readme.select("repo_id", "path", n.alias("readme_words"), reduce(lambda a, b: a + b, [x.cast("int") for x in shown.values()]).alias("readme_features"), shown["architecture"].alias("shows_architecture"), F.coalesce(t.rlike(fixed.PLACEHOLDER_README), F.lit(False)).alias("readme_is_placeholder"))


def documentation_score(repositories: DataFrame, readme: DataFrame, extra: DataFrame) -> DataFrame:
    """readme (repo_id, text), extra (repo_id, n_docs, documented): feature weights by README patterns, times a gate by length, less for a
    placeholder, plus a little for further documents and documented functions; 0 without README."""
    t = F.col("text")
    feature = reduce(lambda a, b: a + b, [F.when(t.rlike(p), w).otherwise(0.0) for _, w, p in fixed.DOC_FEATURES])
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    gate = F.when(n < 60, 0.35).when(n < 150, 0.6).when(n < 400, 0.85).otherwise(1.0)
    base = 100 * feature * gate * F.when(t.rlike(fixed.PLACEHOLDER_README), 0.55).otherwise(1.0)
    more = F.least(F.lit(8.0), 2.0 * F.coalesce("n_docs", F.lit(0))) + F.least(F.lit(10.0), 20.0 * F.coalesce("documented", F.lit(0.0)))
    wide = repositories.join(readme, "repo_id", "left").join(extra, "repo_id", "left")
    return wide.select("repo_id", F.when(t.isNull(), 0.0).otherwise(clamp(base + more)).alias("score"))


WELL_KNOWN = ["index", "__init__", "main", "app", "types", "constants"]


def _stem(path) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", ""))


def untested_modules(files: DataFrame, salts: int = 32) -> DataFrame:
    """Source files whose stem stands in no test path of the repository; well-known stems are left out.

    A path holds a stem just if one of its pieces of that length is the stem. So paths are cut at the lengths that the repository's stems have, and pieces and
    stems meet by equality: rows are paths times their length times lengths, and no path meets every stem."""
    source = files.where(F.col("category") == "candidate_code").select("repo_id", "path", _stem(F.col("path")).alias("stem")).where(~F.col("stem").isin(WELL_KNOWN))
    stems = source.where("stem <> ''").select("repo_id", "stem").distinct()
    lengths = stems.groupBy("repo_id").agg(F.collect_set(F.length("stem")).alias("lengths"))
    tests = files.where(F.col("category") == "test_code").select("repo_id", F.lower("path").alias("test")).distinct()
    cut = tests.join(lengths, "repo_id").select("repo_id", "test", F.explode("lengths").alias("n")).where(F.length("test") >= F.col("n"))
    pieces = cut.select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("test") - F.col("n") + 1), lambda i: F.substring("test", i, F.col("n")))).alias("stem")).distinct()
    covered = stems.join(pieces, ["repo_id", "stem"], "left_semi")
    tested = tests.select("repo_id").distinct()
    empty = source.where("stem = ''").join(tested, "repo_id", "left_semi").select("repo_id", "stem").distinct()  # every path holds an empty stem
    return source.join(covered.unionByName(empty), ["repo_id", "stem"], "left_anti").select("repo_id", "path")


def own_references(files: DataFrame, least: int = 4) -> DataFrame:
    """(repo_id, references_own): whether the stem of a source file, of at least `least` characters, stands anywhere in the lower-cased text of a test of the repository, inside a longer word too.

    Stems and texts meet by pieces of `least` characters: a text is cut into those pieces that any stem of its repository has, each stem takes the piece that fewest texts have, and
    only texts with that piece are searched. A stem with a piece that no text has is in none."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    stems = files.where(F.col("category") == "candidate_code").select("repo_id", _stem(F.col("path")).alias("stem")).where(F.length("stem") >= least).distinct()
    tests = files.where(F.col("category") == "test_code").select("repo_id", "path", F.lower("text").alias("text")).where(F.length("text") >= least)
    wanted = stems.select("repo_id", "stem", F.explode(pieces("stem")).alias("piece"))
    there = saved(tests.select("repo_id", "path", F.explode(pieces("text")).alias("piece")).join(wanted.select("repo_id", "piece").distinct(), ["repo_id", "piece"], "left_semi"))
    spread = there.groupBy("repo_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(spread, ["repo_id", "piece"], "left").groupBy("repo_id", "stem").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count_if(F.col("n").isNull()).alias("absent")).where("absent = 0")
    met = there.join(rarest.select("repo_id", "stem", "piece"), ["repo_id", "piece"]).select("repo_id", "path", "stem")
    hit = met.join(tests, ["repo_id", "path"]).where(F.contains("text", "stem")).select("repo_id").distinct().withColumn("references_own", F.lit(True))
    return files.select("repo_id").distinct().join(hit, "repo_id", "left").select("repo_id", F.coalesce("references_own", F.lit(False)).alias("references_own"))


def assistant_artifacts(files: DataFrame) -> DataFrame:
    """files with category: comment shapes that assistants leave in source and test files, at most two a file and rule: hits, and hits a source file over 0.8."""
    hits = reduce(lambda a, b: a + b, [F.least(F.lit(2), F.regexp_count("text", F.lit(p))) for _, p in fixed.ARTIFACTS])
    code = F.col("category").isin("candidate_code", "test_code")
    by = files.groupBy("repo_id").agg(F.coalesce(F.sum(F.when(code, hits)), F.lit(0)).alias("n_hits"), F.greatest(F.lit(1), F.count_if(F.col("category") == "candidate_code")).alias("n_files"))
    return by.select("repo_id", "n_hits", clamp(F.col("n_hits") / F.col("n_files") / 0.8, 0.0, 1.0).alias("strength"))


def clone_groups(found: DataFrame, lines: DataFrame, least_lines: int = 6, most: int = 10) -> DataFrame:
    """Entities of a repository, classes left out, with the same structure signature and at least least_lines lines:
    (repo_id, signature, n, members: the first `most`, sorted)."""
    some = found.where("kind <> 'class'").where(F.col("end_line") - F.col("start_line") + 1 >= least_lines)
    signed = structure_signatures(some, lines).withColumn("member", F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), "symbol"))
    place = F.row_number().over(Window.partitionBy("repo_id", "signature").orderBy("member"))
    few = signed.withColumn("place", place).where(F.col("place") <= most).groupBy("repo_id", "signature").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))
    sizes = signed.groupBy("repo_id", "signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.join(few, ["repo_id", "signature"])


def tutorial_signals(files: DataFrame) -> DataFrame:
    """(repo_id, weight, verdict, signals): artefacts that scaffolds leave, by text patterns or paths; .45 is strong, .2 possible."""
    one = lambda ps, paths: reduce(lambda a, b: a | b, [F.coalesce(F.col("text").rlike(p), F.lit(False)) for p in ps] + [F.col("path") == x for x in paths])
    seen = files.groupBy("repo_id").agg(*[F.bool_or(one(ps, paths)).alias(name) for name, _, ps, paths in fixed.TUTORIAL_SIGNALS])
    total = reduce(lambda a, b: a + b, [F.when(F.col(n), w).otherwise(0.0) for n, w, _, _ in fixed.TUTORIAL_SIGNALS])
    verdict = F.when(F.col("weight") >= 0.45, "STRONG_TUTORIAL_SIMILARITY").when(F.col("weight") >= 0.2, "POSSIBLY_TUTORIAL_DERIVED").otherwise("ORIGINAL")
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(n), n) for n, *_ in fixed.TUTORIAL_SIGNALS])), ",")
    return seen.withColumn("weight", total).select("repo_id", "weight", verdict.alias("verdict"), names.alias("signals"))
