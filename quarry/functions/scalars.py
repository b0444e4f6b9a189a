"""Scalar helpers: Column in, Column out, no UDFs."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once, where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(v, low: float = 0.0, high: float = 100.0) -> Column:
    """v within [low, high]; null stays null."""
    return F.when(col(v).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(v))))


def scale(v, worst: float, best: float) -> Column:
    """Linear 0..100 from worst to best, either way round; 100 where both are equal."""
    return F.lit(100.0) if worst == best else clamp((col(v) - worst) * (100.0 / (best - worst)))


def log_scale(v, full: float) -> Column:
    return clamp(F.log1p(col(v)) / F.log1p(F.lit(float(full))), 0.0, 1.0)


def line_count(text) -> Column:
    """Line breaks, and one more for a last line without."""
    t = col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n")))
    return breaks + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)


def entropy(s) -> Column:
    """Shannon entropy in bits a character; zero for empty."""
    n = F.length(col(s)).cast("double")
    counts = let(F.split(col(s), ""), lambda chars: F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n))
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def identifier_words(s) -> Column:
    """Lower-case words of a snake, kebab or camel identifier."""
    spaced = F.regexp_replace(F.regexp_replace(col(s), "([a-z0-9])([A-Z])", "$1 $2"), "[_\\-\\s]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def split_words(term: str) -> list[str]:
    """The words of a fixed term, as texts are split: letters, digits, + # and underscores."""
    return "".join(c if c.isalnum() or c in "+#_" else " " for c in term.lower()).split()


def words(t) -> Column:
    return F.transform(F.regexp_extract_all(col(t), F.lit("([A-Za-z][A-Za-z0-9_]+)"), 1), F.lower)


def truncated(t, n: int) -> Column:
    return F.when(F.length(col(t)) > n, F.concat(F.rtrim(F.substring(col(t), 1, n - 1)), F.lit("…"))).otherwise(col(t))


def dense_cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = col(a), col(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)


def normalised_line(line) -> Column:
    """A line without comment, string contents and white space, for duplicate search."""
    bare = F.regexp_replace(col(line), r"(#|//).*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\"[^\"]*\"|'[^']*'", '""'), r"\s+", "")


def without_comments(source) -> Column:
    """Block comments, doc strings, line comments, in this order."""
    out = col(source)
    for pattern in (r"(?s)/\*.*?\*/", r'(?s)""".*?"""', r"(?s)'''.*?'''", r"//[^\n]*", r"#[^\n]*"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def token_stream(source) -> Column:
    """Identifiers and single symbols; digits dropped."""
    return F.regexp_extract_all(without_comments(source), F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_])"), 1)


def intent(message) -> Column:
    """The first commit intent whose pattern matches the message's first line, else other."""
    subject = F.element_at(F.split(col(message), "\n"), 1)
    return reduce(lambda out, rule: F.when(subject.rlike(rule[1]), rule[0]).otherwise(out), reversed(fixed.INTENTS), F.lit("other"))


def message_quality(message) -> Column:
    """0.15 for low effort; else up to 0.7 by words (1 to 7), 0.15 for a body of more than two lines, 0.15 for a specific word."""
    m = col(message)
    subject = F.trim(F.element_at(F.split(m, "\n"), 1))
    n = F.size(F.filter(F.split(subject, r"\s+"), lambda w: w != ""))
    length = clamp((n - 1) / 6.0, 0.0, 1.0) * 0.7
    body = F.when(F.size(F.split(F.trim(m), "\n")) > 2, 0.15).otherwise(0.0)
    specific = F.when(subject.rlike(r"(?i)[a-z]+[._/][a-z]+|`|#\d+"), 0.15).otherwise(0.0)
    return F.when(subject.rlike(fixed.LOW_EFFORT), 0.15).otherwise(F.least(F.lit(1.0), length + body + specific))


def test_cases(text) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(col(text), F.lit(p)) for p in fixed.TEST_CASES])


def masked(value) -> Column:
    """At most two characters, then a mark; nothing of short values."""
    return F.when(F.length(col(value)) > 4, F.concat(F.substring(col(value), 1, 2), F.lit("…[REDACTED]"))).otherwise(F.lit("…[REDACTED]"))


def slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def score_band(v) -> Column:
    c = col(v)
    return F.when(c.isNull(), "unknown").when(c >= 80, "strong").when(c >= 65, "good").when(c >= 45, "fair").otherwise("weak")


def confidence_band(v) -> Column:
    c = col(v)
    return F.when(c < 0.35, "very_low").when(c < 0.55, "low").when(c < 0.78, "medium").otherwise("high")


def utilization_class(v) -> Column:
    c = col(v)
    return F.when(c >= 75, "Effective AI Augmentation").when(c >= 55, "Productive, With Gaps").when(c >= 35, "Verification Recommended").otherwise("Insufficient Evidence of Productive Use")


def feature_hash(feature, dims: int = 256) -> tuple[Column, Column]:
    """(index, sign) of a hashed feature."""
    digest = F.md5(col(feature).cast("binary"))
    index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") >= 8, -1.0).otherwise(1.0)
    return index, sign


def module_key(path) -> Column:
    return F.regexp_replace(col(path), r"\.(py|js|jsx|ts|tsx|java|c|cpp)$", "")


def normal_path(path) -> Column:
    """a/./b/../c as a/c; a .. at the top is dropped."""
    step = lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p))
    return F.array_join(F.aggregate(F.split(col(path), "/"), F.array().cast("array<string>"), step), "/")
