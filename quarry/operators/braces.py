"""Entities of brace languages: blocks are matched as a running depth over the tokens of a file, with strings and comments as tokens of their own.

A file is cut into tokens once, by one pattern; what stands in a string or a comment opens nothing. A block's close is the next event on its level, so no stack is
walked. The words before an opening brace, back to the last brace or semicolon, are its header, which tells functions and classes from other blocks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

FILE = ["repo_id", "path"]
COMMENT = r"^(//|/\*)"
# Comments, strings, an opening bracket with destructured names, words, operators of two signs, line ends, single signs.
TOKEN = (
    r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/|//[^\n]*|" + r'"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|' + r"'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'|" + r"`[^`\\]*(?:\\[^\n][^`\\]*)*`|"
    + r"\([ \t\n]*\{[^{}();]*\}|[A-Za-z_$][A-Za-z0-9_$]*|=>|&&|\|\||[0-9]+|\n|[^A-Za-z0-9_$ \t\r\f\n]"
)
NAME = r"([A-Za-z_$~][A-Za-z0-9_$]*)"
CLASS = r"^(?:(?:export|default|public|private|protected|abstract|final|static|typedef) )*(?:class|interface|enum|struct) " + NAME + r"(?: ?$| (?:<|:|extends|implements|permits)(?: |$))"
# A named function, one that a name is given to, a method or C function.
FUNCTIONS = [
    r"(?:^| )function (?:\* )?" + NAME + r" \(",
    NAME + r" (?:: [^=]*)?[=:] (?:async )?(?:function (?:\* )?\(|(?:\([^=]*\)|[A-Za-z_$][A-Za-z0-9_$]*) (?:: [^=]*)?=>$)",
    NAME + r" \((?:[^()]|\([^()]*\))*\)(?: (?:const|noexcept|override|final|throws [A-Za-z0-9_., ]+|: [^()=;]+))?$",
]
ANONYMOUS = r"=>$|(?:^| )function (?:\* )?\("
PARAMS = r"\(((?:[^()]|\([^()]*\))*)\)[^()]*$"
# Words that open a block that is no entity, where a method's name would stand.
CONTROL = ["if", "for", "while", "switch", "catch", "with", "return", "synchronized", "do", "else", "foreach", "using", "lock", "await", "sizeof", "new", "typeof"]


def tokens(files: DataFrame) -> DataFrame:
    """files (repo_id, path, text): (repo_id, path, pos, token, line_no, commented, depth, statement) of each token that is neither a line end nor a comment.

    commented: a comment stands right before it; depth: braces open after it; statement: how many braces and semicolons stand before it."""
    cut = files.select(*FILE, F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    order = Window.partitionBy(*FILE).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("token") - F.length(F.replace(F.col("token"), F.lit("\n")))
    rows = cut.withColumn("line_no", (1 + F.coalesce(F.sum(ends).over(before), F.lit(0))).cast("int")).where("token <> '\n'")
    rows = rows.withColumn("commented", F.coalesce(F.lag(F.col("token").rlike(COMMENT)).over(order), F.lit(False))).where(~F.col("token").rlike(COMMENT))
    brace = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    cuts = F.col("token").isin("{", "}", ";").cast("int")
    return rows.withColumns({"depth": F.sum(brace).over(order), "statement": F.coalesce(F.sum(cuts).over(before), F.lit(0))})


def blocks(rows: DataFrame) -> DataFrame:
    """rows as of tokens(): (repo_id, path, pos, level, start_line, end_line, header, commented), one for each opening brace, start_line that of its header. A block that isn't closed ends with its file."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("token") != "{", F.struct("pos", "token")))), lambda x: x["token"]), " ")
    first = F.min_by(F.struct("line_no", "commented"), F.col("pos"))
    heads = rows.groupBy(*FILE, "statement").agg(F.max(F.when(F.col("token") == "{", F.col("pos"))).alias("pos"), words.alias("header"), first.alias("first")).where("pos is not null")
    last = F.max("line_no").over(Window.partitionBy(*FILE))
    events = rows.withColumn("last", last).where(F.col("token").isin("{", "}")).withColumn("level", F.col("depth") - (F.col("token") == "{").cast("int"))
    following = Window.partitionBy(*FILE, "level").orderBy("pos")
    closed = F.when(F.lead("token").over(following) == "}", F.lead("line_no").over(following)).otherwise(F.col("last"))
    opened = events.withColumn("end_line", closed).where("token = '{'").select(*FILE, "pos", "level", "end_line")
    return opened.join(heads, [*FILE, "pos"]).select(*FILE, "pos", "level", F.col("first.line_no").alias("start_line"), "end_line", "header", F.col("first.commented").alias("commented"))


def entities(files: DataFrame) -> DataFrame:
    """files (repo_id, path, text) of brace languages: (repo_id, path, symbol, kind, start_line, end_line, n_params, has_doc), an entity a line, the outermost. has_doc: a comment stands right before it."""
    h = F.col("header")
    name = F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in (CLASS, *FUNCTIONS[:2])])
    method = F.nullif(F.regexp_extract(h, FUNCTIONS[2], 1), F.lit(""))
    method = F.when(~method.isin(CONTROL) & ~F.element_at(F.split(h, " "), 1).isin(CONTROL), method)
    is_class = h.rlike(CLASS)
    symbol = F.coalesce(name, F.when(h.rlike(ANONYMOUS), F.lit("anonymous")), method)
    given = F.filter(F.transform(F.split(F.regexp_extract(F.regexp_replace(h, r"\{[^{}]*\}", "o"), PARAMS, 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.when(is_class, 0).when(h.rlike(r"[A-Za-z0-9_$] =>$"), 1).otherwise(F.size(given))
    found = blocks(tokens(files)).withColumns({"symbol": symbol, "kind": F.when(is_class, "class").otherwise("function"), "n_params": n}).where("symbol is not null")
    one = F.min_by(F.struct("symbol", "kind", "end_line", "n_params", F.col("commented").alias("has_doc")), F.col("pos"))
    return found.groupBy(*FILE, "start_line").agg(one.alias("e")).select(*FILE, "e.symbol", "e.kind", "start_line", "e.end_line", "e.n_params", "e.has_doc")


def is_brace(language: Column) -> Column:
    return language.isin([x for x in fixed.PARSED if x != "python"])
