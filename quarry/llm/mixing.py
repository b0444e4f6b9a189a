"""Mixing sources to target weights, by hierarchical budgets.

A token budget goes down a tree (by default domain, language, source). At each node it is dealt to the children by weight; a child that
can't use its share (its leaves' tokens times max_epochs) takes what it can, and the rest goes to its siblings by weight until they are
full too. A child's limit is that of its whole subtree, so a shortage is met by siblings first and reaches the parent's siblings only when
the whole family is full. Shares are whole tokens and add up to the budget exactly.

Each leaf then takes whole epochs of its documents and a prefix, by tokens, of one more epoch in an order seeded by (seed, epoch, doc_id).
The prefix is found over buckets of that order, about the square root of the leaf's documents in number, so no leaf is sorted in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 2
SEED = 17
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"
WHOLE = "decimal(38,0)"
# The query's weights; children that aren't named weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}, "source": {"src0": 1}}


def domain_of(source: Column) -> Column:
    """The domain of a source where no table names it: one of four, by a hash."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("int") % 4).cast("string"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _ordered_hash(epoch: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def leaf_budgets(leaves: DataFrame, total: Column, levels: tuple[str, ...], weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves: (levels, tokens, docs), one row each. Adds budget, in whole tokens."""
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(WHOLE))
    given = nodes.agg(F.least(total.cast(WHOLE), F.sum("cap")).alias("given"))
    path: list[str] = []
    for level in levels:
        at = nodes.groupBy(*path, level).agg(F.sum("cap").cast(WHOLE).alias("cap")).withColumn("w", _weight(level, weights).cast(WHOLE))
        at = at.join(given, path) if path else at.crossJoin(given)  # at the top, given is a single row
        order = Window.partitionBy(*path).orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), level)
        before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        at = at.where("w > 0").withColumns({"c": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(WHOLE), "onward": F.sum("w").over(onward).cast(WHOLE)})
        full = F.col("cap") * F.col("onward") <= (F.col("given") - F.col("c")) * F.col("w")
        at = at.withColumn("full", full)
        family = Window.partitionBy(*path)
        at = at.withColumns({"left": (F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).cast(WHOLE), "weigh": F.sum(F.when(~F.col("full"), F.col("w"))).over(family).cast(WHOLE)})
        at = at.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * w) div weigh")).cast(WHOLE))
        at = at.withColumn("rest", (F.col("left") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("part"))).over(family), F.lit(0))).cast(WHOLE))
        at = at.withColumn("place", F.row_number().over(Window.partitionBy(*path).orderBy("full", level)))
        path = [*path, level]
        given = at.select(*path, (F.col("part") + F.when(~F.col("full") & (F.col("place") <= F.col("rest")), 1).otherwise(0)).cast(WHOLE).alias("given"))
    return leaves.join(given, path, "left").withColumn("budget", F.coalesce("given", F.lit(0)).cast("long")).drop("given")


def mix(docs: DataFrame, budget: Column | None = None, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text and the columns of levels, any more. (doc_id, levels, epoch, tokens, taken): a row for each time a document is taken.

    budget is an expression over `available`, the number of all tokens; without it, that number itself. Tokens are words. A null level is
    the empty name; null and empty texts have no tokens and come with any epoch that passes them; a null doc_id orders like an empty one.
    taken is less than tokens only for the document in which a leaf's budget ends. Repeated rows are documents of their own; rows that agree in
    leaf, doc_id and tokens are counted together, so one id in very many rows is no large group. A child of weight zero or less gets nothing."""
    keys = list(levels)
    given = (docs.select("doc_id", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in keys], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")))
    own = saved(given.groupBy("doc_id", *keys, "tokens").agg(F.count(F.lit(1)).alias("copies")))
    leaves = saved(own.groupBy(*keys).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs")))
    available = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("available")).first().available
    total = F.lit(available) if budget is None else F.lit(docs.sparkSession.range(1).select(F.lit(available).alias("available")).select(budget.cast("long")).first()[0])
    plan = leaf_budgets(leaves, total, levels, weights, max_epochs)
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(F.lit(0))
    plan = plan.withColumnRenamed("tokens", "leaf_tokens").withColumn("whole", whole.cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    plan = plan.withColumn("buckets", F.greatest(F.lit(1), F.floor(2 * F.sqrt(F.col("docs").cast("double")))).cast("long"))
    # Each leaf's plan is repeated for every salt, so a leaf that holds much of the corpus is dealt to many tasks.
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select("doc_id", *keys, "epoch", "tokens", F.col("tokens").alias("taken"), "copies")
    some = rows.where("rest > 0").withColumn("h", _ordered_hash(F.col("whole"), seed)).withColumn("bucket", F.expr("(h * buckets) div 4294967296"))
    both = F.col("tokens") * F.col("copies")
    sums = some.groupBy(*keys, "bucket").agg(F.sum(both).alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy(*keys, "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    some = some.join(starts, [*keys, "bucket"]).where("start < rest").withColumn("before", F.col("start") + F.coalesce(F.sum(both).over(within), F.lit(0)))
    some = some.where("before < rest").select("doc_id", *keys, F.col("whole").alias("epoch"), "tokens", (F.col("rest") - F.col("before")).alias("room"), "copies")
    # Of equal rows as many as have room, the last of them cut; rows without tokens all come.
    one = F.when(F.col("tokens") == 0, F.col("copies")).otherwise(F.least("copies", F.expr("room div tokens")))
    cut = F.when((F.col("tokens") > 0) & (one < F.col("copies")), F.expr("room % tokens")).otherwise(F.lit(0).cast("long"))
    shares = F.filter(F.array(F.struct(F.col("tokens").alias("taken"), one.alias("copies")), F.struct(cut.alias("taken"), F.when(cut > 0, 1).otherwise(0).cast("long").alias("copies"))), lambda x: x.copies > 0)
    some = some.withColumn("share", F.explode(shares)).select("doc_id", *keys, "epoch", "tokens", "share.taken", "share.copies")
    return full.unionByName(some).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def _case(level: str) -> str:
    named = WEIGHTS.get(level, {})
    return "cast(" + (f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in sorted(named.items())) + " else 1 end" if named else "1") + " as hugeint)"


def _level_sql(name: str, prior: str, path: list[str], level: str) -> str:
    over = f"partition by {', '.join(path)}" if path else ""
    keys = ", ".join([*path, level])
    joined = f"join {prior} using ({', '.join(path)})" if path else f"cross join {prior}"
    return f"""
{name}_a as (select {keys}, sum(cap)::hugeint as cap, any_value({_case(level)}) as w from leaves group by {keys}),
{name}_b as (select * from {name}_a {joined} where w > 0),
{name}_c as (select *, coalesce(sum(cap) over (s rows between unbounded preceding and 1 preceding), 0) as c, sum(w) over (s rows between current row and unbounded following) as onward
  from {name}_b window s as ({over} order by cap::double / w::double, {level})),
{name}_d as (select *, cap * onward <= (given - c) * w as is_full from {name}_c),
{name}_e as (select *, (given - coalesce(sum(case when is_full then cap end) over ({over}), 0))::hugeint as left_over, (sum(case when not is_full then w end) over ({over}))::hugeint as weigh from {name}_d),
{name}_f as (select *, case when is_full then cap else (left_over * w) // weigh end as part from {name}_e),
{name}_g as (select *, left_over - coalesce(sum(case when not is_full then part end) over ({over}), 0) as rest, row_number() over ({over} order by is_full, {level}) as place from {name}_f),
{name} as (select {keys}, (part + case when not is_full and place <= rest then 1 else 0 end)::hugeint as given from {name}_g),"""


ORACLE_SQL = f"""
with own as (
  select doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::int % 4) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens
  from documents
),
leaves as (select domain, lang, source, sum(tokens)::bigint as leaf_tokens, count(*) as docs, sum(tokens)::hugeint * {MAX_EPOCHS} as cap from own group by all),
top as (select least(sum(leaf_tokens)::hugeint, sum(cap)::hugeint) as given from leaves),
{_level_sql("l1", "top", [], "domain")}
{_level_sql("l2", "l1", ["domain"], "lang")}
{_level_sql("l3", "l2", ["domain", "lang"], "source")}
plan as (
  select domain, lang, source, leaf_tokens, coalesce(given, 0)::bigint as budget, case when leaf_tokens > 0 then coalesce(given, 0)::bigint // leaf_tokens else 0 end as whole,
    greatest(1, floor(2 * sqrt(docs::double)))::bigint as buckets
  from leaves left join l3 using (domain, lang, source)
),
joined as (select *, budget - whole * leaf_tokens as rest from own join plan using (domain, lang, source)),
hashed as (select *, ('0x' || substr(md5('{SEED}:' || whole || ':' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from joined where rest > 0),
ranked as (
  select *, coalesce(sum(tokens) over (partition by domain, lang, source order by (h * buckets) // 4294967296, h, doc_id, tokens rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from hashed
)
select doc_id, domain, lang, source, unnest(generate_series(0, whole - 1))::int as epoch, tokens, tokens as taken from joined where whole > 0
union all
select doc_id, domain, lang, source, whole::int as epoch, tokens, least(tokens, rest - before) as taken from ranked where before < rest
"""
