"""URL filters with DataFrame functions only: domain rules, and listed keys held in a cascade of Bloom filters.

Level 1 of the cascade encodes the listed keys; level 2 those keys of the corpus that aren't listed but pass level 1; level 3 the listed keys
that pass level 2; and so on until nothing passes wrongly. Over the complete set of the corpus's keys the first level that a key
fails tells exactly whether it is listed, so urls need no join with the list.

A level is an array of 64-bit words, made by grouping bit positions. While it has at most max_bytes (its size follows from counted keys before it
is built) it is a literal of the plan. A larger one is parted by a hash of the key into shards of SHARD_WORDS words, a row of a small table each; a key
then looks at the one row of its shard, whatever the size of the list."""

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_BYTES = 1 << 20
SHARD_WORDS = 1 << 16
# Shards of a level that go to every task together: at most 64 MB.
BROADCAST_SHARDS = 128
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, beginning of the path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# The query's list: hosts with one of these labels, and the urls of pages that hold one of these words.
BLOCKED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_WORDS = ["disgusting", "pathetic", "worthless"]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls; of rules equally long the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    number: int
    bits: int  # of each shard
    hashes: int
    shards: int
    words: list[int] | None  # on the driver, if small enough
    table: DataFrame | None  # (shard, words), else

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), F.lit(self.number), key), F.lit(self.shards)).cast("int")

    def positions(self, key: Column) -> list[Column]:
        a, b = F.pmod(F.xxhash64(key, F.lit(self.number)), F.lit(self.bits)), F.pmod(F.xxhash64(F.lit(self.number), key), F.lit(self.bits))
        return [(a + b * i) % self.bits for i in range(self.hashes)]

    def _set(self, array: Column, key: Column) -> Column:
        """Whether all bits of the key are set."""
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
        tests = [F.element_at(array, (F.floor(p / 64) + 1).cast("int")).bitwiseAND(bit(p)) != 0 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def marked(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a column that tells whether the level holds the key; null keys are held or not like empty ones."""
        key = F.coalesce(key, F.lit(""))
        if self.words is not None:
            return rows.withColumn(name, self._set(F.from_json(F.lit(json.dumps(self.words)), "array<bigint>"), key))
        shards = F.broadcast(self.table) if self.shards <= BROADCAST_SHARDS else self.table
        return rows.withColumn("level_shard", self.shard(key)).join(shards, "level_shard").withColumn(name, self._set(F.col("level_words"), key)).drop("level_shard", "level_words")

    def passing(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (key, distinct) that the level holds."""
        return self.marked(keys, F.col("key"), "ok").where("ok").select("key")


def _level(number: int, keys: DataFrame, count: int, rate: float, max_bytes: int) -> Level:
    bits = max(64, math.ceil(count * 1.4427 * math.log2(1 / rate) / 64) * 64)
    small = bits // 8 <= max_bytes
    shards = 1 if small else math.ceil(bits / 64 / SHARD_WORDS)
    # Keys of a shard vary in number around count / shards; a few words more keep the rate.
    own = bits // 64 if small else min(SHARD_WORDS, math.ceil(bits / 64 / shards * 1.05) + 1)
    level = Level(number, own * 64, max(1, round(math.log2(1 / rate))), shards, None, None)
    spots = keys.select(level.shard(F.col("key")).alias("shard"), F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    given = spots.groupBy("shard", F.floor(F.col("p") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    every = keys.sparkSession.range(shards * own).select(F.expr(f"cast(id div {own} as int)").alias("shard"), (F.col("id") % own).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = given.unionByName(every).groupBy("shard", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    table = words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("words"))  # at most SHARD_WORDS, or max_bytes
    if small:
        level.words = table.select("words").toArrow().column(0).combine_chunks().flatten().to_pylist()
    else:
        level.table = saved(table.toDF("level_shard", "level_words"))
    return level


def cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES, max_levels: int = 60) -> list[Level]:
    """universe, listed: (key). Levels that tell listed keys from the others exactly, for every key of the universe and the list.

    Null keys play no part. An empty list gives no levels: nothing is listed."""
    both = universe.select("key", F.lit(0).alias("y")).unionByName(listed.select("key", F.lit(1).alias("y"))).where("key is not null")
    keys = saved(both.groupBy("key").agg(F.max("y").alias("y")))
    inside, outside = keys.where("y = 1").select("key"), keys.where("y = 0").select("key")
    n, others = inside.count(), outside.count()
    levels: list[Level] = []
    if not n:
        return levels
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(1, others)))
    now, test = inside, outside
    while True:
        levels.append(_level(len(levels) + 1, now, n, rate, max_bytes // 2 if levels else max_bytes))
        wrong = saved(levels[-1].passing(test))
        n, rate = wrong.count(), 0.5
        if not n:
            return levels
        if len(levels) == max_levels:
            raise RuntimeError("the cascade did not end")
        now, test = wrong, now


def with_listed(rows: DataFrame, key: Column, levels: list[Level], name: str) -> DataFrame:
    """rows with a column that tells whether a key of the universe is listed: the first level that it fails decides. False for null."""
    marks = [f"passes_{level.number}" for level in levels]
    out = F.lit(len(levels) % 2 == 1)
    for level, mark in zip(reversed(levels), reversed(marks)):
        out = F.when(F.col(mark), out).otherwise(F.lit(level.number % 2 == 0))
    for level, mark in zip(levels, marks):
        rows = level.marked(rows, key, mark)
    return rows.withColumn(name, key.isNotNull() & out if levels else F.lit(False)).drop(*marks)


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages: page_id, url, any more; listed: (key), hosts or host and path. (page_id, host, path, rule, verdict, listed), a row for each input row.

    A url is listed if its host or its host and path are. A rule's verdict goes before the list's. A null url, or one without ://, has empty host and
    path, fits no rule and is allowed. Rows count each for itself, whatever their page_id; texts of any length are read whole."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    full = F.concat("host", "path")
    universe = parsed.select(F.explode(F.array("host", full)).alias("key")).where("key <> ''").distinct()
    levels = cascade(universe, listed, max_bytes)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    found = with_listed(with_listed(parsed, F.col("host"), levels, "by_host"), full, levels, "by_url")
    found = found.withColumn("listed", (F.col("host") != "") & (F.col("by_host") | F.col("by_url")))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_from(pages: DataFrame, labels: list[str] = BLOCKED_LABELS, words: list[str] = BLOCKED_WORDS) -> DataFrame:
    """The list of the registered query, drawn from pages (url, html)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    bad = F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))
    text = F.lower("html")
    holds = text.contains(words[0])
    for w in words[1:]:
        holds = holds | text.contains(w)
    keys = F.array(F.when(bad, host), F.when(holds, F.concat(host, path)))
    return pages.select(F.explode(keys).alias("key")).where("key <> ''").distinct()


ORACLE_SQL = f"""
with parsed as (
  select page_id, html, case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{CAPITALS}', '{SMALL}') else '' end as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
),
listed as (
  select host as key from parsed where host <> '' and list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in BLOCKED_LABELS)}])
  union
  select host || path from parsed where host || path <> '' and ({" or ".join(f"contains(lower(html), '{w}')" for w in BLOCKED_WORDS)})
),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
    host <> '' and (host in (select key from listed) or host || path in (select key from listed)) as listed
  from parsed
)
select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
  else case when listed then 'block' else 'allow' end end as verdict, listed
from ruled
"""
