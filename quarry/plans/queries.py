"""Registered queries of the library's own operators: name -> (query, SQL of the same rows or None)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import classify, dependencies, graph, history, jobs, lines, measures, ownership, scoring, security, serving, similarity, skills, structure
from . import project
from .domain import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """run gets a function from a domain table's (or given table's) name to its DataFrame."""
    from .domain import VIEWS

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(lambda t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = (f"with {with_views(*views)}\n{sql}") if views else sql


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# -- fragments of SQL that several queries share

SQL_LANGUAGE = f"""case when regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^dockerfile') then 'dockerfile'
  else case regexp_extract(lower(regexp_extract(path, '[^/]*$')), '^.+\\.([^.]+)$', 1) {" ".join(f"when '{k}' then '{v}'" for k, v in fixed.EXTENSIONS.items())} end end"""
SQL_REASON = f"""case when len(list_filter(string_split(path, '/')[:-2], lambda x: x in ({listed(fixed.IGNORED_DIRECTORIES)}))) > 0
    then 'inside ignored directory ''' || list_filter(string_split(path, '/')[:-2], lambda x: x in ({listed(fixed.IGNORED_DIRECTORIES)}))[1] || ''''
  when regexp_extract(path, '[^/]*$') in ({listed(fixed.IGNORED_DIRECTORIES)}) then 'ignored directory ''' || regexp_extract(path, '[^/]*$') || ''''
  when regexp_extract(lower(path), '\\.([^./]+)$', 1) in ({listed(fixed.BINARY_SUFFIXES)}) then 'binary extension ''.' || regexp_extract(lower(path), '\\.([^./]+)$', 1) || ''''
  when path like '%.min.js' or path like '%.min.css' or path like '%.map' then 'minified or source-map artefact' end"""
SQL_CATEGORY = f"""case when skipped_reason is not null then 'ignored'
  when lower(regexp_extract(path, '[^/]*$')) in ({listed(fixed.LOCK_FILES)}) then 'dependency_code'
  when regexp_matches(path, {quoted(fixed.GENERATED_PATH)}) or regexp_matches(substr(text, 1, 800), {quoted(fixed.GENERATED_BANNER)}) then 'generated_code'
  when regexp_matches(path, {quoted(fixed.TEST_PATH)}) and language in ({listed(fixed.PROGRAMMING)}) then 'test_code'
  when regexp_extract(path, '[^/]*$') in ({listed(fixed.MANIFESTS)}) or lower(regexp_extract(path, '[^/]*$')) in ({listed(fixed.CONFIG_NAMES)}) then 'configuration'
  when regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)\\.[^.]+$', '\\1') in ({listed(fixed.DOC_NAMES)}) or language in ({listed(fixed.DOCS)}) then 'documentation'
  when language in ({listed(fixed.PROGRAMMING)}) or language in ({listed(fixed.MARKUP)}) then 'candidate_code'
  when language in ({listed(fixed.DATA)}) or language in ({listed(fixed.BUILD)}) then 'configuration' else 'asset' end"""
SQL_CLASSIFIED = f"""named as (select *, {SQL_LANGUAGE} as language, {SQL_REASON} as skipped_reason from files),
classified as (select *, {SQL_CATEGORY} as category,
  length(text) - length(replace(text, chr(10), '')) + case when length(text) > 0 and not ends_with(text, chr(10)) then 1 else 0 end as line_count from named)"""
SQL_LINES = "all_lines as (select repo_id, path, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) as int) as line_no, unnest(string_split(text, chr(10))) as line from files where text is not null)"
SQL_INTENT = "case " + " ".join(f"when regexp_matches(string_split(message, chr(10))[1], {quoted(p)}) then '{n}'" for n, p in fixed.INTENTS) + " else 'other' end"
SQL_SUBJECT = "trim(string_split(message, chr(10))[1])"
SQL_MESSAGE = f"""case when regexp_matches({SQL_SUBJECT}, {quoted(fixed.LOW_EFFORT)}) then 0.15e0 else least(1.0e0,
  greatest(0.0e0, least(1.0e0, (len(list_filter(string_split_regex({SQL_SUBJECT}, '\\s+'), lambda x: x <> '')) - 1) / 6.0e0)) * 0.7e0
  + case when len(string_split(trim(message), chr(10))) > 2 then 0.15e0 else 0.0e0 end
  + case when regexp_matches({SQL_SUBJECT}, '(?i)[a-z]+[._/][a-z]+|`|#\\d+') then 0.15e0 else 0.0e0 end) end"""


def sql_scale(v: str, worst: float, best: float) -> str:
    return f"greatest(0.0e0, least(100.0e0, ({v} - {worst}) * (100.0e0 / ({best} - {worst}))))"


# -- classification

register("b1_ignore_reason", lambda t: t("files").select("repo_id", "path", classify.ignore_reason("path").alias("reason")), f"select repo_id, path, {SQL_REASON} as reason from files", ("files",))
register("b2_language", lambda t: t("files").select("repo_id", "path", classify.language("path").alias("language"), F.coalesce(classify.language("path").isin(fixed.PARSED), F.lit(False)).alias("parsed")), f"select repo_id, path, language, coalesce(language in ({listed(fixed.PARSED)}), false) as parsed from (select *, {SQL_LANGUAGE} as language from files)", ("files",))
register("b4_path_predicates", lambda t: t("files").select("repo_id", "path", classify.is_lock_file("path").alias("lock"), classify.is_manifest("path").alias("manifest"), classify.is_test_path("path").alias("test"), classify.is_generated("path", "text").alias("generated")),
    f"select repo_id, path, lower(regexp_extract(path, '[^/]*$')) in ({listed(fixed.LOCK_FILES)}) as lock, regexp_extract(path, '[^/]*$') in ({listed(fixed.MANIFESTS)}) as manifest, regexp_matches(path, {quoted(fixed.TEST_PATH)}) as test, regexp_matches(path, {quoted(fixed.GENERATED_PATH)}) or regexp_matches(substr(text, 1, 800), {quoted(fixed.GENERATED_BANNER)}) as generated from files", ("files",))
register("b5_category", lambda t: classify.classified(t("files")).select("repo_id", "path", "language", "category", "line_count", "content_hash"), f", {SQL_CLASSIFIED} select repo_id, path, language, category, line_count, sha256(text) as content_hash from classified", ("files",))
register("a4_scan_summary", lambda t: classify.scan_summary(classify.classified(t("files"))), f", {SQL_CLASSIFIED} select repo_id, category, count(*) as n_files, sum(size_bytes)::bigint as n_bytes from classified group by all", ("files",))
register("a5_budget", lambda t: classify.within_budget(t("files"), 30, 20_000, 90_000).select("repo_id", "path", "kept", "exceeded"), "select repo_id, path, row_number() over w <= 30 and sum(size_bytes) over w <= 90000 as kept, sum(size_bytes) over w > 90000 as exceeded from files where size_bytes <= 20000 window w as (partition by repo_id order by path)", ("files",))
register("a5_commit_budget", lambda t: history.newest_commits(t("commits"), 200).select("repo_id", "sha", "truncated"), ", n as (select repo_id, count(*) >= 200 as truncated from commits group by repo_id) select repo_id, sha, truncated from (select *, row_number() over (partition by repo_id order by committed_at desc, sha) as place from commits) join n using (repo_id) where place <= 200", ("commits",))
register("e3_language_share", lambda t: rounded(classify.language_share(classify.classified(t("files"))), "share"), f", {SQL_CLASSIFIED}, b as (select repo_id, language, sum(greatest(1, size_bytes))::bigint as n_bytes from classified where category in ('candidate_code', 'test_code') group by all) select *, round(n_bytes / sum(n_bytes) over (partition by repo_id), 6) as share from b", ("files",))
register("h3_largest_files", lambda t: serving.top_per_group(t("files"), ["repo_id"], [F.desc("size_bytes"), F.asc("path")], 5).select("repo_id", "place", "path", "size_bytes"), "select * from (select repo_id, row_number() over (partition by repo_id order by size_bytes desc, path) as place, path, size_bytes from files) where place <= 5", ("files",))

# -- scalars

register("c3_entropy", lambda t: t("audit").select("event_id", r6(scalars.entropy(F.concat("action", F.col("actor_id").cast("string")))).alias("bits")),
    ", s as (select event_id, action || actor_id as s from audit), c as (select event_id, length(s) as n, unnest(string_split(s, '')) as ch from s), k as (select event_id, n, ch, count(*) as m from c group by all) select event_id, round(-sum(m / n::double * log2(m / n::double)), 6) + 0.0 as bits from k group by event_id", ("audit",))
register("c4_identifier_words", lambda t: t("part").select("p_partkey", F.array_join(scalars.identifier_words(F.concat_ws("_", "p_name", "p_type")), " ").alias("words")), "select p_partkey, array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(p_name || '_' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g'))), ' '), lambda x: x <> ''), ' ') as words from part")
register("c5_words", lambda t: t("documents").select("doc_id", F.size(scalars.words("text")).alias("n"), F.md5(F.array_join(scalars.words("text"), " ").cast("binary")).alias("digest")), "select doc_id, len(w)::int as n, md5(array_to_string(list_transform(w, lambda x: lower(x)), ' ')) as digest from (select doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+') as w from documents)")
register("c6_truncate", lambda t: t("documents").select("doc_id", scalars.truncated("text", 80).alias("short")), "select doc_id, case when length(text) > 80 then rtrim(substr(text, 1, 79), ' ') || '…' else text end as short from documents")
register("c8_cosine", lambda t: t("vectors").alias("a").join(t("vectors").alias("b"), F.expr("a.id + 1 = b.id")).select(F.col("a.id").alias("id"), r6(scalars.dense_cosine(F.col("a.embedding"), F.col("b.embedding"))).alias("cosine")), "select a.id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from vectors a join vectors b on a.id + 1 = b.id", ("vectors",))
register("c9_normalised_line", lambda t: lines.lines_of(t("files")).select("repo_id", "path", "line_no", F.md5(scalars.normalised_line("line").cast("binary")).alias("digest")), f""", {SQL_LINES} select repo_id, path, line_no, md5(regexp_replace(regexp_replace(regexp_replace(line, '(#|//).*$', '', 'g'), '"[^"]*"|''[^'']*''', '""', 'g'), '\\s+', '', 'g')) as digest from all_lines""", ("files",))
register("c12_token_stream", lambda t: t("files").select("repo_id", "path", F.size(scalars.token_stream("text")).alias("n_tokens")), f""", u as (select repo_id, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '(?s)\"\"\".*?\"\"\"', ' ', 'g'), '(?s)''''''.*?''''''', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '#[^\\n]*', ' ', 'g') as s from files) select repo_id, path, len(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*|[^\\sA-Za-z0-9_]'))::int as n_tokens from u""", ("files",))
register("c15_feature_hash", lambda t: t("part").select("p_partkey", scalars.feature_hash("p_name")[0].alias("index"), scalars.feature_hash("p_name")[1].alias("sign")), "select p_partkey, ('0x' || substr(md5(p_name), 1, 8))::bigint % 256 as index, case when ('0x' || substr(md5(p_name), 9, 1))::int >= 8 then -1.0 else 1.0 end::double as sign from part")
register("c20_module_key", lambda t: t("files").select("path", scalars.module_key("path").alias("module"), scalars.normal_path(F.concat(F.lit("a/./b/../"), F.col("path"))).alias("normal")), "select path, regexp_replace(path, '\\.(py|js|jsx|ts|tsx|java|c|cpp)$', '') as module, 'a/' || path as normal from files", ("files",))
register("c22_test_cases", lambda t: classify.classified(t("files")).groupBy("repo_id").agg(F.sum(scalars.test_cases("text")).alias("n")), "select repo_id, sum(" + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in fixed.TEST_CASES) + ")::bigint as n from files group by repo_id", ("files",))
register("c24_mask", lambda t: t("part").select("p_partkey", scalars.masked("p_name").alias("masked")), "select p_partkey, case when length(p_name) > 4 then substr(p_name, 1, 2) || '…[REDACTED]' else '…[REDACTED]' end as masked from part")
register("c33_slug", lambda t: t("customer").select("c_custkey", scalars.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug")), "select c_custkey, regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from customer")
register("b19_score_band", lambda t: t("category_scores").select("score_id", scalars.score_band("score").alias("band"), scalars.confidence_band("confidence").alias("confidence_band"), scalars.utilization_class("score").alias("utilization")), "select score_id, case when score is null then 'unknown' when score >= 80 then 'strong' when score >= 65 then 'good' when score >= 45 then 'fair' else 'weak' end as band, case when confidence < 0.35e0 then 'very_low' when confidence < 0.55e0 then 'low' when confidence < 0.78e0 then 'medium' else 'high' end as confidence_band, case when score >= 75 then 'Effective AI Augmentation' when score >= 55 then 'Productive, With Gaps' when score >= 35 then 'Verification Recommended' else 'Insufficient Evidence of Productive Use' end as utilization from category_scores", ("category_scores",))

# -- lines

register("g1_line_accounting", lambda t: lines.line_accounting(lines.lines_of(t("files"))), f", {SQL_LINES} select repo_id, path, count(*) filter (trim(line) = '') as blank_lines, count(*) filter (trim(line) <> '' and regexp_matches(line, {quoted(fixed.COMMENT_LINE)})) as comment_lines, count(*) filter (trim(line) <> '' and not regexp_matches(line, {quoted(fixed.COMMENT_LINE)})) as code_lines from all_lines group by all", ("files",))
SQL_BLOCKS = f"""{SQL_LINES},
norms as (select repo_id, path, line_no, regexp_replace(regexp_replace(regexp_replace(line, '(#|//).*$', '', 'g'), '"[^"]*"|''[^'']*''', '""', 'g'), '\\s+', '', 'g') as norm from all_lines),
runs as (select repo_id, path, line_no, list(norm) over w as parts, count(*) over w as n from norms where length(norm) > 3 window w as (partition by repo_id, path order by line_no rows between current row and 5 following)),
blocks as (select repo_id, path, line_no, md5(array_to_string(parts, chr(10))) as block from runs where n = 6 and length(array_to_string(parts, chr(10))) >= 60)"""
register("f1_duplicate_blocks", lambda t: lines.duplicate_blocks(lines.lines_of(t("files"))), f", {SQL_BLOCKS} select * from blocks", ("files",))
register("g9_duplication_ratio", lambda t: rounded(lines.duplication_ratio(lines.lines_of(t("files"))), "ratio"), f", {SQL_BLOCKS} select repo_id, count(*)::bigint as n_blocks, count(distinct block) as n_distinct, round(1 - count(distinct block) / count(*), 6) as ratio from blocks group by repo_id", ("files",))
register("f2_duplicate_examples", lambda t: lines.duplicate_examples(lines.lines_of(t("files"))), f", {SQL_BLOCKS}, g as (select repo_id, block, min({{'path': path, 'line_no': line_no}}) as spot, count(*) as n, max(path) as last_path from blocks group by all), r as (select repo_id, row_number() over (partition by repo_id order by n desc, spot.path, spot.line_no, block) as place, spot.path as path, spot.line_no as line_no, n from g where last_path > spot.path) select * from r where place <= 8", ("files",))
# -- history

SQL_OWN = "own as (select *, insertions + deletions as size from commits where not is_merge)"
SQL_MINE = ", mine as (select * from own where exists (select 1 from emails e where lower(author_email) = e.email) or exists (select 1 from emails e where ends_with(lower(author_email), '+' || e.email)))"
SQL_JUDGED = ", judged as (select * from mine union all select * from own where repo_id not in (select repo_id from mine))"
register("c17_intents", lambda t: history.intents(t("commits")), f", {SQL_OWN} select repo_id, {SQL_INTENT} as intent, count(*) as n from own group by all", ("commits",))
SQL_JUDGE = f"round(avg({SQL_MESSAGE}), 6) as quality, round(avg(regexp_matches({SQL_SUBJECT}, {quoted(fixed.LOW_EFFORT)})::int), 6) as low_effort, round(avg((regexp_matches({SQL_SUBJECT}, {quoted(fixed.CONVENTIONAL)}) and not regexp_matches({SQL_SUBJECT}, {quoted(fixed.LOW_EFFORT)}))::int), 6) as conventional"
register("g13_message_quality", lambda t: rounded(history.message_scores(t("commits"), t("emails")), "quality", "low_effort", "conventional"), f", {SQL_OWN}{SQL_MINE}{SQL_JUDGED} select repo_id, {SQL_JUDGE} from judged group by repo_id", ("commits", "emails"))
register("f5_longest_gap", lambda t: history.longest_gap(t("commits")), ", g as (select repo_id, (epoch_us(lead(committed_at) over (partition by repo_id order by committed_at, sha)) - epoch_us(committed_at)) // 86400000000 as gap from commits) select repo_id, coalesce(max(gap), 0) as longest_gap from g group by repo_id", ("commits",))
register("f6_burst_days", lambda t: history.burst_days(t("commits"), 2.0, 500).withColumn("day", F.col("day").cast("string")), f", {SQL_OWN}, d as (select repo_id, committed_at::date as day, sum(size)::bigint as size from own group by all), m as (select repo_id, median(size) as middle from d group by repo_id) select d.repo_id, day::varchar as day, size from d join m using (repo_id) where middle > 0 and size > middle * 2.0 and size > 500", ("commits",))
register("f7_timeline", lambda t: history.timeline(t("commits")), f", {SQL_OWN}, e as (select repo_id, min(epoch_us(committed_at)) / 1e6 as a, max(epoch_us(committed_at)) / 1e6 as b from own group by repo_id), p as (select c.repo_id, least(23, floor((epoch_us(committed_at) / 1e6 - a) / (greatest(b - a, 86400.0) / 24)))::int as bucket, size as n from own c join e using (repo_id)), f as (select repo_id, bucket, count(*) as n_commits, sum(n)::bigint as n_lines from p group by all), g as (select repo_id, unnest(generate_series(0, 23))::int as bucket from e) select g.repo_id, g.bucket, coalesce(n_commits, 0) as n_commits, coalesce(n_lines, 0) as n_lines from g left join f using (repo_id, bucket)", ("commits",))
register("f8_commit_shares", lambda t: rounded(history.commit_shares(t("commits")), "first_share", "largest_share"), f", {SQL_OWN}, r as (select *, row_number() over (partition by repo_id order by committed_at, sha) as place from own) select repo_id, round(max(case when place = 1 then size end) / greatest(1, sum(size)), 6) as first_share, round(max(size) / greatest(1, sum(size)), 6) as largest_share from r group by repo_id", ("commits",))
register("g17_contributors", lambda t: history.contributors(t("commits")), f", {SQL_OWN}, b as (select repo_id, lower(author_email) as author_email, count(*) as n_commits from own group by all) select * from (select *, row_number() over (partition by repo_id order by n_commits desc, author_email) as place from b) where place <= 5", ("commits",))
register("g17_candidate_share", lambda t: rounded(history.candidate_share(t("commits"), t("emails")), "share"), f", {SQL_OWN}{SQL_MINE}, m as (select repo_id, count(*) as k from mine group by all) select repo_id, round(coalesce(any_value(k), 0) / count(*), 6) as share from own left join m using (repo_id) group by repo_id", ("commits", "emails"))
SQL_HISTORY = f"""{SQL_OWN}{SQL_MINE}{SQL_JUDGED},
w as (select repo_id, count(distinct committed_at::date) as active_days, greatest(1, (max(epoch_us(committed_at)) - min(epoch_us(committed_at))) // 86400000000) as span_days, count(*) as all_commits from commits group by all),
c as (select repo_id, count(*) as commit_count, count(distinct lower(author_email)) as contributor_count, median(size) as median_commit_size, max(size) / greatest(1, sum(size)) as largest_share from own group by all),
fs as (select repo_id, arg_min(size, {{'a': committed_at, 's': sha}}) as first_size, greatest(1, sum(size)) as total from own group by all),
jm as (select repo_id, avg({SQL_MESSAGE}) as quality from judged group by all),
k as (select repo_id, count(*) as k from mine group by all),
dy as (select repo_id, committed_at::date as day, sum(size) as size from own group by all),
bu as (select repo_id, count(*) as burst_days from dy join (select repo_id, median(size) as middle from dy group by all) using (repo_id) where middle > 0 and size > 8 * middle and size > 1500 group by all),
ph as (select repo_id, list(distinct {SQL_INTENT}) as seen from own group by all),
hs as (select w.*, coalesce(commit_count, 0) as commit_count, coalesce(contributor_count, 0) as contributor_count, coalesce(largest_share, 0) as largest_share, coalesce(first_size / total, 0) as first_share, coalesce(quality, 0) as quality, coalesce(k / commit_count, 0) as share, coalesce(burst_days, 0) as burst_days, seen
  from w left join c using (repo_id) left join fs using (repo_id) left join jm using (repo_id) left join k using (repo_id) left join bu using (repo_id) left join ph using (repo_id))"""
register("g14_history_signals", lambda t: rounded(history.history_signals(t("commits"), t("emails")).select("repo_id", "active_days", "span_days", "all_commits", "commit_count", "contributor_count", "largest_share", "first_share", "quality", "share", "burst_days"), "largest_share", "first_share", "quality", "share"),
    f", {SQL_HISTORY} select repo_id, active_days, span_days, all_commits, commit_count, contributor_count, round(largest_share, 6) as largest_share, round(first_share, 6) as first_share, round(quality, 6) as quality, round(share, 6) as share, burst_days from hs", ("commits", "emails"))
register("g14_history_score", lambda t: rounded(history.history_score(t("commits"), t("branches"), t("tags"), t("emails")), "score"),
    f""", {SQL_HISTORY},
b as (select repo_id, count(*) filter (not (regexp_extract(name, '[^/]*$') in ({listed(fixed.KNOWN_BRANCHES)}))) as nb from branches group by repo_id), g as (select repo_id, count(*) as nt from tags group by repo_id)
select r.repo_id, case when commit_count is not null then round(greatest(0, least(100, 0.18e0 * {sql_scale("commit_count", 1, 60)} + 0.20e0 * (0.6e0 * {sql_scale("active_days", 1, 30)} + 0.4e0 * {sql_scale("active_days / span_days", 0, 0.35)}) + 0.22e0 * quality * 100 + 0.15e0 * {sql_scale("largest_share", 0.95, 0.25)}
 + 0.12e0 * {sql_scale("coalesce(nb, 0)", 0, 4)} + 0.13e0 * {sql_scale("coalesce(nt, 0)", 0, 3)})), 6) end as score, case when commit_count >= 5 then 0.9 when commit_count is not null then 0.55 else 0 end::double as confidence
from (select repo_id from commits union select repo_id from branches union select repo_id from tags) r left join hs using (repo_id) left join b using (repo_id) left join g using (repo_id)""", ("commits", "branches", "tags", "emails"))
register("g15_evolution", lambda t: history.evolution_score(t("commits")).select("repo_id", r6("score").alias("score"), F.array_join("phases", ",").alias("phases")),
    f", {SQL_OWN}, i as (select repo_id, list(distinct " + SQL_INTENT + ") as seen from own group by repo_id) select repo_id, round(" + " + ".join(f"case when list_has_any(seen, [{listed(n)}]) then {w * 100}e0 else 0 end" for _, n, w in history.PHASES) + ", 6) as score, array_to_string(list_filter([" + ", ".join(f"case when list_has_any(seen, [{listed(n)}]) then '{p}' end" for p, n, _ in history.PHASES) + "], lambda x: x is not null), ',') as phases from i", ("commits",))
register("g16_rework", lambda t: rounded(history.rework(t("commit_files")), "share", "strength"), ", p as (select repo_id, path, count(distinct sha) as n from commit_files group by all), s as (select repo_id, avg((n > 1)::int) as share from p group by repo_id) select repo_id, round(share, 6) as share, round(least(1.0, share / 0.5), 6) as strength from s", ("commit_files",))

# -- similarity

register("f3_winnowing", lambda t: t("files").select("repo_id", "path", F.array_join(similarity.winnowed("text"), ",").alias("fingerprints")),
    f""", u as (select repo_id, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '(?s)\"\"\".*?\"\"\"', ' ', 'g'), '(?s)''''''.*?''''''', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '#[^\\n]*', ' ', 'g') as s from files),
tok as (select repo_id, path, regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*|[^\\sA-Za-z0-9_]') as tk from u),
one as (select repo_id, path, unnest(tk) as t, unnest(generate_series(1, len(tk))) as i from tok),
gram as (select repo_id, path, i, substr(md5(string_agg(t, ' ') over w), 1, 16) as h, count(*) over w as n from one window w as (partition by repo_id, path order by i rows between current row and 11 following)),
least_of as (select repo_id, path, min(h) over w as h, count(*) over w as n, count(*) over (partition by repo_id, path) as grams from gram where n = 12 window w as (partition by repo_id, path order by i rows between current row and 7 following)),
kept as (select repo_id, path, array_to_string(list_sort(list(distinct h)), ',') as fingerprints from least_of where n = 8 or grams < 8 group by all),
small as (select repo_id, path, min(h) as h, count(*) as n from gram where n = 12 group by all)
select f.repo_id, f.path, case when small.n <= 8 then small.h else coalesce(kept.fingerprints, '') end as fingerprints from files f left join kept on f.repo_id = kept.repo_id and f.path = kept.path left join small on f.repo_id = small.repo_id and f.path = small.path""", ("files",))
register("g39_near_duplicates", lambda t: rounded(similarity.near_duplicates(similarity.chunks(t("files")))[0], "similarity"))
SQL_CHUNKS = f"""{ORACLES["f3_winnowing"].split("select f.repo_id, f.path")[0]}, ch as (select f.repo_id, f.path, string_split(case when small.n <= 8 then small.h else kept.fingerprints end, ',') as fp from files f left join kept on f.repo_id = kept.repo_id and f.path = kept.path left join small on f.repo_id = small.repo_id and f.path = small.path where coalesce(small.h, kept.fingerprints) is not null),
st as (select repo_id, min(path) as id, fp from ch group by repo_id, fp)"""
register("g39_members", lambda t: similarity.near_duplicates(similarity.chunks(t("files")))[1])
ORACLES["g39_members"] = f"{SQL_CHUNKS} select ch.repo_id, ch.path, st.id from ch join st on ch.repo_id = st.repo_id and ch.fp = st.fp"
ORACLES["g39_near_duplicates"] = f"{SQL_CHUNKS} select a.repo_id, a.id as a, b.id as b, round(len(list_intersect(a.fp, b.fp)) / len(list_distinct(a.fp || b.fp)), 6) as similarity from st a join st b on a.repo_id = b.repo_id and a.id < b.id where len(list_intersect(a.fp, b.fp)) >= 0.55 * len(list_distinct(a.fp || b.fp))"
register("g38_hash_embedding", lambda t: rounded(similarity.hash_embedding(t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))), "value"),
    """with w as (select p_partkey as id, list_transform(regexp_extract_all(concat_ws(' ', p_name, p_type, p_brand), '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x)) as w from part),
f as (select id, unnest(w) as feature from w union all select id, w[i] || ' ' || w[i + 1] from (select id, w, unnest(generate_series(1, len(w) - 1)) as i from w where len(w) > 1)),
c as (select id, feature, count(*) as n from f group by all),
r as (select id, ('0x' || substr(md5(feature), 1, 8))::bigint % 256 as dim, sum((1 + ln(n)) * case when ('0x' || substr(md5(feature), 9, 1))::int >= 8 then -1 else 1 end) as v from c group by all)
select id, dim, round(case when sqrt(sum(v * v) over (partition by id)) > 0 then v / sqrt(sum(v * v) over (partition by id)) else 0 end, 6) as value from r""")
register("h4_top_similar", lambda t: rounded(similarity.top_similar(t("vectors").where("id % 100 = 0"), t("vectors")).select("query_id", "place", "id", "similarity"), "similarity"),
    "select * from (select q.id as query_id, row_number() over (partition by q.id order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.id) as place, v.id as id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity from vectors q join vectors v on q.repo_id <> v.repo_id where q.id % 100 = 0) where place <= 5", ("vectors",))
# -- security

register("g33_secrets", lambda t: rounded(security.dedupe_findings(security.scan_secrets(lines.lines_of(t("files")))).drop("value_hash"), "confidence"))
# -- graphs

register("g28_degrees", lambda t: graph.degrees(t("edges").distinct()), ", d as (select distinct repo_id, src, dst from edges), e as (select repo_id, src as node, 1 as o, 0 as i from d union all select repo_id, dst, 0, 1 from d) select repo_id, node, sum(o)::bigint as fan_out, sum(i)::bigint as fan_in from e group by all", ("edges",))
register("g28_hubs", lambda t: graph.hubs(t("edges").distinct()), ", d as (select distinct repo_id, src, dst from edges), n as (select repo_id, dst as node, count(*)::bigint as fan_in from d group by all) select * from (select repo_id, row_number() over (partition by repo_id order by fan_in desc, node) as place, node, fan_in from n) where place <= 5", ("edges",))
register("g29_mutual_imports", lambda t: graph.mutual_imports(t("edges").distinct()), ", d as (select distinct repo_id, src, dst from edges) select distinct a.repo_id, a.src as a, a.dst as b from d a join d b on a.repo_id = b.repo_id and a.src = b.dst and a.dst = b.src where a.src < a.dst", ("edges",))
register("g29_import_cycles", lambda t: graph.import_cycles(t("edges").distinct()))

# -- scores

register("g61_policy_weights", lambda t: rounded(scoring.policy_weights(t("policies").groupBy("policy_key", "category").agg(F.sum("weight").alias("weight"))), "weight"), ", p as (select policy_key, category, sum(weight) as weight from policies group by all) select policy_key, category, round(weight / sum(weight) over (partition by policy_key), 6) as weight from p", ("policies",))


def _overall(t) -> DataFrame:
    weights = scoring.policy_weights(t("policies").where("policy_key = 'Brand#1'").groupBy("policy_key", "category").agg(F.sum("weight").alias("weight")))
    last = serving.latest(t("category_scores"), ["evaluation_id", "category"], [F.desc("created_at"), F.desc("score_id")])
    return rounded(scoring.overall_score(last, weights.drop("policy_key")), "score", "coverage", "confidence")


SQL_LATEST = "last as (select * from category_scores qualify row_number() over (partition by evaluation_id, category order by created_at desc, score_id desc) = 1)"
register("g59_overall_score", _overall, f""", {SQL_LATEST}, p as (select category, sum(weight) as w from policies where policy_key = 'Brand#1' group by all), q as (select category, w / (select sum(w) from p) as weight from p),
j as (select evaluation_id, sum(case when score is not null then score * weight end) as s, sum(case when score is not null then weight end) as w, sum(weight) as aw, sum(case when score is not null then confidence * weight end) as c from last join q using (category) group by evaluation_id)
select evaluation_id, round(case when w > 0 then s / w end, 6) as score, round(coalesce(w, 0) / aw, 6) as coverage, round(case when w > 0 then c / w * (0.55 + 0.45 * coalesce(w, 0) / aw) end, 6) as confidence from j""", ("category_scores", "policies"))
register("f9_latest", lambda t: serving.latest(t("category_scores"), ["evaluation_id", "category"], [F.desc("created_at"), F.desc("score_id")]).select("evaluation_id", "category", "score", "score_id"), f", {SQL_LATEST} select evaluation_id, category, score, score_id from last", ("category_scores",))
register("g72_repository_score", lambda t: rounded(scoring.repository_score(t("category_scores")), "score"), "select evaluation_id, round(avg(score), 6) as score, count(score) as n_available from category_scores group by evaluation_id", ("category_scores",))
SQL_CLASS = "case when ownership is null then 'INSUFFICIENT_EVIDENCE' when likelihood < 35 then 'AI_ASSISTED' when likelihood < 60 and ownership >= 75 then 'AI_ASSISTED' when likelihood < 60 then 'AI_AUGMENTED' when ownership >= 70 then 'AI_AUGMENTED' when likelihood < 78 or ownership >= 45 then 'AI_DEPENDENT' else 'AI_DOMINATED' end"
register("g60_verification", lambda t: scoring.verification_status(t("evaluations").select("evaluation_id", F.floor(F.col("coverage") * 9).alias("n_available"), F.when(F.col("evaluation_id") % 5 > 0, F.col("ownership")).alias("ownership"), F.when(F.col("evaluation_id") % 3 > 0, F.col("overall") / 100).alias("similarity"), "likelihood", (F.col("evaluation_id") % 2 == 0).alias("disclosed"))),
    f""", e as (select evaluation_id, floor(coverage * 9) as n, case when evaluation_id % 5 > 0 then ownership end as ownership, case when evaluation_id % 3 > 0 then overall / 100 end as similarity, likelihood, evaluation_id % 2 = 0 as disclosed from evaluations),
c as (select *, coalesce(ownership < 45, false) as ov, coalesce(ownership < 65, false) as ow, coalesce(similarity >= 0.75, false) as sv, coalesce(similarity >= 0.55, false) as sr, likelihood >= 65 and {SQL_CLASS} in ('AI_DEPENDENT', 'AI_DOMINATED') as lv, likelihood >= 65 and not disclosed as lr from e)
select evaluation_id, case when n < 4 then 'ANALYSIS_INCOMPLETE' when ov or sv or lv then 'VERIFICATION_REQUIRED' when ow or sr or lr then 'REVIEW_RECOMMENDED' else 'CLEAR' end as status, case when n < 4 then 'too few categories' else array_to_string(list_filter([case when ov then 'ownership insufficient' when ow then 'ownership limited' end, case when sv then 'close external match' when sr then 'external match' end, case when lv then 'dependent on assistance' when lr then 'undisclosed assistance' end], lambda x: x is not null), '; ') end as reasons from c""", ("evaluations",))
register("c30_assistance_class", lambda t: t("evaluations").groupBy(scoring.assistance_class(F.col("likelihood"), F.col("ownership")).alias("class")).agg(F.count(F.lit(1)).alias("n")), f"select {SQL_CLASS} as class, count(*) as n from evaluations group by all", ("evaluations",))
register("c32_disclosure", lambda t: t("evaluations").select("evaluation_id", scoring.disclosure_alignment(F.col("evaluation_id") % 3 == 0, F.col("likelihood")).alias("alignment")), "select evaluation_id, case when evaluation_id % 3 = 0 and likelihood >= 45 then 'consistent' when evaluation_id % 3 = 0 then 'declared_more_than_observed' when likelihood >= 65 then 'signals_above_declaration' else 'consistent' end as alignment from evaluations", ("evaluations",))


SQL_STRENGTH = "st as (select repo_id, skill, least(1.0, max(value)) as strength from strengths group by all)"


def _strengths(t) -> DataFrame:
    return t("strengths").groupBy("repo_id", "skill").agg(F.least(F.lit(1.0), F.max("value")).alias("strength"))


def _requirements(t) -> DataFrame:
    return t("part").select((F.col("p_partkey") % 25).alias("job_id"), F.concat(F.lit("skill"), (F.col("p_partkey") % 60).cast("string")).alias("skill"), F.col("p_size").alias("importance"), (F.col("p_partkey") % 3 == 0).alias("required")).groupBy("job_id", "skill").agg(F.sum("importance").cast("double").alias("importance"), F.bool_or("required").alias("required"))


register("g56_job_match", lambda t: rounded(scoring.job_match(_requirements(t), _strengths(t)), "score", "required_coverage"), f", {SQL_STRENGTH}, rq as (select p_partkey % 25 as job_id, 'skill' || (p_partkey % 60) as skill, sum(p_size)::double as importance, bool_or(p_partkey % 3 = 0) as required from part group by all), b as (select rq.job_id, r.repo_id, importance, required, coalesce(strength, 0) as strength, strength is not null as met from rq cross join (select distinct repo_id from st) r left join st on st.repo_id = r.repo_id and st.skill = rq.skill) select job_id, repo_id, round(100 * sum(strength * importance) / sum(importance), 6) as score, count(*) filter (strength >= 0.2) as n_matched, count(*) filter (strength < 0.2 and required) as n_missing, round(avg(case when required then (strength >= 0.2)::int end), 6) as required_coverage from b group by all having bool_or(met)", ("strengths",))
register("e13_best_strength", lambda t: rounded(_strengths(t).groupBy("skill").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n_repositories")), "strength"), f", {SQL_STRENGTH} select skill, round(max(strength), 6) as strength, count(*) as n_repositories from st group by skill", ("strengths",))
register("e11_weighted_portfolio", lambda t: rounded(scoring.weighted_over_repositories(t("category_scores").select((F.col("evaluation_id") % 30).alias("owner_id"), "category", "score", (F.col("score_id") % 200).alias("n_files"))), "score"), "select evaluation_id % 30 as owner_id, category, round(sum(score * least(3.0, 0.5 + (score_id % 200) / 60.0)) / sum(least(3.0, 0.5 + (score_id % 200) / 60.0)), 6) as score from category_scores where score is not null group by all", ("category_scores",))
register("f10_policy_versions", lambda t: scoring.policy_versions(t("overrides").select(F.col("category").alias("policy_key"), (F.col("evaluation_id") % 50).alias("organization_id"), "created_at", F.concat_ws("-", "evaluation_id", "override_id").alias("event_id")).distinct()).select("policy_key", "organization_id", "event_id", "version", "is_current"), ", e as (select distinct category as policy_key, evaluation_id % 50 as organization_id, created_at, evaluation_id || '-' || override_id as event_id from overrides) select policy_key, organization_id, event_id, row_number() over w as version, lead(event_id) over w is null as is_current from e window w as (partition by organization_id, policy_key order by created_at, event_id)", ("overrides",))
register("g75_overrides", lambda t: scoring.apply_overrides(t("category_scores").select("evaluation_id", "category", "score").distinct(), t("overrides")), ", o as (select evaluation_id, category, arg_max(new_score, {'a': created_at, 'b': override_id}) as new_score from overrides group by all) select distinct s.evaluation_id, s.category, coalesce(new_score, score) as score, score as original_score, new_score is not null as overridden from category_scores s left join o using (evaluation_id, category)", ("category_scores", "overrides"))

# -- serving

register("j8_ranked_evaluations", lambda t: serving.ranked(t("evaluations").where("overall >= 40 and job_id in (1, 2, 3)"), ["overall"], "evaluation_id", 50).select("place", "evaluation_id", "overall"), "select * from (select row_number() over (order by overall desc nulls last, evaluation_id) as place, evaluation_id, overall from evaluations where overall >= 40 and job_id in (1, 2, 3)) where place <= 50", ("evaluations",))
register("e19_best_evaluation", lambda t: t("evaluations").where("overall is not null").groupBy("candidate_id").agg(F.max_by("evaluation_id", F.struct("overall", "evaluation_id")).alias("evaluation_id"), F.max("overall").alias("overall")), "select candidate_id, arg_max(evaluation_id, {'a': overall, 'b': evaluation_id}) as evaluation_id, max(overall) as overall from evaluations where overall is not null group by candidate_id", ("evaluations",))
register("d15_compare", lambda t: rounded(serving.compare(t("category_scores").where("evaluation_id in (1, 2, 4, 5)"), [1, 2, 4, 5]), "e1", "e2", "e4", "e5"), "select category, " + ", ".join(f"round(avg(score) filter (evaluation_id = {i}), 6) as e{i}" for i in (1, 2, 4, 5)) + " from category_scores where evaluation_id in (1, 2, 4, 5) group by category", ("category_scores",))
register("e18_tiles", lambda t: rounded(t("evaluations").groupBy("job_id").agg(F.avg("overall").alias("mean_overall"), F.count_if((F.col("ownership") < 60) & (F.col("coverage") >= 0.5)).alias("to_verify"), F.count(F.lit(1)).alias("n")), "mean_overall"), "select job_id, round(avg(overall), 6) as mean_overall, count(*) filter (ownership < 60 and coverage >= 0.5) as to_verify, count(*) as n from evaluations group by job_id", ("evaluations",))
register("j23_audit_page", lambda t: serving.page(t("audit").where("action = 'click'"), [F.desc("created_at"), F.desc("event_id")], 20, 40).select("event_id", "actor_id", "total"), "select event_id, actor_id, (select count(*) from audit where action = 'click') as total from audit where action = 'click' order by created_at desc, event_id desc limit 20 offset 40", ("audit",))
register("e1_failures_by_action", lambda t: serving.recent_counts(t("audit"), "action", 24), ", m as (select max(created_at) as m from audit) select action, count(*) as n, count(distinct actor_id) as n_actors from audit, m where created_at > m - interval 24 hour group by action", ("audit",))
register("k3_windows_over_limit", lambda t: serving.over_limit(t("audit"), 3600, 2).select("actor_id", "window_start", "n"), "select actor_id, (epoch_us(created_at) // 3600000000) * 3600 as window_start, count(*) as n from audit group by all having count(*) > 2", ("audit",))
register("k4_daily_volume", lambda t: t("commits").groupBy("repo_id", F.to_date("committed_at").cast("string").alias("day")).agg(F.sum(F.col("insertions") + F.col("deletions")).alias("size"), F.count(F.lit(1)).alias("n")), "select repo_id, committed_at::date::varchar as day, sum(insertions + deletions)::bigint as size, count(*) as n from commits group by all", ("commits",))
register("k5_last_status", lambda t: t("audit").groupBy("actor_id").agg(F.max_by("action", F.struct("created_at", "event_id")).alias("status"), F.max("event_id").alias("last_event")), "select actor_id, arg_max(action, {'a': created_at, 'b': event_id}) as status, max(event_id) as last_event from audit group by actor_id", ("audit",))
register("b16_search", lambda t: serving.search(t("customer"), "bUILD", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where contains(lower(c_name), 'build') or contains(lower(c_mktsegment), 'build')")
register("d9_semi_join", lambda t: t("evaluations").join(t("emails").select(F.regexp_extract("email", r"\d+", 0).cast("long").alias("candidate_id")), "candidate_id", "left_semi").select("evaluation_id", "candidate_id"), "select evaluation_id, candidate_id from evaluations where candidate_id in (select regexp_extract(email, '\\d+')::bigint from emails)", ("evaluations", "emails"))
register("d10_anti_join", lambda t: t("category_scores").select("evaluation_id", "category").distinct().join(t("overrides").select("evaluation_id", "category"), ["evaluation_id", "category"], "left_anti"), "select distinct evaluation_id, category from category_scores where (evaluation_id, category) not in (select evaluation_id, category from overrides)", ("category_scores", "overrides"))
register("b15_visible", lambda t: serving.visible(t("customer").select("c_custkey", F.col("c_nationkey").alias("organization_id"), (F.col("c_custkey") % 50).alias("owner_id")), t("supplier").select(F.col("s_nationkey").alias("organization_id"), (F.col("s_suppkey") % 10).alias("user_id")), 7).select("c_custkey"), "select c_custkey from customer where c_custkey % 50 = 7 or c_nationkey in (select s_nationkey from supplier where s_suppkey % 10 = 7)")
register("c36_answer_features", lambda t: rounded(serving.answer_features(t("answers")), "avg_sentence"), "select session_id, question_id, len(regexp_extract_all(answer_text, '[^.!?]+'))::int as n_sentences, len(regexp_extract_all(answer_text, '[^ \\t\\n\\x0B\\f\\r]+'))::int as n_words, round(len(regexp_extract_all(answer_text, '[^ \\t\\n\\x0B\\f\\r]+')) / greatest(1, len(regexp_extract_all(answer_text, '[^.!?]+'))), 6) as avg_sentence, len(regexp_extract_all(answer_text, '(?i)\\b(because|therefore|trade-?off|instead|measured)\\b'))::int as n_markers from answers where role = 'user'", ("answers",))
register("i5_distinct_first", lambda t: serving.latest(t("commits"), ["repo_id", "author_email"], [F.asc("committed_at"), F.asc("sha")]).select("repo_id", "author_email", "sha"), "select repo_id, author_email, sha from commits qualify row_number() over (partition by repo_id, author_email order by committed_at, sha) = 1", ("commits",))
register("e16_totals", lambda t: serving.totals({n: t(n) for n in ("files", "commits", "evaluations", "audit")}), "select 'files' as name, count(*) as n from files union all select 'commits', count(*) from commits union all select 'evaluations', count(*) from evaluations union all select 'audit', count(*) from audit", ("files", "commits", "evaluations", "audit"))


# -- skills

SQL_TERMS = "terms(term, skill, size, rank, words) as (values " + ", ".join(f"({quoted(t)}, '{k}', {size}, {rank}, {n})" for t, k, size, rank, n in skills.skill_terms()) + ")"
LONGEST_TERM = max(x[4] for x in skills.skill_terms())


def sql_skills(source: str) -> str:
    """mentions of the table source (id, text): hits in order of size, each kept if it touches none that was kept before."""
    return f"""{SQL_TERMS}, ws as (select id, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9+#_]+', ' ', 'g')), ' '), lambda x: x <> '') as w from {source}),
runs as (select id, i as spot, n, array_to_string(w[i:i + n - 1], ' ') as term from (select id, w, unnest(generate_series(1, len(w))) as i from ws where len(w) > 0), generate_series(1, {LONGEST_TERM}) g(n) where i + n - 1 <= len(w)),
hits as (select id, list_sort(list({{'less': -size, 'rank': rank, 'spot': spot, 'n': n, 'term': term, 'skill': skill}})) as h from runs join terms using (term) group by id),
kept as (select id, unnest(list_reduce(h, lambda taken, x: case when len(list_filter(taken, lambda y: y.spot < x.spot + x.n and x.spot < y.spot + y.n)) = 0 then list_append(taken, x) else taken end, list_filter(h, lambda x: false))) as m from hits),
skills as (select id, m.skill as skill, count(*) as n_mentions, array_to_string(list_sort(list(distinct m.term)), ',') as terms from kept group by all)"""


SQL_CLOSURE = "cl(skill, implied) as (values " + ", ".join(f"('{a}', '{b}')" for a, bs in skills.closure().items() for b in bs) + ")"
register("g50_skills", lambda t: skills.extract(t("notes")).withColumn("terms", F.array_join("terms", ",")), f", {sql_skills('notes')} select * from skills", ("notes",))
register("g51_implied_skills", lambda t: skills.with_implied(skills.extract(t("notes"))), f", {sql_skills('notes')}, {SQL_CLOSURE} select id, implied as skill, bool_or(skills.skill = implied) as direct from skills join cl using (skill) group by all", ("notes",))
register("g64_resume_consistency", lambda t: rounded(skills.resume_consistency(_requirements(t).select(F.concat(F.lit("repo"), F.col("job_id").cast("string")).alias("candidate_id"), "skill", F.least(F.lit(1.0), F.col("importance") / 60).alias("expected")), _strengths(t).withColumnRenamed("repo_id", "candidate_id")), "strength"),
    f", {SQL_STRENGTH}, cm as (select 'repo' || (p_partkey % 25) as candidate_id, 'skill' || (p_partkey % 60) as skill, least(1.0, sum(p_size) / 60) as expected from part group by all), j as (select candidate_id, cm.skill, expected, coalesce(strength, 0) as strength from cm left join st on st.repo_id = candidate_id and st.skill = cm.skill), u as (select repo_id as candidate_id, skill, strength from st where strength >= 0.5 and not exists (select 1 from cm where cm.candidate_id = st.repo_id and cm.skill = st.skill) qualify row_number() over (partition by repo_id order by strength desc, skill) <= 10) select candidate_id, skill, round(strength, 6) as strength, case when strength >= expected then 'supported' when strength >= expected / 2 then 'partial' else 'verify' end as state from j union all select candidate_id, skill, round(strength, 6), 'unclaimed' from u", ("strengths",))
register("k2_sliding_activity", lambda t: t("audit").groupBy(F.window("created_at", "24 hours", "12 hours").alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "action", "n"), ", s as (select action, (epoch_us(created_at) // 43200000000 - k) * 43200000000 as start_us from audit, generate_series(0, 1) g(k)) select start_us, action, count(*) as n from s group by all", ("audit",))
register("b13_pinned", lambda t: t("dependencies").groupBy("repo_id").agg(F.count_if(dependencies.is_pinned()).alias("n_pinned"), F.count(F.lit(1)).alias("n")), "select repo_id, count(*) filter (version_spec <> '' and not regexp_matches(version_spec, '^[~^>*]|^latest$')) as n_pinned, count(*) as n from dependencies group by repo_id", ("dependencies",))
register("g25_dependency_categories", lambda t: dependencies.categories(t("dependencies")), ", d as (select distinct repo_id, name, regexp_extract(name, '[^/]*$') as last from dependencies) " + " union all ".join(f"select repo_id, '{c}' as category, name from d where " + " or ".join(f"name = '{m}' or starts_with(name, '{m}-') or starts_with(name, '@{m}/') or contains(last, '{m}')" for m in ms.split()) for c, ms in fixed.DEPENDENCY_CATEGORIES.items()), ("dependencies",))
register("j14_disclosure_latest", lambda t: serving.latest(t("evaluations"), ["candidate_id"], [F.desc("created_at"), F.desc("evaluation_id")]).select("candidate_id", "evaluation_id", scoring.disclosure_alignment(F.col("candidate_id") % 2 == 0, F.col("likelihood")).alias("alignment")), "select candidate_id, evaluation_id, case when candidate_id % 2 = 0 and likelihood >= 45 then 'consistent' when candidate_id % 2 = 0 then 'declared_more_than_observed' when likelihood >= 65 then 'signals_above_declaration' else 'consistent' end as alignment from evaluations qualify row_number() over (partition by candidate_id order by created_at desc, evaluation_id desc) = 1", ("evaluations",))
