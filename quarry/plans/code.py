"""Registered queries over the files of the view code: structure, quality, tests, architecture, security, ownership, evidence."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import braces, classify, dependencies, graph, history, lines, measures, ownership, scoring, security, similarity, skills, structure
from . import project
from .domain import VIEWS
from .queries import ORACLES, SQL_CATEGORY, SQL_LANGUAGE, SQL_REASON, listed, quoted, r6, register, rounded, sql_scale

_base, _columns = VIEWS["code"]
SQL_CODE = f"code as (select {', '.join(f'{e} as {c}' for c, e in _columns.items())} from {_base})"
SQL_FILES = f"named as (select *, {SQL_LANGUAGE} as language, {SQL_REASON} as skipped_reason from code), fl as (select *, {SQL_CATEGORY} as category from named)"


def register_code(name: str, run, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    register(name, run, None)
    if sql is not None:
        more = "".join(f",\n{v} as (select {', '.join(f'{e} as {c}' for c, e in VIEWS[v][1].items())} from {VIEWS[v][0]})" for v in views)
        ORACLES[name] = f"with {SQL_CODE}{more},\n{sql}"


SQL_LINES = "all_lines as (select repo_id, path, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) as int) as line_no, unnest(string_split(text, chr(10))) as line from code where text is not null)"
def _nonempty(pattern: str) -> str:
    return f"nullif(regexp_extract(header, {quoted(pattern)}, 1), '')"


SQL_BRACES = f"""bt as (select repo_id, path, unnest(regexp_extract_all(text, {quoted(braces.TOKEN)})) as tok, unnest(range(len(regexp_extract_all(text, {quoted(braces.TOKEN)})))) as pos from (select *, {SQL_LANGUAGE} as language from code) where language in ({listed([x for x in fixed.PARSED if x != 'python'])})),
bl as (select *, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) over (partition by repo_id, path order by pos rows between unbounded preceding and 1 preceding), 0)::int as line_no from bt),
bc as (select *, coalesce(lag(regexp_matches(tok, '{braces.COMMENT}')) over (partition by repo_id, path order by pos), false) as commented from bl where tok <> chr(10)),
bd as (select *, sum(case tok when '{{' then 1 when '}}' then -1 else 0 end) over (partition by repo_id, path order by pos) as depth, coalesce(sum((tok in ('{{', '}}', ';'))::int) over (partition by repo_id, path order by pos rows between unbounded preceding and 1 preceding), 0) as statement, max(line_no) over (partition by repo_id, path) as last from bc where not regexp_matches(tok, '{braces.COMMENT}')),
bh as (select repo_id, path, max(pos) filter (tok = '{{') as pos, coalesce(string_agg(tok, ' ' order by pos) filter (tok <> '{{'), '') as header, arg_min(line_no, pos) as start_line, arg_min(commented, pos) as has_doc from bd group by repo_id, path, statement having count(*) filter (tok = '{{') > 0),
be as (select *, depth - (tok = '{{')::int as level from bd where tok in ('{{', '}}')),
bo as (select repo_id, path, pos, tok, case when lead(tok) over w = '}}' then lead(line_no) over w else last end as end_line from be window w as (partition by repo_id, path, level order by pos)),
bn as (select bh.*, end_line, regexp_matches(header, {quoted(braces.CLASS)}) as is_class, {_nonempty(braces.FUNCTIONS[2])} as method, coalesce({', '.join(_nonempty(p) for p in (braces.CLASS, *braces.FUNCTIONS[:2]))}, case when regexp_matches(header, {quoted(braces.ANONYMOUS)}) then 'anonymous' end) as named,
  len(list_filter(list_transform(string_split(regexp_extract(regexp_replace(header, '\\{{[^{{}}]*\\}}', 'o', 'g'), {quoted(braces.PARAMS)}, 1), ','), lambda x: trim(x, ' ')), lambda x: x <> ''))::int as given from bh join bo using (repo_id, path, pos) where bo.tok = '{{'),
bs as (select *, coalesce(named, case when method not in ({listed(braces.CONTROL)}) and string_split(header, ' ')[1] not in ({listed(braces.CONTROL)}) then method end) as symbol from bn),
bf as (select repo_id, path, symbol, case when is_class then 'class' else 'function' end as kind, start_line, end_line, case when is_class then 0 when regexp_matches(header, '[A-Za-z0-9_$] =>$') then 1 else given end as n_params, has_doc from bs where symbol is not null qualify row_number() over (partition by repo_id, path, start_line order by pos) = 1)"""
SQL_ENTITIES = f"""{SQL_LINES},
{SQL_BRACES},
ind as (select *, length(regexp_extract(line, '^(\\s*)', 1)) as indent from all_lines where trim(line, ' ') <> ''),
heads as (select repo_id, path, line_no as start_line, indent as own, regexp_extract(line, {quoted(fixed.HEADER)}, 2) as kind, regexp_extract(line, {quoted(fixed.HEADER)}, 3) as symbol, regexp_extract(line, '\\(([^)]*)\\)?', 1) as params from ind where regexp_matches(line, {quoted(fixed.HEADER)}) and path in (select path from (select path, {SQL_LANGUAGE} as language from code) where language = 'python')),
stops as (select h.repo_id, h.path, start_line, min(line_no) as stop from heads h join ind i on h.repo_id = i.repo_id and h.path = i.path and line_no > start_line and indent <= own group by all),
ends as (select repo_id, path, max(line_no) as last_line from ind group by all),
outer_found as (select h.repo_id, h.path, symbol, kind, params, h.start_line, coalesce(stop - 1, last_line)::int as end_line from heads h join ends e on h.repo_id = e.repo_id and h.path = e.path left join stops s on h.repo_id = s.repo_id and h.path = s.path and h.start_line = s.start_line),
nexts as (select o.repo_id, o.path, o.start_line, arg_min(line, line_no) as first from outer_found o join ind i on o.repo_id = i.repo_id and o.path = i.path and line_no > o.start_line and line_no <= o.end_line group by all),
ups as (select repo_id, path, line_no + 1 as start_line, line as above from all_lines),
parents as (select a.repo_id, a.path, a.start_line, max(b.start_line) as parent from outer_found a join outer_found b on a.repo_id = b.repo_id and a.path = b.path and b.start_line < a.start_line and a.start_line <= b.end_line group by all),
found as (select o.repo_id, o.path, symbol, kind, o.start_line, end_line, len(list_filter(list_transform(string_split(params, ','), lambda x: trim(x, ' ')), lambda x: x <> '' and x not in ('self', 'cls', 'this')))::int as n_params,
  coalesce(regexp_matches(first, {quoted(fixed.DOC_OPEN)}), false) or coalesce(regexp_matches(above, {quoted(fixed.COMMENT_LINE)}), false) as has_doc, parent
  from outer_found o left join nexts n on o.repo_id = n.repo_id and o.path = n.path and o.start_line = n.start_line left join ups u on o.repo_id = u.repo_id and o.path = u.path and o.start_line = u.start_line left join parents p on o.repo_id = p.repo_id and o.path = p.path and o.start_line = p.start_line
  union all select bf.*, (select max(b.start_line) from bf b where b.repo_id = bf.repo_id and b.path = bf.path and b.start_line < bf.start_line and bf.start_line <= b.end_line) as parent from bf),
bodies as (select f.*, line_no, line from found f join all_lines a on f.repo_id = a.repo_id and f.path = a.path and line_no between start_line and end_line)"""
SQL_COMPLEXITY = f"cx as (select repo_id, path, symbol, start_line, kind, end_line, has_doc, 1 + sum(case when regexp_matches(line, {quoted(fixed.COMMENT_LINE)}) then 0 else len(regexp_extract_all(line, {quoted(fixed.DECISIONS)})) end)::bigint as complexity from bodies group by all)"
SQL_NESTING = """nl as (select repo_id, path, symbol, start_line, list(length(regexp_extract(line, '^(\\s*)', 1)) order by line_no) as w from bodies where trim(line, ' ') <> '' and line_no > start_line group by all),
ne as (select repo_id, path, symbol, start_line, list_reduce(list_transform(w, lambda x: {'stack': [x], 'most': 1}), lambda s, x: {'stack': list_append(list_filter(s.stack, lambda y: y < x.stack[1]), x.stack[1]), 'most': greatest(s.most, len(list_filter(s.stack, lambda y: y < x.stack[1])) + 1)}).most::int as nesting from nl)"""
SQL_TOKENS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)/\*.*?\*/', ' ', 'g'), '(?s)\"\"\".*?\"\"\"', ' ', 'g'), '(?s)''''''.*?''''''', ' ', 'g'), '//[^\n]*', ' ', 'g'), '#[^\n]*', ' ', 'g'), '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`', ' L ', 'g'), '\b\d+(?:\.\d+)?\b', ' L ', 'g')"""


def sql_shape(text: str) -> str:
    return f"list_transform(regexp_extract_all({SQL_TOKENS.format(text)}, '[A-Za-z_][A-Za-z0-9_]*|[^\\sA-Za-z0-9_]'), lambda t: case when regexp_matches(t, '^[A-Za-z_]') and t not in ({listed([*fixed.KEYWORDS, 'L'])}) then 'V' else t end)"


SQL_SIGNED = f"src as (select repo_id, path, symbol, kind, start_line, end_line, string_agg(line, chr(10) order by line_no) as source from bodies group by all), signed as (select *, md5(array_to_string(({sql_shape('source')})[:400], '|')) as signature from src)"
PROFILE = ["repo_id", "path", "symbol", "kind", "start_line", "end_line", "n_params", "has_doc", "parent"]


def _profiled(t) -> DataFrame:
    rows, found = project.rows(t), project.found(t)
    return found.join(structure.entity_complexity(found, rows).select("repo_id", "path", "start_line", "complexity"), ["repo_id", "path", "start_line"])


register_code("g2_entities", project.found, f"{SQL_ENTITIES} select {', '.join(PROFILE)} from found")
register_code("g3_complexity", lambda t: _profiled(t).select("repo_id", "path", "symbol", "start_line", "complexity"), f"{SQL_ENTITIES}, {SQL_COMPLEXITY} select repo_id, path, symbol, start_line, complexity from cx")
register_code("g4_nesting", lambda t: structure.entity_nesting(project.found(t), project.rows(t)), f"{SQL_ENTITIES}, {SQL_NESTING} select * from ne")
register_code("g5_signatures", lambda t: structure.structure_signatures(project.found(t), project.rows(t)).select("repo_id", "path", "start_line", "signature"), f"{SQL_ENTITIES}, {SQL_SIGNED} select repo_id, path, start_line, signature from signed")
SQL_SHAPES = f"tk as (select repo_id, path, unnest({sql_shape('text')}) as token from code), sh as (select repo_id, path, token, 1 + ln(count(*)) as w from tk group by all), nm as (select repo_id, path, sqrt(sum(w * w)) as norm from sh group by all)"


def _path_pairs(t) -> DataFrame:
    """Each file with the next one of its repository, by path."""
    from pyspark.sql import Window

    after = F.lead("path").over(Window.partitionBy("repo_id").orderBy("path"))
    return project.code(t).select("repo_id", F.col("path").alias("a"), after.alias("b")).where("b is not null")


register_code("g6_shape_similarity", lambda t: rounded(structure.shape_similarity(structure.shape_counts(project.code(t)), _path_pairs(t)), "similarity"),
    f"{SQL_SHAPES}, pr as (select repo_id, path as a, lead(path) over (partition by repo_id order by path) as b from code qualify b is not null), dt as (select pr.repo_id, a, b, sum(x.w * y.w) as dot from pr join sh x on x.repo_id = pr.repo_id and x.path = a join sh y on y.repo_id = pr.repo_id and y.path = b and x.token = y.token group by all) select pr.repo_id, pr.a, pr.b, round(coalesce(dot / (n.norm * m.norm), 0), 6) as similarity from pr left join dt on dt.repo_id = pr.repo_id and dt.a = pr.a and dt.b = pr.b left join nm n on n.repo_id = pr.repo_id and n.path = pr.a left join nm m on m.repo_id = pr.repo_id and m.path = pr.b")


def _profile_pairs(t) -> DataFrame:
    rows, found = project.rows(t), project.found(t).where("kind <> 'class'")
    signed = structure.structure_signatures(found, rows)
    wide = signed.join(structure.entity_complexity(found, rows).select("repo_id", "path", "start_line", "complexity"), ["repo_id", "path", "start_line"]).join(structure.entity_nesting(found, rows).select("repo_id", "path", "start_line", "nesting"), ["repo_id", "path", "start_line"], "left")
    profiles = wide.select(F.concat_ws(":", "repo_id", "path", F.col("start_line").cast("string")).alias("id"), "signature", "complexity", "nesting", "n_params", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), "repo_id", "path", "start_line")
    pairs = profiles.groupBy("repo_id", "path").agg(F.min_by("id", "start_line").alias("a"), F.max_by("id", "start_line").alias("b")).where("a <> b").select("a", "b")
    return rounded(structure.profile_similarity(profiles, pairs), "similarity")


register_code("g7_profile_similarity", _profile_pairs)
register_code("g8_clone_groups", lambda t: structure.clone_groups(project.found(t), project.rows(t)), f"{SQL_ENTITIES}, {SQL_SIGNED}, m as (select repo_id, signature, path || ':' || start_line || ' ' || symbol as member from signed where kind <> 'class' and end_line - start_line + 1 >= 6) select repo_id, signature, count(*) as n, array_to_string(list_sort(list(member))[:10], ',') as members from m group by all having count(*) > 1")
SQL_POOR = f"((length(symbol) <= 2 and lower(symbol) not in ({listed(fixed.SHORT_NAMES)})) or lower(symbol) in ({listed(fixed.GENERIC_NAMES)}) or (len(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g'))), ' '), lambda x: x <> '')) = 1 and length(symbol) <= 3 and lower(symbol) not in ({listed(fixed.SHORT_NAMES)})))"
register_code("g10_naming", lambda t: rounded(structure.naming_quality(project.found(t)), "share"), f"{SQL_ENTITIES} select repo_id, round(avg((not {SQL_POOR})::int), 6) as share, count(*) as n from found group by repo_id")
register_code("g11_error_handling", lambda t: rounded(structure.error_handling(project.code(t), project.found(t)), "ratio"), f"{SQL_ENTITIES}, w as (select repo_id, sum(len(regexp_extract_all(text, '\\b(try|catch|except|rescue|recover|finally)\\b'))) as n from code group by repo_id), k as (select repo_id, count(*) as m from found where kind <> 'class' group by repo_id) select repo_id, round(n / m, 6) as ratio from w join k using (repo_id)")
SQL_BLOCKS = """norms as (select repo_id, path, line_no, regexp_replace(regexp_replace(regexp_replace(line, '(#|//).*$', '', 'g'), '"[^"]*"|''[^'']*''', '""', 'g'), '\\s+', '', 'g') as norm from all_lines),
rr as (select repo_id, path, line_no, list(norm) over w as parts, count(*) over w as n from norms where length(norm) > 3 window w as (partition by repo_id, path order by line_no rows between current row and 5 following)),
dup as (select repo_id, 1 - count(distinct array_to_string(parts, chr(10))) / count(*) as duplication from rr where n = 6 and length(array_to_string(parts, chr(10))) >= 60 group by repo_id)"""
SQL_METRICS = f"""{SQL_ENTITIES}, {SQL_COMPLEXITY}, {SQL_NESTING}, {SQL_BLOCKS}, {SQL_FILES},
pf as (select cx.*, nesting from cx left join ne on cx.repo_id = ne.repo_id and cx.path = ne.path and cx.start_line = ne.start_line),
ag as (select repo_id, count(*) filter (kind <> 'class') as functions, count(*) filter (kind = 'class') as classes, avg(complexity) filter (kind <> 'class') as avg_complexity, max(complexity) filter (kind <> 'class') as max_complexity, count(*) filter (kind <> 'class' and complexity > 15) as high_complexity,
  avg(end_line - start_line + 1) filter (kind <> 'class') as avg_lines, count(*) filter (kind <> 'class' and end_line - start_line + 1 > 80) as long_functions, max(nesting) as max_nesting, count(*) filter (kind <> 'class' and has_doc) as documented,
  count(*) filter (kind <> 'class' and end_line - start_line + 1 <= 4 and complexity = 1) as trivial, count(*) filter (kind <> 'class' and end_line - start_line + 1 <= 4 and complexity = 1 and has_doc) as trivial_documented from pf group by repo_id),
pl as (select repo_id, path, count(*) as n, count(*) filter (trim(line, ' ') <> '' and regexp_matches(line, {quoted(fixed.COMMENT_LINE)})) as c, count(*) filter (trim(line, ' ') <> '' and not regexp_matches(line, {quoted(fixed.COMMENT_LINE)})) as k from all_lines group by all),
tl as (select repo_id, sum(c)::bigint as comment_lines, sum(k)::bigint as code_lines, count(*) filter (n > 600) as large_files, count(*) as n_files from pl group by repo_id),
nq as (select repo_id, avg((not {SQL_POOR})::int) as naming from found group by repo_id),
pr as (select repo_id, avg(coalesce(language in ({listed(fixed.PARSED)}), false)::int) as parsed_share, sum(len(regexp_extract_all(text, '\\b(try|catch|except|rescue|recover|finally)\\b')))::bigint as handlers, sum(len(regexp_extract_all(text, {quoted(fixed.STRUCTURED_DOC)})))::bigint as structured_docs from fl group by repo_id),
cm as (select tl.*, functions, classes, avg_complexity, max_complexity, high_complexity, avg_lines, long_functions, max_nesting, documented, trivial, trivial_documented, coalesce(duplication, 0) as duplication, naming, parsed_share, structured_docs, high_complexity / greatest(1, functions) as high_ratio, long_functions / greatest(1, functions) as long_ratio,
  documented / greatest(1, functions) as documented_ratio, comment_lines / greatest(1, code_lines + comment_lines) as comment_ratio, case when functions > 0 then handlers / functions else 0 end as handling, large_files / greatest(1, n_files) as large_ratio
  from tl left join ag using (repo_id) left join dup using (repo_id) left join nq using (repo_id) left join pr using (repo_id))"""
register_code("g12_code_metrics", lambda t: rounded(project.code_metrics(t).select("repo_id", "functions", "classes", "avg_complexity", "max_complexity", "high_complexity", "avg_lines", "max_nesting", "documented_ratio", "comment_ratio", "handling", "duplication", "naming", "parsed_share", "trivial", "structured_docs"), "avg_complexity", "avg_lines", "documented_ratio", "comment_ratio", "handling", "duplication", "naming", "parsed_share"),
    f"{SQL_METRICS} select repo_id, functions, classes, round(avg_complexity, 6) as avg_complexity, max_complexity, high_complexity, round(avg_lines, 6) as avg_lines, max_nesting, round(documented_ratio, 6) as documented_ratio, round(comment_ratio, 6) as comment_ratio, round(handling, 6) as handling, round(duplication, 6) as duplication, round(naming, 6) as naming, round(parsed_share, 6) as parsed_share, trivial, structured_docs from cm")
register_code("g12_code_quality", lambda t: rounded(measures.code_quality(project.code_metrics(t)), "score", "confidence"),
    f"""{SQL_METRICS} select repo_id, round(greatest(0, least(100, 0.24e0 * (0.6e0 * {sql_scale('avg_complexity', 12, 3)} + 0.4e0 * {sql_scale('high_ratio', 0.25, 0)}) + 0.16e0 * (0.6e0 * {sql_scale('avg_lines', 90, 20)} + 0.4e0 * {sql_scale('long_ratio', 0.3, 0)}) + 0.12e0 * {sql_scale('max_nesting', 8, 3)}
  + 0.16e0 * {sql_scale('duplication', 0.25, 0.02)} + 0.10e0 * {sql_scale('naming', 0.5, 0.9)} + 0.08e0 * case when comment_ratio < 0.02e0 then 35 when comment_ratio < 0.06e0 then 35 + 65 * (comment_ratio - 0.02e0) / 0.04e0 when comment_ratio <= 0.35e0 then 100 when comment_ratio <= 0.6e0 then 100 - 30 * (comment_ratio - 0.35e0) / 0.25e0 else 60 end
  + 0.08e0 * {sql_scale('least(handling, 0.12e0)', 0, 0.12)} + 0.06e0 * greatest(0, least(100, 100 - 180 * large_ratio)))), 6) as score, round(0.5e0 + 0.5e0 * parsed_share, 6) as confidence from cm""")
register_code("e6_function_ratios", lambda t: rounded(project.code_metrics(t).select("repo_id", "documented_ratio", "long_ratio", "high_complexity_ratio"), "documented_ratio", "long_ratio", "high_complexity_ratio"), f"{SQL_METRICS} select repo_id, round(documented_ratio, 6) as documented_ratio, round(long_ratio, 6) as long_ratio, round(high_ratio, 6) as high_complexity_ratio from cm")
register_code("e5_variation", lambda t: rounded(ownership.complexity_variation(_profiled(t)), "variation"), f"{SQL_ENTITIES}, {SQL_COMPLEXITY}, p as (select repo_id, path, avg(complexity) as m, count(*) as n from cx where kind <> 'class' group by all having count(*) >= 2) select repo_id, round(case when count(*) >= 4 and avg(m) > 0 then stddev_pop(m) / avg(m) end, 6) as variation from p group by repo_id")

# -- style

register_code("g43_style_profile", lambda t: rounded(lines.style_profile(project.rows(t), project.found(t)), "avg_length", "comment_ratio", "trailing_comma_ratio", "snake_ratio", "camel_ratio", "avg_function_length", "doc_ratio", "annotation_ratio"))
register_code("g44_style_discontinuity", lambda t: rounded(lines.style_discontinuity(lines.style_profile(project.rows(t), project.found(t)), lines.STYLE_KEYS), "discontinuity"))

# -- files, tests, documentation, architecture

SQL_FOLDERS = "fo as (select repo_id, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) as d from code)"
register_code("g30_layers", lambda t: structure.layers(project.code(t)), f"{SQL_FOLDERS} " + " union all ".join(f"select repo_id, '{n}' as layer, count(*) as n_files from fo where list_has_any(d, [{listed(m.split())}]) group by repo_id" for n, m in fixed.LAYERS.items()))
register_code("g20_frameworks", lambda t: structure.frameworks(project.code(t)), "x as (select repo_id, " + ", ".join("coalesce(bool_or(" + " or ".join(f"contains(text, {quoted(m)})" for m in ms) + f"), false) as {n}" for n, ms in fixed.FRAMEWORKS.items()) + " from code group by repo_id) select repo_id, array_to_string(list_sort(list_filter([" + ", ".join(f"case when {n} then '{n}' end" for n in fixed.FRAMEWORKS) + "], lambda x: x is not null)), ',') as frameworks from x")
register_code("g19_test_frameworks", lambda t: measures.test_frameworks(project.files(t)), f"{SQL_FILES}, c as (" + " union all ".join(f"select repo_id, '{n}' as framework, sum({' + '.join(f'(len(string_split(text, {quoted(m)})) - 1)' for m in ms)})::bigint as n from fl where category = 'test_code' group by repo_id" for n, ms in fixed.TEST_FRAMEWORKS.items()) + ") select * from c where n > 0")
SQL_README = f"rd as (select repo_id, path, text from code where lower(regexp_extract(path, '[^/]*$')) in ({listed(fixed.README_NAMES)}) qualify row_number() over (partition by repo_id order by len(string_split(path, '/')) > 1, list_position([{listed(fixed.README_NAMES)}], lower(regexp_extract(path, '[^/]*$'))), len(string_split(path, '/')), path) = 1)"
register_code("g22_readme", lambda t: structure.readmes(project.code(t)).select("repo_id", "path"), f"{SQL_README} select repo_id, path from rd")
SQL_DOCUMENTED = f"{SQL_METRICS}, {SQL_README}, ex as (select repo_id, count(*) as n from code where starts_with(path, 'docs/') group by repo_id), rs as (select repo_id, text, " + " + ".join(f"case when regexp_matches(text, {quoted(p)}) then {w}e0 else 0 end" for _, w, p in fixed.DOC_FEATURES) + f" as f, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n, regexp_matches(text, {quoted(fixed.PLACEHOLDER_README)}) as ph from rd)"
SQL_DOCUMENTATION = "case when rs.text is null then 0 else greatest(0, least(100, 100 * f * case when rs.n < 60 then 0.35e0 when rs.n < 150 then 0.6e0 when rs.n < 400 then 0.85e0 else 1.0e0 end * case when ph then 0.55e0 else 1.0e0 end + least(8, 2 * coalesce(ex.n, 0)) + least(10, 20 * coalesce(documented_ratio, 0)))) end"
register_code("g23_documentation", lambda t: rounded(project.documentation(t), "score"), f"{SQL_DOCUMENTED} select r.repo_id, round({SQL_DOCUMENTATION}, 6) as score from (select distinct repo_id from code) r left join rs using (repo_id) left join ex using (repo_id) left join cm using (repo_id)")


def _has(markers: list[str]) -> str:
    return "(" + " or ".join(f"contains(text, {quoted(m)})" for m in markers) + ")"


SQL_CI = f"(starts_with(path, '.github/workflows/') or path in ({listed(fixed.CI_FILES)}))"
SQL_TESTING = f"""{SQL_FILES}, tm as (select repo_id, count(*) filter (category = 'test_code') as test_files, count(*) filter (category = 'candidate_code') as source_files,
  coalesce(sum({' + '.join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in fixed.TEST_CASES)}) filter (category = 'test_code'), 0)::bigint as test_cases, coalesce(sum(length(text) - length(replace(text, chr(10), ''))) filter (category = 'test_code'), 0)::bigint as test_lines,
  coalesce(sum(length(text) - length(replace(text, chr(10), ''))) filter (category = 'candidate_code'), 0)::bigint as source_lines, bool_or(category = 'test_code' and regexp_matches(lower(path), '{fixed.INTEGRATION_HINTS}')) as has_integration,
  bool_or(category = 'test_code' and (regexp_matches(lower(path), '{fixed.E2E_HINTS}') or {_has(fixed.TEST_FRAMEWORKS['playwright'] + fixed.TEST_FRAMEWORKS['cypress'])})) as has_e2e, bool_or{SQL_CI} as has_ci, bool_or({SQL_CI} and {_has(fixed.CI_TEST_MARKERS)}) as ci_runs_tests,
  bool_or({' or '.join(f"contains(path, '{x}')" for x in fixed.COVERAGE_FILES)} or (({SQL_CI} or regexp_matches(path, '(toml|cfg|ini|json)$')) and {_has(fixed.COVERAGE_MARKERS)})) as coverage_tracked from fl group by repo_id),
ts as (select *, case when source_lines > 0 then test_lines / source_lines else 0 end as ratio from tm)"""
register_code("g18_testing_metrics", lambda t: measures.testing_metrics(project.files(t)).select("repo_id", "test_files", "test_cases", "test_lines", "has_integration", "has_e2e", "has_ci", "ci_runs_tests", "coverage_tracked"), f"{SQL_TESTING} select repo_id, test_files, test_cases, test_lines, has_integration, has_e2e, has_ci, ci_runs_tests, coverage_tracked from ts")
register_code("g18_testing", lambda t: rounded(measures.testing_score(measures.testing_metrics(project.files(t))), "score"), f"{SQL_TESTING} select repo_id, round(0.30e0 * case when test_cases > 0 then 100 when test_files > 0 then 40 else 0 end + 0.25e0 * {sql_scale('least(0.6e0, ratio)', 0, 0.35)} + 20e0 * (case when test_cases > 0 then 0.45e0 else 0 end + case when has_integration then 0.35e0 else 0 end + case when has_e2e then 0.2e0 else 0 end) + 0.15e0 * case when ci_runs_tests then 100 when has_ci then 45 else 0 end + 0.10e0 * case when coverage_tracked then 100 else 0 end, 6) as score, case when source_files > 0 then 0.9e0 else 0.5e0 end as confidence from ts")
register_code("c22_test_cases", lambda t: measures.testing_metrics(project.files(t)).select("repo_id", "test_cases"), f"{SQL_TESTING} select repo_id, test_cases from ts")
register_code("g21_untested", lambda t: structure.untested_modules(project.files(t)), f"{SQL_FILES}, cl as (select *, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')) as stem from fl) select repo_id, path from cl a where category = 'candidate_code' and stem not in ({listed(structure.WELL_KNOWN)}) and not exists (select 1 from cl b where b.repo_id = a.repo_id and b.category = 'test_code' and contains(lower(b.path), a.stem))")
register_code("d14_own_references", lambda t: structure.own_references(project.files(t)), f"{SQL_FILES}, sm as (select distinct repo_id, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')) as stem from fl where category = 'candidate_code') select repo_id, repo_id in (select t.repo_id from fl t join sm on t.repo_id = sm.repo_id where t.category = 'test_code' and length(stem) > 3 and contains(lower(t.text), stem)) as references_own from (select distinct repo_id from fl)")
SQL_IMPORTS = """il as (select repo_id, path, language, unnest(string_split(text, chr(10))) as line from fl where language in ('python', 'javascript', 'typescript', 'tsx')),
it as (select repo_id, path, replace(regexp_extract(line, '^\\s*(?:from\\s+([\\w.]+)|import\\s+([\\w.]+))', 1) || regexp_extract(line, '^\\s*(?:from\\s+([\\w.]+)|import\\s+([\\w.]+))', 2), '.', '/') as target from il where language = 'python' and regexp_matches(line, '^\\s*(?:from\\s+([\\w.]+)|import\\s+([\\w.]+))')
  union select repo_id, path, case when starts_with(t, './') then regexp_replace(path, '[^/]*$', '') || substr(t, 3) else t end from (select repo_id, path, unnest(regexp_extract_all(line, 'from\\s+[''"]([^''"]+)[''"]', 1) || regexp_extract_all(line, 'require\\(\\s*[''"]([^''"]+)[''"]', 1)) as t from il where language <> 'python'))"""
register_code("c21_import_targets", lambda t: graph.import_targets(project.files(t)), f"{SQL_FILES}, {SQL_IMPORTS} select distinct repo_id, path, regexp_replace(target, '^/+|/+$', '', 'g') as target from it where target <> ''")
register_code("g27_import_edges", project.edges)
SQL_ARCHITECTURE = f"""{SQL_FILES}, so as (select *, length(path) - length(replace(path, '/', '')) as depth from fl where category in ('candidate_code', 'test_code')),
fo as (select repo_id, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) as d from so),
am as (select repo_id, count(*) as n_files, avg(depth) as avg_depth, max(depth) as max_depth, avg((depth = 0)::int) as root_ratio from so group by repo_id),
co as (select repo_id, {' + '.join(f"bool_or(list_has_any(d, [{listed(m.split())}]))::int" for n, m in fixed.LAYERS.items() if n not in ('tests', 'shared'))} as core_layers from fo group by repo_id),
en as (select repo_id, bool_or(regexp_extract(path, '[^/]*$') in ({listed(fixed.ENTRY_NAMES)}) or path in ({listed(fixed.ENTRY_PATHS)})) as entry from fl group by repo_id)"""
register_code("g31_architecture_metrics", lambda t: rounded(project.architecture_metrics(t).select("repo_id", "n_files", "avg_depth", "max_depth", "root_ratio", "core_layers", "entry"), "avg_depth", "root_ratio"), f"{SQL_ARCHITECTURE} select repo_id, coalesce(n_files, 0) as n_files, round(coalesce(avg_depth, 0), 6) as avg_depth, coalesce(max_depth, 0) as max_depth, round(coalesce(root_ratio, 0), 6) as root_ratio, coalesce(core_layers, 0) as core_layers, entry from en left join am using (repo_id) left join co using (repo_id)")
register_code("g31_architecture_score", lambda t: rounded(measures.architecture_score(project.architecture_metrics(t)), "score"))

# -- security

SQL_PATTERNS = f"{SQL_FILES}, {SQL_LINES}, k as (select a.repo_id, a.path, line_no, line, language from all_lines a join fl c on a.repo_id = c.repo_id and a.path = c.path where category in ({listed(fixed.CODE_CATEGORIES)}) and length(line) <= 4000 and not regexp_matches(line, '^\\s*(#|//|\\*)')), pt as (" + " union all ".join(
    f"select repo_id, path, line_no, '{r}' as rule_id, '{c}' as category, '{s}' as severity, {conf}e0 * case when regexp_matches(path, {quoted(fixed.TEST_PATH)}) then 0.6e0 else 1.0e0 end as confidence from k where regexp_matches(line, {quoted(p)})" + (f" and language in ({listed(langs)})" if langs else "") for r, c, p, s, conf, langs in fixed.INSECURE) + ")"
register_code("g32_patterns", lambda t: rounded(project.patterns(t), "confidence"), f"{SQL_PATTERNS} select repo_id, path, line_no, rule_id, category, severity, round(confidence, 6) as confidence from pt")
register_code("g32_rule_counts", lambda t: project.patterns(t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), f"{SQL_PATTERNS} select rule_id, count(*) as n from pt group by rule_id")
register_code("g35_security_metrics", lambda t: rounded(project.security_metrics(t).select("repo_id", "env_files", "locked", "pattern_findings", "secret_findings", "penalty"), "penalty"))
register_code("g35_security_score", lambda t: rounded(measures.security_score(project.security_metrics(t)), "score"))
register_code("g45_artifacts", lambda t: rounded(structure.assistant_artifacts(project.files(t)), "strength"), f"{SQL_FILES}, h as (select repo_id, category, " + " + ".join(f"least(2, len(regexp_extract_all(text, {quoted(p)})))" for _, p in fixed.ARTIFACTS) + " as n from fl) select repo_id, coalesce(sum(n) filter (category in ('candidate_code', 'test_code')), 0)::bigint as n_hits, round(least(1.0, coalesce(sum(n) filter (category in ('candidate_code', 'test_code')), 0) / greatest(1, count(*) filter (category = 'candidate_code')) / 0.8), 6) as strength from h group by repo_id")
register_code("g26_dependency_score", lambda t: rounded(dependencies.dependency_score(t("packages"), t("files").where(classify.is_lock_file("path"))), "score"), f"b as (select repo_id, avg((version_spec <> '' and not regexp_matches(version_spec, '^[~^>*]|^latest$'))::int) as pinned, count(*) filter (not dev) as runtime, count(*) as n from packages group by repo_id), lk as (select distinct repo_id from files where lower(regexp_extract(path, '[^/]*$')) in ({listed(fixed.LOCK_FILES)})) select repo_id, n, round(40 * pinned + 0.35e0 * case when repo_id in (select repo_id from lk) then 100 else 35 end + 0.25e0 * case when runtime <= 40 then 100 else greatest(0, 100 - 0.8e0 * (runtime - 40)) end, 6) as score from b", ("packages", "files"))
register_code("g42_tutorial_signals", lambda t: rounded(structure.tutorial_signals(project.code(t)), "weight"), "s as (select repo_id, " + ", ".join("bool_or(" + " or ".join([f"coalesce(regexp_matches(text, {quoted(p)}), false)" for p in ps] + [f"path = '{x}'" for x in paths]) + f") as {n}" for n, _, ps, paths in fixed.TUTORIAL_SIGNALS) + " from code group by repo_id), w as (select *, " + " + ".join(f"case when {n} then {w}e0 else 0 end" for n, w, _, _ in fixed.TUTORIAL_SIGNALS) + " as weight from s) select repo_id, round(weight, 6) as weight, case when weight >= 0.45 then 'STRONG_TUTORIAL_SIMILARITY' when weight >= 0.2 then 'POSSIBLY_TUTORIAL_DERIVED' else 'ORIGINAL' end as verdict, array_to_string(list_filter([" + ", ".join(f"case when {n} then '{n}' end" for n, *_ in fixed.TUTORIAL_SIGNALS) + "], lambda x: x is not null), ',') as signals from w")
