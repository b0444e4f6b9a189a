"""Registered queries of jobs, skills, people, ownership, evidence and serving reads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import classify, evidence, graph, history, jobs, lines, measures, ownership, people, scoring, serving, similarity, skills, structure
from ..sources import reports
from . import project
from .code import SQL_CODE, SQL_ENTITIES, SQL_FILES, register_code
from .queries import ORACLES, SQL_CLOSURE, SQL_LATEST, listed, quoted, r6, register, rounded, sql_skills

# -- jobs

WHOLE = "coalesce(title, '') || chr(10) || coalesce(description, '')"
SQL_YEARS = f"list_min(list_transform(regexp_extract_all({WHOLE}, {quoted(fixed.YEARS)}, 1), lambda x: try_cast(x as int)))"
SQL_LEVEL = "case " + " ".join(f"when regexp_matches({WHOLE}, {quoted(p)}) then '{n}'" for n, p in fixed.LEVELS) + f" when {SQL_YEARS} >= 6 then 'senior' when {SQL_YEARS} >= 3 then 'mid' when {SQL_YEARS} is not null then 'entry' else 'unspecified' end"
SQL_DOMAIN = "case " + " ".join(f"when regexp_matches({WHOLE}, {quoted(p)}) then '{n}'" for n, p in fixed.DOMAINS) + " else 'general' end"
register("c27_level_domain", lambda t: jobs.parsed(t("jobs")).select("job_id", "level", "min_years", "domain"), f"select job_id, {SQL_LEVEL} as level, {SQL_YEARS} as min_years, {SQL_DOMAIN} as domain from jobs", ("jobs",))
register("c28_responsibilities", lambda t: jobs.parsed(t("jobs")).select("job_id", F.size("responsibilities").alias("n"), F.array_join("responsibilities", "|").alias("items")))
SQL_KIND = "case " + " ".join(f"when regexp_matches(line, {quoted(p)}) then '{k}'" for k, p in fixed.JOB_HEADINGS.items()) + " end"
SQL_SECTIONS = f"""jl as (select job_id, unnest(generate_series(1, len(string_split(description, chr(10))))) as spot, unnest(string_split(description, chr(10))) as line from jobs), jh as (select *, {SQL_KIND} as heading from jl),
js as (select *, count(heading) over w as section, coalesce(last_value(heading ignore nulls) over w, 'general') as kind from jh window w as (partition by job_id order by spot rows between unbounded preceding and current row)),
jb as (select job_id, section, kind, coalesce(string_agg(case when heading is null then line end, chr(10) order by spot), '') as body from js group by all)"""
register("f11_job_sections", lambda t: jobs.sections(t("jobs")), f", {SQL_SECTIONS} select * from jb", ("jobs",))
SQL_TEXTS = "tx as (select {'job_id': job_id, 'section': section} as id, body as text from jb union all select {'job_id': job_id, 'section': -1}, coalesce(title, '') from jobs)"
SQL_REQUIRED = f"""{SQL_SECTIONS}, {SQL_TEXTS}, {sql_skills('tx')}, {SQL_CLOSURE},
fd as (select s.id.job_id as job_id, s.id.section as section, skill, string_split(terms, ',') as terms from skills s),
ex as (select fd.job_id, skill, bool_or(case when kind = 'general' then regexp_matches(body, {quoted(fixed.REQUIRED_WORDS)}) and not regexp_matches(body, {quoted(fixed.PREFERRED_WORDS)}) else kind = 'required' end) as required, list_distinct(flatten(list(terms))) as terms from fd join jb on fd.job_id = jb.job_id and fd.section = jb.section group by all),
ti as (select job_id, skill, terms from fd where section = -1),
nd as (select coalesce(ex.job_id, ti.job_id) as job_id, coalesce(ex.skill, ti.skill) as skill, coalesce(required, false) or ti.skill is not null as required, coalesce(ex.terms, ti.terms) as terms, case when ex.skill is null then 'title' else 'explicit' end as source from ex full join ti on ex.job_id = ti.job_id and ex.skill = ti.skill),
im as (select distinct job_id, implied as skill from nd join cl using (skill) where implied not in (select skill from nd n2 where n2.job_id = nd.job_id)),
ev as (select * from nd union all select job_id, skill, false, [], 'implied' from im),
rw as (select ev.job_id, skill, required, len(terms)::int as n_terms, source, case when source = 'implied' then 0.2e0 when required then 1.0e0 else 0.45e0 end * (1 + 0.15e0 * ln(1 + greatest(0, len(terms) - 1))) * case when len(list_filter(terms, lambda t: contains(lower(coalesce(title, '')), t))) > 0 then 2 else 1 end as raw from ev join jobs using (job_id))"""
register("g52_requirements", lambda t: rounded(jobs.requirements(t("jobs")).select("job_id", "skill", "required", "importance", "n_terms", "source"), "importance"), f", {SQL_REQUIRED} select job_id, skill, required, round(raw / sum(raw) over (partition by job_id), 6) as importance, n_terms, source from rw", ("jobs",))


def _wanted(t) -> DataFrame:
    return t("part").select((F.col("p_partkey") % 25).alias("job_id"), F.concat(F.lit("skill"), (F.col("p_partkey") % 60).cast("string")).alias("skill"), F.col("p_size").alias("importance"), (F.col("p_partkey") % 3 == 0).alias("required")).groupBy("job_id", "skill").agg(F.sum("importance").cast("double").alias("importance"), F.bool_or("required").alias("required"))


register("g53_requirement_overrides", lambda t: rounded(jobs.overridden(_wanted(t), t("supplier").select((F.col("s_suppkey") % 25).alias("job_id"), F.concat(F.lit("skill"), (F.col("s_suppkey") % 70).cast("string")).alias("skill"), (F.col("s_suppkey") % 2 == 0).alias("required"), (F.col("s_suppkey") % 4).cast("double").alias("importance")).groupBy("job_id", "skill").agg(F.max("required").alias("required"), F.max("importance").alias("importance"))), "importance"),
    "with w as (select p_partkey % 25 as job_id, 'skill' || (p_partkey % 60) as skill, sum(p_size)::double as importance, bool_or(p_partkey % 3 = 0) as required from part group by all), e as (select s_suppkey % 25 as job_id, 'skill' || (s_suppkey % 70) as skill, max(s_suppkey % 2 = 0) as required, max(s_suppkey % 4)::double as importance from supplier group by all), j as (select coalesce(w.job_id, e.job_id) as job_id, coalesce(w.skill, e.skill) as skill, coalesce(e.required, w.required) as required, coalesce(e.importance, w.importance) as raw from w full join e on w.job_id = e.job_id and w.skill = e.skill) select job_id, skill, required, round(raw / sum(raw) over (partition by job_id), 6) as importance from j where raw > 0")
register("g54_repository_evidence", lambda t: rounded(project.evidence(t), "weight"))
register("g55_skill_strength", lambda t: rounded(skills.skill_strength(project.evidence(t)), "strength"))
register("g56_measured_match", lambda t: rounded(scoring.job_match(jobs.requirements(t("jobs")), skills.skill_strength(project.evidence(t))), "score", "required_coverage"))
register("e15_dimension_coverage", lambda t: rounded(jobs.dimension_coverage(_wanted(t).withColumn("dimension", F.concat(F.lit("d"), F.expr("cast(substring(skill, 6) as int) % 5"))), t("strengths").groupBy("repo_id", "skill").agg(F.least(F.lit(1.0), F.max("value")).alias("strength"))), "coverage"),
    ", st as (select repo_id, skill, least(1.0, max(value)) as strength from strengths group by all), w as (select distinct p_partkey % 25 as job_id, 'skill' || (p_partkey % 60) as skill, 'd' || (p_partkey % 60 % 5) as dimension from part), n as (select job_id, dimension, count(*) as n from w group by all) select w.job_id, st.repo_id, w.dimension, round(100 * sum(strength) / any_value(n), 6) as coverage from w join st using (skill) join n on n.job_id = w.job_id and n.dimension = w.dimension group by all", ("strengths",))
register("g57_engineering_dna", lambda t: rounded(scoring.engineering_dna(skills.skill_strength(project.evidence(t)), F.broadcast(skills.catalogue(project.code(t).sparkSession))), "value"))
register("j16_taxonomy", lambda t: serving.taxonomy_usage(t("notes").sparkSession, skills.extract(t("notes"))),
    f", {sql_skills('notes')}, lx as (select * from (values " + ", ".join(f"('{r[0]}', {quoted(r[1])}, '{r[2]}', '{','.join(n for i, n in [(4, 'dependencies'), (5, 'imports'), (6, 'languages'), (7, 'paths')] if r[i])}')" for r in fixed.SKILLS) + ") s(skill, label, dimension, sources)), us as (select skill, count(*) as n_texts, sum(n_mentions)::bigint as n_mentions from skills group by skill) select lx.*, coalesce(n_texts, 0) as n_texts, coalesce(n_mentions, 0) as n_mentions from lx left join us using (skill)", ("notes",))

# -- ownership, scores, evidence

register("g73_facts", lambda t: rounded(project.facts(t).select("repo_id", "commit_count", "functions", "test_cases", "references_own", "readme_words", "n_cycles", "artifacts", "rework", "architecture_score", "dependency_score"), "artifacts", "rework", "architecture_score", "dependency_score"))
register("g46_assistance_signals", lambda t: rounded(project.signals(t), "value"))
register("g47_likelihood", lambda t: rounded(ownership.assistance_likelihood(project.signals(t)).join(ownership.likelihood_confidence(project.signals(t), project.facts(t)), "repo_id"), "likelihood", "confidence"))
register("g48_ownership", lambda t: rounded(scoring.weighted_factors(ownership.ownership_factors(project.facts(t)).withColumnRenamed("repo_id", "id"), fixed.OWNERSHIP_WEIGHTS), "score", "confidence"))


def _utilization(t) -> DataFrame:
    facts = project.facts(t)
    scored = scoring.weighted_factors(ownership.utilization_factors(facts).withColumnRenamed("repo_id", "id"), fixed.UTILIZATION_WEIGHTS)
    owned = scoring.weighted_factors(ownership.ownership_factors(facts).withColumnRenamed("repo_id", "id"), fixed.OWNERSHIP_WEIGHTS).select("id", F.col("score").alias("ownership"))
    likely = ownership.assistance_likelihood(ownership.assistance_signals(facts)).select(F.col("repo_id").alias("id"), "likelihood")
    return rounded(scoring.utilization(scored, owned.join(likely, "id")), "score")


register("g49_utilization", _utilization)
register("g58_category_scores", lambda t: rounded(evidence.category_scores(project.analyzer_results(t), project.ANALYZERS), "score", "confidence"))
CATEGORIES = {"a0": "c0", "a1": "c0", "a2": "c1", "a3": "c2", "a4": "c2"}


def _results(t) -> DataFrame:
    s = t("category_scores")
    return s.groupBy(F.col("evaluation_id").alias("repo_id"), F.concat(F.lit("a"), (F.col("score_id") % 5).cast("string")).alias("analyzer")).agg(F.max("score").alias("score"), F.max("confidence").alias("confidence"))


SQL_RESULTS = "rs as (select evaluation_id as repo_id, 'a' || (score_id % 5) as analyzer, max(score) as score, max(confidence) as confidence from category_scores group by all)"
SQL_MERGED = f"""{SQL_RESULTS}, rc as (select *, case analyzer when 'a0' then 'c0' when 'a1' then 'c0' when 'a2' then 'c1' else 'c2' end as category from rs),
cs as (select repo_id, category, case when count(score) = 2 then 0.65e0 * arg_min(score, analyzer) + 0.35e0 * arg_max(score, analyzer) else max(score) end as score, case when count(score) = 2 then min(confidence) when count(score) = 1 then max(confidence) filter (score is not null) else arg_min(confidence, analyzer) end as confidence, count(score) > 0 as available from rc group by all)"""
register("g58_merged_categories", lambda t: rounded(evidence.category_scores(_results(t), CATEGORIES), "score", "confidence"), f", {SQL_MERGED} select repo_id, category, round(score, 6) as score, round(confidence, 6) as confidence, available from cs", ("category_scores",))


def _failures(t) -> DataFrame:
    return t("runs").where("status = 'FAILED'").select((F.col("run_id") % 1000).alias("repo_id"), F.concat(F.lit("a"), (F.col("run_id") % 5).cast("string")).alias("analyzer"), F.concat(F.lit("timed out after "), (F.col("run_id") % 3).cast("string")).alias("reason")).groupBy("repo_id", "analyzer").agg(F.min("reason").alias("reason"))


SQL_FAILED = "fa as (select run_id % 1000 as repo_id, 'a' || (run_id % 5) as analyzer, min('timed out after ' || (run_id % 3)) as reason from runs where status = 'FAILED' group by all)"
register("g70_limitations", lambda t: evidence.limitations(_results(t), _failures(t)), f", {SQL_RESULTS}, {SQL_FAILED}, em as (select repo_id, analyzer from rs where score is null) select distinct coalesce(em.repo_id, fa.repo_id) as repo_id, coalesce(em.analyzer, fa.analyzer) as analyzer, coalesce(reason, 'nothing to measure') as reason from em full join fa on em.repo_id = fa.repo_id and em.analyzer = fa.analyzer", ("category_scores", "runs"))
register("g70_failed_categories", lambda t: rounded(evidence.with_failures(evidence.category_scores(_results(t), CATEGORIES), _failures(t), CATEGORIES).select("repo_id", "category", "score", "available", "reason"), "score"), f", {SQL_MERGED}, {SQL_FAILED}, lost as (select repo_id, case analyzer when 'a0' then 'c0' when 'a1' then 'c0' when 'a2' then 'c1' else 'c2' end as category, min(reason) as reason from fa group by all) select repo_id, category, round(case when reason is null then score end, 6) as score, available and reason is null as available, reason from cs left join lost using (repo_id, category)", ("category_scores", "runs"))


@project.once
def _measures(t) -> DataFrame:
    owned = scoring.weighted_factors(ownership.ownership_factors(project.facts(t)).withColumnRenamed("repo_id", "id"), fixed.OWNERSHIP_WEIGHTS).select(F.col("id").alias("repo_id"), F.col("score").alias("ownership"))
    return project.facts(t).join(project.security_metrics(t).select("repo_id", "secret_findings", "pattern_findings", "env_files", "locked"), "repo_id", "left").join(owned, "repo_id", "left")


def _recommended(t) -> DataFrame:
    weights = scoring.policy_weights(t("policies").groupBy("policy_key", "category").agg(F.sum("weight").alias("weight"))).where("policy_key = 'Brand#1'")
    names = F.array(*[F.lit(x) for x in ["testing", "documentation", "technical_quality", "security", "architecture", "git_engineering", "ownership", "job_relevance", "ai_utilization"]])
    named = weights.select(F.element_at(names, F.expr("cast(substring(category, 4) as int) + 1")).alias("category"), "weight")
    missing = t("packages").where("name like 'left-pad%'").select("repo_id", F.col("name").alias("skill"))
    return evidence.recommendations(_measures(t), evidence.category_scores(project.analyzer_results(t), project.ANALYZERS), named, missing)


register("g65_recommendations", lambda t: rounded(_recommended(t), "gain"))
register("e21_distinct_recommendations", lambda t: rounded(evidence.distinct_recommendations(_recommended(t), t("owners"), 5).select("owner_id", "place", "repo_id", "title", "gain"), "gain"))
register("g69_evidence_rows", lambda t: evidence.evidence_rows(_measures(t)).select("evidence_id", "repo_id", "analyzer", "category", "tag", "severity", "supports", "claim"))
register("h5_top_evidence", lambda t: evidence.top_evidence(evidence.evidence_rows(_measures(t)), {"security": 2.0, "testing": 1.5}).select("repo_id", "place", "evidence_id", "category"))
register("j10_evidence", lambda t: serving.evidence_list(evidence.evidence_rows(_measures(t)), supports="weakness").select("repo_id", "place", "claim"))


def _narrative(t) -> DataFrame:
    scores = evidence.category_scores(project.analyzer_results(t), project.ANALYZERS)
    overall = scores.groupBy("repo_id").agg(F.avg("score").alias("score"), F.count("score").alias("n")).select("repo_id", "score", F.when(F.col("score") < 50, "REVIEW_RECOMMENDED").otherwise("CLEAR").alias("status"), F.lit("scores below half").alias("reasons"))
    return evidence.narrative(overall, scores, evidence.evidence_rows(_measures(t)))


register("g71_narrative", _narrative)
register("c34_evidence_id", lambda t: t("part").select("p_partkey", evidence.evidence_id("p_partkey", "p_name").alias("evidence_id")), "select p_partkey, 'ev_' || substr(sha256('{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\"}'), 1, 16) as evidence_id from part")

# -- similarity

register("c7_sparse_cosine", lambda t: t("part").select("p_partkey", F.create_map(F.lit("a"), F.col("p_size"), F.lit("b"), F.col("p_partkey") % 7).alias("x"), F.create_map(F.lit("b"), F.col("p_size"), F.lit("c"), F.col("p_partkey") % 5).alias("y")).select("p_partkey", r6(similarity.sparse_cosine("x", "y")).alias("cosine")),
    "select p_partkey, round(case when (p_size > 0 or p_partkey % 7 > 0) and (p_size > 0 or p_partkey % 5 > 0) then (p_partkey % 7) * p_size / (sqrt(p_size * p_size + (p_partkey % 7) * (p_partkey % 7)) * sqrt(p_size * p_size + (p_partkey % 5) * (p_partkey % 5))) else 0 end, 6) as cosine from part")
register("i1_jaccard_containment", lambda t: t("documents").alias("a").join(t("documents").alias("b"), F.expr("a.doc_id + 1 = b.doc_id")).select(F.col("a.doc_id").alias("doc_id"), F.array_distinct(scalars.words("a.text")).alias("x"), F.array_distinct(scalars.words("b.text")).alias("y")).select("doc_id", r6(similarity.jaccard("x", "y")).alias("jaccard"), r6(similarity.containment("x", "y")).alias("containment"), F.size(F.array_intersect("x", "y")).alias("shared")),
    "with w as (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'), lambda x: lower(x))) as w from documents), p as (select a.doc_id, a.w as x, b.w as y from w a join w b on a.doc_id + 1 = b.doc_id) select doc_id, round(case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / len(list_distinct(x || y)) else 0 end, 6) as jaccard, round(case when len(x) > 0 then len(list_intersect(x, y)) / len(x) else 0 end, 6) as containment, len(list_intersect(x, y))::int as shared from p")


@project.once
def _chunks(t) -> DataFrame:
    return similarity.build_chunks(project.found(t), project.rows(t), project.files(t))


register_code("g37_chunks", lambda t: _chunks(t).select("repo_id", "id", "signature", F.size("fingerprints").alias("n_fingerprints")))
register_code("b11_eligible_entities", lambda t: _chunks(t).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")))
register_code("a18_corpus", lambda t: similarity.corpus_of(_chunks(t), t("owners").select("repo_id", F.concat(F.lit("org/"), "repo_id").alias("full_name"))).select("repo_id", "full_name", "id"))


@project.once
def _embedded(t) -> DataFrame:
    """The chunks with their embeddings."""
    own = _chunks(t).withColumn("name", F.concat_ws("\n", "repo_id", "id"))
    vectors = similarity.dense_embedding(own.select(F.col("name").alias("id"), F.col("source").alias("text"))).withColumnRenamed("id", "name")
    return own.join(vectors, "name").drop("name")


register_code("g40_corpus_matches", lambda t: rounded(similarity.corpus_matches(_embedded(t), _embedded(t)), "similarity"))


def _summary(t) -> DataFrame:
    from ..tables import saved

    own = saved(_embedded(t))
    named = own.select("repo_id", F.col("id").alias("path"), "fingerprints").where(F.size("fingerprints") > 0)
    pairs, members = similarity.near_duplicates(named)
    return rounded(similarity.similarity_summary(own, pairs, members, similarity.corpus_matches(own, own), 1), "internal_ratio", "external_ratio", "max_external")


register_code("g41_similarity_summary", _summary)

# -- graphs

register("g29_strong_components", lambda t: graph.strong_components(t("edges").distinct()))

SQL_SHORT = """, e as (select distinct repo_id, src, dst from edges), p2 as (select repo_id, src as a, dst as b from e where dst > src),
cy as (select repo_id, 1 as n, src || ' -> ' || dst as cycle from e where src = dst union all select p2.repo_id, 2, a || ' -> ' || b || ' -> ' || a from p2 join e on e.repo_id = p2.repo_id and e.src = b and e.dst = a
  union all select p2.repo_id, 3, a || ' -> ' || b || ' -> ' || m.dst || ' -> ' || a from p2 join e m on m.repo_id = p2.repo_id and m.src = b and m.dst > a and m.dst <> b join e z on z.repo_id = p2.repo_id and z.src = m.dst and z.dst = a)
select repo_id, row_number() over (partition by repo_id order by n, cycle) as place, cycle from cy qualify place <= 10"""
register("g29_short_cycles", lambda t: graph.short_cycles(t("edges"), longest=3), SQL_SHORT, ("edges",))

# -- people

register("g63_resume_entries", lambda t: people.resume_entries(t("resumes")).select("candidate_id", "kind", "entry"))
register("g63_resume_skills", lambda t: rounded(people.resume_skills(t("resumes")), "expected"))
register("f11_resume_sections", lambda t: people.resume_sections(t("resumes")), f", rl as (select candidate_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::int as line_no, unnest(string_split(text, chr(10))) as line from resumes), rh as (select *, case when regexp_matches(line, {quoted(fixed.RESUME_HEADINGS)}) then lower(regexp_extract(line, {quoted(fixed.RESUME_HEADINGS)}, 1)) end as heading from rl), rp as (select *, coalesce(last_value(heading ignore nulls) over (partition by candidate_id order by line_no rows between unbounded preceding and current row), 'header') as section from rh) select candidate_id, section, line_no, line from rp where heading is null and trim(line) <> ''", ("resumes",))


def _questions(t) -> DataFrame:
    found, rows = project.found(t), project.rows(t)
    deepest = structure.entity_complexity(found.where("kind <> 'class'"), rows).groupBy("repo_id").agg(F.max("complexity").alias("max_complexity"), F.max_by(F.struct("symbol", "path"), F.struct("complexity", "path", "start_line")).alias("c")).select("repo_id", "max_complexity", F.col("c.symbol").alias("complex_symbol"), F.col("c.path").alias("complex_path"))
    hub = graph.hubs(project.edges(t), 1).select("repo_id", F.col("node").alias("hub"), F.col("fan_in").alias("hub_fan_in"))
    return people.interview_questions(_measures(t).join(deepest, "repo_id", "left").join(hub, "repo_id", "left"))


register("g66_interview_questions", lambda t: _questions(t).select("repo_id", "place", "category", "question", "difficulty"))
register("g74_answer_facts", lambda t: people.answer_facts(project.files(t), project.found(t), measures.testing_metrics(project.files(t))).select("repo_id", "test_cases", "ci_runs_tests", F.size("files").alias("n_files"), F.size("symbols").alias("n_symbols"), F.array_join("languages", ",").alias("languages")))


def _assessed(t) -> DataFrame:
    facts = people.answer_facts(project.files(t), project.found(t), measures.testing_metrics(project.files(t)))
    given = t("spoken").where("role <> 'system'").withColumn("repo_id", F.concat(F.lit("src"), (F.col("session_id") % 20).cast("string"))).join(facts, "repo_id", "left")
    asked = given.withColumns({"expected_points": F.array(F.lit("names the cache and memory"), F.lit("compares measured alternatives")), "anchors": F.array(F.lit("mod2.py"), F.lit("load_rows"))})
    return people.assess_answers(asked)


register("g67_assessed_answers", lambda t: rounded(_assessed(t), "score", *fixed.ANSWER_WEIGHTS))
register("g68_session_scores", lambda t: rounded(people.session_scores(_assessed(t).join(t("spoken").select("answer_id", "session_id", "reviewer_score"), "answer_id")), "score", *fixed.ANSWER_WEIGHTS))
register("e22_reviewer_wins", lambda t: rounded(people.session_scores(t("category_scores").select(F.col("evaluation_id").alias("session_id"), "score", F.when(F.col("score_id") % 4 == 0, F.col("confidence") * 100).alias("reviewer_score"), *[F.lit(1.0).alias(k) for k in fixed.ANSWER_WEIGHTS])).select("session_id", "score", "n", "reviewed"), "score"), "select evaluation_id as session_id, round(avg(coalesce(case when score_id % 4 = 0 then confidence * 100 end, score, 0)), 6) as score, count(*) as n, count(*) filter (score_id % 4 = 0) as reviewed from category_scores group by 1", ("category_scores",))

# -- serving

register("b17_filters", lambda t: serving.filtered(t("evaluations"), {"job_id": 3, "repo_id": None}, {"overall": 50.0}).select("evaluation_id", "overall"), "select evaluation_id, overall from evaluations where job_id = 3 and overall >= 50", ("evaluations",))
register("b18_importable", lambda t: serving.importable(t("repositories"), t("customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("full_name"))).select("id", "already_imported"), "select id, full_name in (select c_name from customer where c_custkey % 3 = 0) as already_imported from repositories where not is_fork and not is_archived", ("repositories",))
register("b21_visible_notes", lambda t: serving.visible_notes(t("notes_on"), False).select("evaluation_id", "note_id", "place"), "select evaluation_id, note_id, row_number() over (partition by evaluation_id order by created_at desc, note_id) as place from notes_on where visible_to_candidate", ("notes_on",))
SQL_SEEN = "seen as (select * from repositories where owner_id = 7 or organization_id in (select organization_id from members where user_id = 7))"
register("j1_repositories", lambda t: serving.repository_page(t("repositories"), t("members"), 7, 20, 1).select("id", "full_name", "total"), f", {SQL_SEEN} select id, full_name, (select count(*) from seen) as total from seen order by last_analyzed_at desc nulls last, id limit 20 offset 1", ("repositories", "members"))
register("j2_analyses", lambda t: serving.analyses(t("analyses"), 3).select("repo_id", "place", "analysis_id", "score"), "select repo_id, row_number() over (partition by repo_id order by created_at desc, analysis_id desc) as place, analysis_id, score from analyses qualify place <= 3", ("analyses",))
SQL_NEWEST = "newest as (select repo_id, analysis_id from analyses qualify row_number() over (partition by repo_id order by created_at desc, analysis_id desc) = 1)"
register("j3_findings", lambda t: serving.findings_by_severity(t("findings"), t("analyses"), 3).select("repo_id", "place", "finding_id", "severity"), f", {SQL_NEWEST} select repo_id, row_number() over (partition by repo_id order by list_position(['critical', 'high', 'medium', 'low', 'info'], severity), confidence desc, finding_id) as place, finding_id, severity from findings join newest using (analysis_id) qualify place <= 3", ("findings", "analyses"))
register("j4_similarity", lambda t: serving.similarity_rows(t("similar_rows"), t("analyses"), 5, "external").select("repo_id", "place", "row_id"), f", {SQL_NEWEST} select repo_id, row_number() over (partition by repo_id order by similarity desc, row_id) as place, row_id from similar_rows join newest using (analysis_id) where scope = 'external' qualify place <= 5", ("similar_rows", "analyses"))
register("j5_commits", lambda t: serving.newest_commits(t("commits"), 10).select("repo_id", "place", "sha"), "select repo_id, row_number() over (partition by repo_id order by committed_at desc, sha) as place, sha from commits qualify place <= 10", ("commits",))
register("j6_files", lambda t: serving.file_inventory(classify.classified(t("files")), 20, "candidate_code").select("repo_id", "place", "path", "size_bytes"))
register("j7_runs", lambda t: serving.repository_jobs(t("runs")), "select repo_id, arg_max(status, {'a': created_at, 'b': run_id}) as status, arg_max(run_id, {'a': created_at, 'b': run_id}) as run_id, count(*) as n, bool_or(status in ('QUEUED', 'RUNNING')) as active from runs group by repo_id", ("runs",))
register("j8_evaluation_page", lambda t: serving.evaluation_page(t("evaluations"), 30, 5, 20.0, job_id=4).select("evaluation_id", "overall", "total"), "select evaluation_id, overall, (select count(*) from evaluations where job_id = 4 and overall >= 20) as total from evaluations where job_id = 4 and overall >= 20 order by overall desc nulls last, created_at desc, evaluation_id limit 30 offset 5", ("evaluations",))
register("j9_evaluation_detail", lambda t: serving.evaluation_details(t("evaluations"), t("repositories").groupBy("repo_id").agg(F.min("full_name").alias("full_name")), t("roles").groupBy("job_id").agg(F.min("title").alias("title")), t("candidates"), t("category_scores").groupBy("evaluation_id", "category").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("weight"))).select("evaluation_id", "full_name", "title", "display_name", "scores"),
    ", r as (select repo_id, min(full_name) as full_name from repositories group by all), o as (select job_id, min(title) as title from roles group by all), s as (select evaluation_id, category, max(score) as score, count(*) as weight from category_scores group by all), l as (select evaluation_id, string_agg(category || '=' || coalesce(printf('%.1f', score), '-'), ',' order by weight desc, category) as scores from s group by all) select evaluation_id, full_name, title, display_name, scores from evaluations left join r using (repo_id) left join o using (job_id) left join candidates using (candidate_id) left join l using (evaluation_id)", ("evaluations", "repositories", "roles", "candidates", "category_scores"))
register("j12_overrides", lambda t: serving.override_list(t("overrides")).select("evaluation_id", "override_id", "category", "place").where("place <= 2"), "select evaluation_id, override_id, category, row_number() over (partition by evaluation_id order by created_at desc, override_id desc) as place from overrides qualify place <= 2", ("overrides",))
register("j13_candidates", lambda t: serving.candidate_page(t("candidates"), t("evaluations"), 25, 5, "build").select("candidate_id", "best_evaluation", "best_score", "total"), ", s as (select * from candidates where contains(lower(display_name), 'build') or contains(email, 'build') or contains(lower(headline), 'build')), b as (select candidate_id, arg_max(evaluation_id, {'a': overall, 'b': evaluation_id}) as best_evaluation, max(overall) as best_score from evaluations where overall is not null group by all) select candidate_id, best_evaluation, best_score, (select count(*) from s) as total from s left join b using (candidate_id) order by display_name, candidate_id limit 25 offset 5", ("candidates", "evaluations"))
register("j15_jobs", lambda t: serving.visible_jobs(t("repositories").select(F.col("id").alias("job_id"), "owner_id", "organization_id", (F.col("id") % 4 == 0).alias("is_public")), t("members"), 7).select("job_id"), "select id as job_id from repositories where id % 4 = 0 or owner_id = 7 or organization_id in (select organization_id from members where user_id = 7)", ("repositories", "members"))


def _versions(t) -> DataFrame:
    rows = t("overrides").select(F.when(F.col("category") == "cat0", "default").otherwise(F.col("category")).alias("policy_key"), F.when(F.col("evaluation_id") % 5 > 0, F.col("evaluation_id") % 50).alias("organization_id"), "created_at", F.concat_ws("-", "evaluation_id", "override_id").alias("event_id"))
    return scoring.policy_versions(rows.distinct())


SQL_VERSIONS = "ve as (select distinct case when category = 'cat0' then 'default' else category end as policy_key, case when evaluation_id % 5 > 0 then evaluation_id % 50 end as organization_id, created_at, evaluation_id || '-' || override_id as event_id from overrides), vs as (select *, row_number() over w as version, lead(event_id) over w is null as is_current from ve window w as (partition by organization_id, policy_key order by created_at, event_id))"
register("j17_policies", lambda t: serving.policy_listing(_versions(t), 3, True).select("policy_key", "organization_id", "version", "place"), f", {SQL_VERSIONS} select policy_key, organization_id, version, row_number() over (partition by policy_key, organization_id order by version desc) as place from vs where organization_id is null or organization_id = 3", ("overrides",))
register("g62_resolved_policy", lambda t: serving.resolved_policy(_versions(t), t("evaluations").select(F.col("evaluation_id").alias("request_id"), F.when(F.col("evaluation_id") % 3 == 0, F.lit("none-such")).alias("event_id"), F.when(F.col("evaluation_id") % 2 == 0, F.col("evaluation_id") % 60).alias("organization_id"))), f", {SQL_VERSIONS}, o as (select organization_id, arg_max(event_id, {{'a': created_at, 'b': event_id}}) as e from vs where is_current and organization_id is not null group by all) select evaluation_id as request_id, coalesce(e, (select arg_max(event_id, {{'a': created_at, 'b': event_id}}) from vs where is_current and policy_key = 'default')) as event_id from evaluations left join o on organization_id = case when evaluation_id % 2 = 0 then evaluation_id % 60 end", ("overrides", "evaluations"))
register("j18_best_categories", lambda t: rounded(serving.best_categories(t("category_scores").groupBy((F.col("evaluation_id") % 30).alias("owner_id"), "category").agg(F.max("score").alias("score"))).select("owner_id", "category", "score", "side", "place"), "score"), ", s as (select evaluation_id % 30 as owner_id, category, max(score) as score from category_scores group by all), k as (select *, case when score >= 75 then 'strength' when score < 55 then 'gap' end as side from s) select owner_id, category, round(score, 6) as score, side, row_number() over (partition by owner_id, side order by case when side = 'strength' then -score else score end, category) as place from k where side is not null", ("category_scores",))
register("e12_portfolio_dna", lambda t: rounded(serving.portfolio_dna(scoring.engineering_dna(skills.skill_strength(project.evidence(t)), F.broadcast(skills.catalogue(project.code(t).sparkSession))), t("owners")), "value"))


def _strengths(t) -> DataFrame:
    return t("strengths").groupBy("repo_id", "skill").agg(F.least(F.lit(1.0), F.max("value")).alias("strength"))


def _holders(t) -> DataFrame:
    return t("repositories").groupBy("repo_id").agg((F.min("id") % 6).alias("owner_id"))


SQL_PORTFOLIO = "st as (select repo_id, skill, least(1.0, max(value)) as strength from strengths group by all), ho as (select repo_id, min(id) % 6 as owner_id from repositories group by all), wa as (select p_partkey % 25 as job_id, 'skill' || (p_partkey % 60) as skill, sum(p_size)::double as importance, bool_or(p_partkey % 3 = 0) as required from part group by all), be as (select owner_id, skill, max(strength) as strength, count(*) as n_repositories from st join ho using (repo_id) group by all)"
register("e13_owner_strength", lambda t: rounded(serving.best_strengths(_strengths(t), _holders(t)), "strength"), f", {SQL_PORTFOLIO} select owner_id, skill, round(strength, 6) as strength, n_repositories from be", ("strengths", "repositories"))
register("j19_readiness", lambda t: rounded(serving.readiness(_wanted(t), _strengths(t), _holders(t)), "score"), f", {SQL_PORTFOLIO}, me as (select job_id, owner_id, sum(importance * strength) as s, list(distinct wa.skill) filter (strength >= 0.2) as have from wa join be using (skill) group by all), tt as (select job_id, sum(importance) as w, list_sort(list(distinct skill) filter (required)) as rq from wa group by all) select job_id, owner_id, round(100 * s / w, 6) as score, array_to_string(list_filter(rq, lambda x: not list_contains(coalesce(have, []), x)), ',') as missing from me join tt using (job_id)", ("strengths", "repositories"))
register("j19_best_repositories", lambda t: rounded(serving.best_repositories(scoring.job_match(_wanted(t), _strengths(t)), _holders(t)), "score"), f", {SQL_PORTFOLIO}, jt as (select job_id, sum(importance) as w from wa group by all), m as (select job_id, repo_id, 100 * sum(importance * strength) / any_value(w) as score from wa join st using (skill) join jt using (job_id) group by job_id, repo_id) select job_id, owner_id, row_number() over (partition by job_id, owner_id order by round(score, 6) desc, repo_id) as place, repo_id, round(score, 6) as score from m join ho using (repo_id) qualify place <= 5", ("strengths", "repositories"))
register("j20_recommendations", lambda t: rounded(evidence.distinct_recommendations(t("category_scores").select(F.col("evaluation_id").alias("repo_id"), "category", F.col("category").alias("title"), F.lit("high").alias("impact"), F.col("score").alias("gain")), t("category_scores").select(F.col("evaluation_id").alias("repo_id"), (F.col("evaluation_id") % 20).alias("owner_id")).distinct(), 4).select("owner_id", "place", "repo_id", "title", "gain"), "gain"), ", b as (select evaluation_id as repo_id, category as title, max(score) as gain, evaluation_id % 20 as owner_id from category_scores group by all) select owner_id, row_number() over (partition by owner_id order by gain desc nulls last, repo_id, title) as place, repo_id, title, round(gain, 6) as gain from b qualify place <= 4", ("category_scores",))
register("j21_interviews", lambda t: serving.interview_list(t("answers").select("session_id").distinct(), t("answers").where("role = 'assistant'").select("session_id", "question_id", F.substring("answer_text", 1, 40).alias("question")), t("answers").where("role = 'user'").select("session_id")), ", q as (select session_id, count(*) as n_questions, arg_max(substr(answer_text, 1, 40), question_id) as last_question from answers where role = 'assistant' group by all), u as (select session_id, count(*) as n_answers from answers where role = 'user' group by all) select session_id, coalesce(n_questions, 0) as n_questions, last_question, coalesce(n_answers, 0) as n_answers from (select distinct session_id from answers) left join q using (session_id) left join u using (session_id)", ("answers",))
register("e17_durations", lambda t: rounded(serving.job_durations(t("runs")), "mean_duration"), ", m as (select max(created_at) as m from runs) select status, count(*) as n, round(avg(duration), 6) as mean_duration, max(duration) as longest from runs, m where created_at > m - interval 24 hour group by status", ("runs",))
register("j22_operations", lambda t: serving.recent_counts(t("runs").where("status = 'FAILED'").withColumn("actor_id", F.col("repo_id")), "repo_id", 240), ", f as (select * from runs where status = 'FAILED'), m as (select max(created_at) as m from f) select repo_id, count(*) as n, count(distinct repo_id) as n_actors from f, m where created_at > m - interval 240 hour group by repo_id", ("runs",))
register("j24_job_monitor", lambda t: serving.job_monitor(t("runs"), t("repositories").groupBy("repo_id").agg(F.min("full_name").alias("full_name")), 50, 10, "FAILED").select("run_id", "full_name", "total"), ", r as (select repo_id, min(full_name) as full_name from repositories group by all) select run_id, full_name, (select count(*) from runs where status = 'FAILED') as total from runs left join r using (repo_id) where status = 'FAILED' order by created_at desc, run_id desc limit 50 offset 10", ("runs", "repositories"))
register("j25_failures", lambda t: serving.failure_list(t("runs").where("status = 'FAILED'").withColumn("failure_id", F.col("run_id")), 100).select("failure_id", "repo_id"), "select run_id as failure_id, repo_id from runs where status = 'FAILED' order by created_at desc, run_id desc limit 100", ("runs",))
register("e4_statistics", lambda t: rounded(t("audit").groupBy("action").agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.median("value").alias("median_value"), F.stddev_pop("value").alias("spread")), "mean_value", "median_value", "spread").join(serving.commonest(t("audit"), "action", "actor_id").withColumnRenamed("actor_id", "commonest"), "action"), ", n as (select action, actor_id, count(*) as n from audit group by all), c as (select action, actor_id as commonest from n qualify row_number() over (partition by action order by n desc, actor_id) = 1), s as (select action, round(avg(value), 6) as mean_value, max(value) as max_value, round(median(value), 6) as median_value, round(stddev_pop(value), 6) as spread from audit group by action) select s.*, commonest from s join c using (action)", ("audit",))


# -- the whole report


def _report(t) -> DataFrame:
    """Reports of all evaluations, an analysis standing for the repository; findings and similar rows by its id."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    tables = {
        "scores": t("category_scores").groupBy("evaluation_id", "category").agg(F.max("score").alias("score"), F.max("confidence").alias("weight"), F.min("confidence").alias("confidence")),
        "findings": t("findings").select(F.col("analysis_id").alias("repo_id"), name("f", "finding_id").alias("title"), "severity", F.lit("a.py").alias("path"), F.lit(1).alias("line_no"), F.round("confidence", 6).alias("confidence")),
        "similarity": t("similar_rows").select(F.col("analysis_id").alias("repo_id"), "scope", name("s", "row_id").alias("source"), F.lit("m").alias("matched"), F.round("similarity", 6).alias("similarity")),
        "notes": t("notes_on").select("evaluation_id", name("n", "note_id").alias("author"), F.lit("").alias("body"), "created_at", "visible_to_candidate"),
        "overrides": t("overrides").groupBy("evaluation_id", "category").agg(F.max("new_score").alias("new_score"), F.max("created_at").alias("created_at")),
        "candidates": t("candidates").select("candidate_id", "display_name"),
    }
    e = reports.full_report(t("evaluations").withColumn("repo_id", F.col("evaluation_id")), tables)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",").alias(c)
    return e.select("evaluation_id", F.col("candidate.display_name").alias("candidate"), joined("scores", "category"), joined("security", "title"), joined("external_matches", "source"), joined("notes", "author"), joined("overrides", "category"), F.size("questions").alias("n_questions"))


SQL_REPORT = """, sc as (select evaluation_id as k, category as x, row_number() over (partition by evaluation_id order by w desc, category) as p from (select evaluation_id, category, max(confidence) as w from category_scores group by all)),
fi as (select analysis_id as k, 'f' || finding_id as x, row_number() over (partition by analysis_id order by round(confidence, 6) desc, 'f' || finding_id) as p from findings),
si as (select analysis_id as k, 's' || row_id as x, row_number() over (partition by analysis_id order by round(similarity, 6) desc, 's' || row_id) as p from similar_rows where scope = 'external'),
no as (select evaluation_id as k, 'n' || note_id as x, row_number() over (partition by evaluation_id order by created_at desc, 'n' || note_id) as p from notes_on where visible_to_candidate),
ov as (select evaluation_id as k, category as x, row_number() over (partition by evaluation_id order by c desc, category) as p from (select evaluation_id, category, max(created_at) as c from overrides group by all))
select e.evaluation_id, c.display_name as candidate, """ + ", ".join(f"coalesce((select string_agg(x, ',' order by p) from {t} where k = e.evaluation_id and p <= {n}), '') as {name}" for t, name, n in [("sc", "scores", 20), ("fi", "security", 25), ("si", "external_matches", 10), ("no", "notes", 50), ("ov", "overrides", 50)]) + """, 0 as n_questions
from evaluations e left join candidates c using (candidate_id)"""
register("j26_full_report", _report, SQL_REPORT, ("evaluations", "category_scores", "findings", "similar_rows", "notes_on", "overrides", "candidates"))
