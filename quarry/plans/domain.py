"""Domain tables drawn from the given tables, as expressions that Spark SQL and other SQL engines read alike.

VIEWS: name -> (base table, {column: expression}). `view` gives the DataFrame, `with_views` a WITH clause of the same tables."""

from pyspark.sql import DataFrame, SparkSession

from ..tables import spread

# One of these lines stands in each file of the view code: what rules of security, artefacts, tutorials, tests and frameworks look for, and lines that only look alike.
SAMPLES = [
    "cursor.execute('select * from t where id = ' + x)", "db.execute(f'select * from {t}')", "subprocess.run(cmd, shell=True)", "os.system('rm ' + name)", "exec('ls ' + dir)", "eval(user_input)", "pickle.loads(data)", "eval(body.code)",
    "new ObjectInputStream(in)", "dangerouslySetInnerHTML={{ __html: body }}", "box.innerHTML = value;", "mark_safe(text)", "requests.get(url, verify=False)", "hashlib.md5(x)", "if user.password == given:", "jwt.decode(t, options={'verify_signature': False})",
    "DEBUG = True", "f(allow_origins=['*'], allow_credentials=True)", "app.run(host='0.0.0.0')", "open(os.path.join(root, request.args['f']))", "yaml.load(stream, Loader=Safe)", "# step 1: load the rows", "# here's how it works", "# your code here", "# example usage:",
    "```", "# as an AI I cannot", "# 🎉 setup", "This project was bootstrapped with [Create React App]", "Get started by editing app/page", "Django settings for shop project.", "your_api_key_here", "# following this tutorial", "import pytest", "import unittest",
    "jest.mock('x')", "from 'vitest'", "require('mocha')", "@testing-library/react", "@playwright/test", "cy.visit('/')", "@Test", "func TestAll(t *testing.T)", "it('works', f)", "TEST_F(A, b)", "from fastapi import FastAPI", "from flask import Flask", "from django.db import models",
    "express()", "@nestjs/common", "import Link from 'next/link'", "from 'react'", "from 'vue'", "org.springframework", "import torch", "import tensorflow", "from langchain import x", "pytest --cov", "run: npm test", "return x", "a = b + c",
]


def _sampled() -> str:
    return f"case (doc_id * 17) % {len(SAMPLES)} " + " ".join(f"when {i} then '        {x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(SAMPLES)) + " end"


def _braced() -> str:
    """A file of a brace language around a text and a sample line; braces in comments, strings and destructured names among the real ones."""
    name = "case doc_id % 5 when 0 then 'tmp' when 1 then 'x1' when 2 then 'load_rows' else 'run' || doc_id end"
    lines = [
        "'// Setup and usage of ' || doc_id", "case doc_id % 14 when 13 then 'import p from \"./c' || (doc_id - 140) || '\"' else 'const x = 1;' end", "case doc_id % 4 when 0 then '/** Args: { a, b }. */' else '' end", f"'export async function ' || {name} || '(a, b) {{'", "'  try {'", "'    if (a && b) {'",
        "'      ' || replace(text, chr(10), chr(10) || '      ')", _sampled(), "'    }'", "'  } catch (e) { return `}} ' || doc_id || '`; }'", "'}'", "'class Store' || (doc_id % 11) || ' extends Base {'", "'  // here is the step {'", "'  save({ item, deep }, more) {'", "'    const go = (x) => {'", "'      return x ? \"{\" : \"}\";'",
        "'    };'", "'    return go(item) || more;'", "'  }'", "'}'", "'const test_case_' || (doc_id % 3) || ' = function (rows, size) {'", "'  let total = 0;'", "'  for (let i = 0; i < rows.length; i++) { total += size * ' || (doc_id % 9) || '; }'", "'  if (total > 3) {'", "'    return total;'", "'  }'", "'  return null;'", "'};'",
    ]
    return " || chr(10) || ".join(lines)


VIEWS = {
    "files": (
        "documents",
        {
            "repo_id": "source",
            "path": """case doc_id % 10 when 0 then 'src/app/mod' || doc_id || '.py' when 1 then 'src/lib/util' || doc_id || '.ts' when 2 then 'tests/test_mod' || doc_id || '.py'
                when 3 then 'docs/page' || doc_id || '.md' when 4 then 'node_modules/pkg/index' || doc_id || '.js' when 5 then 'pkg' || doc_id || '/package-lock.json'
                when 6 then 'config/app' || doc_id || '.yaml' when 7 then 'src/core/Service' || doc_id || '.java' when 8 then 'assets/logo' || doc_id || '.png' else 'scripts/run' || doc_id end""",
            "text": "text",
            "size_bytes": "n_chars",
        },
    ),
    "code": (
        "documents",
        {
            "repo_id": "source",
            "path": """case doc_id % 14 when 0 then 'p' || doc_id || '/README.md' when 1 then 'docs/p' || doc_id || '/readme.md' when 2 then 'src/api/mod' || doc_id || '.py' when 3 then 'src/services/jobs/run' || doc_id || '.py'
                when 4 then 'tests/e2e/test_mod' || (doc_id + 40) || '.py' when 5 then 'tests/test_x' || doc_id || '.py' when 6 then 'web/pages/p' || doc_id || '.ts' when 7 then 'src/models/store' || doc_id || '.py'
                when 8 then '.github/workflows/ci' || doc_id || '.yml' when 9 then 'config/' || doc_id || '/pyproject.toml' when 10 then 'app' || doc_id || '.py' when 11 then 'notebooks/n' || doc_id || '.ipynb' when 12 then 'p' || doc_id || '/.env'
                else 'web/components/c' || doc_id || '.js' end""",
            "text": f"""case when doc_id % 14 in (6, 13) then {_braced()} else '# Setup and usage of ' || doc_id || chr(10) || case doc_id % 14 when 2 then 'from src.api.mod' || (doc_id + case when doc_id % 280 < 140 then 140 else -140 end) || ' import run' when 3 then 'import src.services.jobs.run' || (doc_id - 140) when 4 then 'import mod' || (doc_id + 40) when 7 then 'from src.models.store' || (doc_id + 140) || ' import x' when 13 then 'import p from "./c' || (doc_id - 140) || '"' else 'x = 1' end || chr(10)
                || 'def ' || case doc_id % 5 when 0 then 'tmp' when 1 then 'x1' when 2 then 'load_rows' else 'run' || doc_id end || '(a, b):' || chr(10) || case doc_id % 4 when 0 then '    \"\"\"Args: a, b.\"\"\"' || chr(10) else '' end || '    try:' || chr(10) || '        if a and b:' || chr(10)
                || '            ' || replace(text, chr(10), chr(10) || '            ') || chr(10) || {_sampled()} || chr(10) || 'class Store' || (doc_id % 11) || ':' || chr(10) || '    # here is the step' || chr(10) || '    def save(self):' || chr(10) || '        return self' || chr(10)
                || 'def test_case_' || (doc_id % 3) || '(rows, size):' || chr(10) || '    # checks' || chr(10) || '    total = 0' || chr(10) || '    for r in rows:' || chr(10) || '        total = total + size * ' || (doc_id % 9) || chr(10) || '    if total > 3:' || chr(10) || '        return total' || chr(10) || '    return None' end""",
        },
    ),
    "packages": ("documents", {"repo_id": "source", "name": "case doc_id % 9 when 0 then 'fastapi' when 1 then 'react-dom' when 2 then '@nestjs/core' when 3 then 'psycopg2-binary' when 4 then 'numpy' when 5 then 'left-pad' || doc_id when 6 then 'torch' when 7 then 'pytest' else 'github.com/redis/redis' end", "version_spec": "case doc_id % 5 when 0 then '^1.2' when 1 then '1.0' when 2 then '' when 3 then '==2.1' else '~3' end", "dev": "doc_id % 4 = 0"}),
    "dependencies": ("part", {"repo_id": "p_brand", "name": "case p_partkey % 8 when 0 then 'react-dom' when 1 then '@vue/core' when 2 then 'numpy' when 3 then 'left-pad' || p_partkey when 4 then 'pytest' when 5 then 'github.com/gin-gonic/gin' when 6 then 'types/redis' else p_name end", "version_spec": "case p_size % 5 when 0 then '^1.2' when 1 then '1.0' when 2 then '' when 3 then '==2.1' else '~3' end", "dev": "p_partkey % 4 = 0"}),
    "notes": ("orders", {"id": "o_orderkey", "text": """case o_orderkey % 6 when 0 then 'Built with PyTorch and deep learning, ML on top' when 1 then 'shell scripting in bash; SQL, sql.' when 2 then 'Retrieval augmented generation with a vector store'
                when 3 then 'golang and Rust' when 4 then 'nothing to see' else 'TypeScript, js and py' end || ' ' || o_orderpriority"""}),
    "jobs": ("part", {"job_id": "p_partkey", "title": "case p_partkey % 6 when 0 then 'Senior Backend Engineer (Python)' when 1 then 'AI/ML Intern' when 2 then 'Frontend developer, React' when 3 then 'Platform role' when 4 then 'Data engineer' else p_name end",
        "description": """case p_partkey % 5 when 0 then 'We hire for the ' || p_brand || ' team.' || chr(10) || 'Requirements:' || chr(10) || '- Python and FastAPI, 4+ years' || chr(10) || '- PostgreSQL; Docker containers' || chr(10) || 'Nice to have:' || chr(10) || '- Kubernetes, React' || chr(10) || 'Responsibilities' || chr(10) || '- Own the services' || chr(10) || '* Review code'
                when 1 then 'Strong machine learning and PyTorch required. Deep_learning papers welcome.' || chr(10) || 'Preferred' || chr(10) || '- vector databases and RAG' when 2 then 'Familiarity with TypeScript and Tailwind CSS is a plus. You know Next.js and Go.'
                when 3 then '## What you''ll do' || chr(10) || '1. Run CI/CD pipelines' || chr(10) || '2. Keep Terraform tidy' || chr(10) || '## Must haves' || chr(10) || 'AWS, monitoring, 7 years of Linux, Git' else 'Something about ' || p_type || '. It has no list but sentences of some length. Another sentence follows here for good measure.' end"""}),
    "commits": (
        "orders",
        {
            "repo_id": "'repo' || (o_custkey % 40)",
            "sha": "md5('c' || o_orderkey)",
            "author_email": "case when o_orderkey % 5 = 0 then (o_orderkey % 9) || '+' else '' end || 'Dev' || (o_custkey % 97) || '@example.com'",
            "committed_at": "cast(o_orderdate as timestamp)",
            "message": """case o_orderkey % 14 when 0 then 'fix: correct rounding in total_price' when 1 then 'Refactor the parser' when 2 then 'Add tests for the reader' when 3 then 'docs: describe setup'
                when 4 then 'update' when 5 then 'Speed up the cache lookup' when 6 then 'Release 1.2 to the pipeline' when 7 then 'format with black' when 8 then 'bump deps'
                when 9 then 'Implement import of orders' when 10 then 'wip' when 11 then 'Merge branch feature/x' when 12 then 'Revert the last change' else 'Look into the strange case of Bob' end""",
            "insertions": "cast(floor(o_totalprice) as bigint) % 500",
            "deletions": "cast(floor(o_totalprice / 7) as bigint) % 120",
            "is_merge": "o_orderkey % 14 = 11",
        },
    ),
    "commit_files": ("lineitem", {"repo_id": "'repo' || (l_suppkey % 40)", "sha": "md5('c' || l_orderkey)", "path": "'src/f' || (l_partkey % 400) || '.py'", "added": "cast(floor(l_quantity) as bigint)", "removed": "cast(l_linenumber as bigint)"}),
    "branches": ("customer", {"repo_id": "'repo' || (c_custkey % 40)", "name": "case c_custkey % 3 when 0 then 'origin/main' when 1 then 'origin/feature-' || c_custkey else 'develop' end"}),
    "tags": ("supplier", {"repo_id": "'repo' || (s_suppkey % 50)", "name": "'v' || s_suppkey"}),
    "emails": ("customer", {"email": "'dev' || (c_custkey % 30) || '@example.com'"}),
    "edges": ("lineitem", {"repo_id": "'repo' || (l_suppkey % 20)", "src": "'m' || (l_partkey % 50)", "dst": "'m' || ((l_partkey * 7 + l_linenumber) % 50)"}),
    "category_scores": ("orders", {"evaluation_id": "o_custkey", "category": "'cat' || (o_orderkey % 9)", "score": "case when o_orderkey % 7 = 0 then null else cast(cast(floor(o_totalprice) as bigint) % 101 as double) end", "confidence": "0.4 + (o_orderkey % 6) / 10.0e0", "created_at": "cast(o_orderdate as timestamp)", "score_id": "o_orderkey"}),
    "policies": ("part", {"policy_key": "p_brand", "category": "'cat' || (p_partkey % 9)", "weight": "cast(p_size as double)"}),
    "evaluations": ("orders", {"evaluation_id": "o_orderkey", "candidate_id": "o_custkey", "job_id": "o_orderkey % 17", "repo_id": "'repo' || (o_custkey % 40)", "overall": "case when o_orderkey % 8 = 0 then null else cast(cast(floor(o_totalprice) as bigint) % 101 as double) end", "ownership": "cast(cast(floor(o_totalprice / 3) as bigint) % 101 as double)", "likelihood": "cast(cast(floor(o_totalprice / 11) as bigint) % 101 as double)", "coverage": "(o_orderkey % 10) / 9.0e0", "created_at": "cast(o_orderdate as timestamp)"}),
    "overrides": ("lineitem", {"evaluation_id": "l_orderkey", "category": "'cat' || (l_linenumber % 9)", "new_score": "l_quantity", "created_at": "cast(l_shipdate as timestamp)", "override_id": "l_partkey * 1000 + l_suppkey"}),
    "audit": ("events", {"created_at": "cast(ts as timestamp)", "actor_id": "user_id", "action": "event_type", "event_id": "event_id", "value": "value"}),
    "strengths": ("lineitem", {"repo_id": "'repo' || (l_suppkey % 40)", "skill": "'skill' || (l_partkey % 55)", "value": "l_discount * 8"}),
    "repositories": ("customer", {"id": "c_custkey", "repo_id": "'repo' || (c_custkey % 40)", "full_name": "c_name", "owner_id": "c_custkey % 50", "organization_id": "c_nationkey", "candidate_id": "c_custkey % 200", "is_fork": "c_custkey % 7 = 0", "is_archived": "c_custkey % 11 = 0", "last_analyzed_at": "case when c_custkey % 5 = 0 then null else c_acctbal end"}),
    "members": ("supplier", {"organization_id": "s_nationkey", "user_id": "s_suppkey % 10"}),
    "analyses": ("orders", {"analysis_id": "o_orderkey", "repo_id": "'repo' || (o_custkey % 40)", "created_at": "cast(o_orderdate as timestamp)", "score": "cast(cast(floor(o_totalprice) as bigint) % 101 as double)"}),
    "findings": ("lineitem", {"finding_id": "l_orderkey * 10 + l_linenumber", "analysis_id": "l_orderkey", "severity": "case l_linenumber % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end", "confidence": "l_discount * 9"}),
    "similar_rows": ("lineitem", {"row_id": "l_orderkey * 10 + l_linenumber", "analysis_id": "l_orderkey", "scope": "case l_linenumber % 2 when 0 then 'internal' else 'external' end", "similarity": "l_discount * 9 + l_tax / 10"}),
    "runs": ("events", {"run_id": "event_id", "repo_id": "'repo' || (user_id % 40)", "status": "case event_type when 'view' then 'COMPLETED' when 'error' then 'FAILED' when 'click' then 'RUNNING' when 'signup' then 'QUEUED' else 'COMPLETED' end", "created_at": "cast(ts as timestamp)", "duration": "value"}),
    "roles": ("part", {"job_id": "p_partkey % 17", "title": "p_name"}),
    "candidates": ("customer", {"candidate_id": "c_custkey", "display_name": "c_name", "email": "lower(c_name) || '@example.com'", "headline": "c_mktsegment", "organization_id": "c_nationkey"}),
    "notes_on": ("lineitem", {"note_id": "l_orderkey * 10 + l_linenumber", "evaluation_id": "l_suppkey", "created_at": "cast(l_shipdate as timestamp)", "visible_to_candidate": "l_linenumber % 3 = 0"}),
    "owners": ("nation", {"repo_id": "'src' || n_nationkey", "owner_id": "n_nationkey % 6"}),
    "resumes": ("customer", {"candidate_id": "c_custkey", "text": """'Person ' || c_custkey || chr(10) || 'Skills' || chr(10) || case c_custkey % 4 when 0 then 'Python (Advanced), React - basic' when 1 then 'expert in machine learning' when 2 then '- Docker: familiar' || chr(10) || '- Go' else 'SQL, PostgreSQL and Redis, intermediate' end || chr(10)
                || 'Projects:' || chr(10) || '- A shop for ' || c_mktsegment || chr(10) || 'Work Experience' || chr(10) || '* Engineer at ' || c_name || chr(10) || 'Education' || chr(10) || 'BSc ' || c_nationkey"""}),
    "spoken": ("conversations", {"session_id": "conv_id", "answer_id": "conv_id * 100 + turn", "question_id": "turn", "role": "role", "answer_text": """case turn % 4 when 0 then text when 1 then 'We chose the cache because it is faster; the downside is memory. First we measured, then we compared. See `load_rows` in mod2.py, line 12.' when 2 then 'not sure' else 'It is written in rust and ci runs everything, so that we wrote tests and I have tests. ' || text end""", "reviewer_score": "case when conv_id % 5 = 0 then cast(turn * 10 as double) end"}),
    "answers": ("conversations", {"session_id": "conv_id", "question_id": "turn", "role": "role", "answer_text": "text"}),
    "vectors": ("embeddings", {"id": "vec_id", "repo_id": "label", "embedding": "embedding"}),
}

# The same history and tables, for the repositories of the view code.
for _name in ("commits", "branches", "tags", "commit_files"):
    _base, _columns = VIEWS[_name]
    _key = {"commits": "o_custkey", "branches": "c_custkey", "tags": "s_suppkey", "commit_files": "l_orderkey"}[_name]
    VIEWS[f"code_{_name}"] = (_base, {**_columns, "repo_id": f"'src' || ({_key} % 19)"})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    table = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if base == "documents":  # what is done with texts takes much longer than to deal them out
        table = spread(table)
    return table.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def with_views(*names: str) -> str:
    return ",\n".join(f"{n} as (select {', '.join(f'{e} as {c}' for c, e in VIEWS[n][1].items())} from {VIEWS[n][0]})" for n in names)
