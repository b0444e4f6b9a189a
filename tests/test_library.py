"""The library's own operators on small rows, and every registered query on the smallest tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import classify, dependencies, graph, history, lines, scoring, security, serving, similarity
from quarry.plans.queries import ORACLES, QUERIES
from quarry.sources import readers, reports, sinks
from quarry.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in place) for r in want.fetchall())


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("path,language,category", [
    ("src/main.py", "python", "candidate_code"), ("app/page.tsx", "tsx", "candidate_code"), ("lib/util.ts", "typescript", "candidate_code"), ("core.cpp", "cpp", "candidate_code"),
    ("Dockerfile", "dockerfile", "configuration"), ("Makefile", "make", "configuration"), ("notes.md", "markdown", "documentation"), ("data.xyzzy", None, "asset"),
    ("node_modules/react/index.js", "javascript", "ignored"), ("assets/logo.png", None, "ignored"), ("static/app.min.js", "javascript", "ignored"),
    ("src/__tests__/a.spec.ts", "typescript", "test_code"), ("src/latest/foo.py", "python", "candidate_code"), ("yarn.lock", None, "dependency_code"), ("pyproject.toml", "toml", "configuration"), ("api/x_pb2.py", "python", "generated_code"),
])
def test_paths(spark, path, language, category):
    assert one(spark, classify.language("p"), p=path) == language
    assert one(spark, classify.category("p"), p=path) == category


def test_scripts_and_banners(spark):
    assert one(spark, classify.language("p", "f"), p="scripts/run", f="#!/usr/bin/env python3") == "python"
    assert one(spark, classify.category("p", "h"), p="src/a.py", h="# Code generated by x. DO NOT EDIT.") == "generated_code"


@pytest.mark.parametrize("message,intent", [("Fix the crash", "fix"), ("Refactor parser", "refactor"), ("tests for x", "test"), ("Update README", "docs"), ("optimize lookup", "perf"), ("docker image", "deploy"), ("Add login", "feature"), ("hello there", "other")])
def test_intents(spark, message, intent):
    assert one(spark, scalars.intent("m"), m=message) == intent


def test_message_quality_order(spark):
    q = lambda m: one(spark, scalars.message_quality("m"), m=m)
    assert q("fix") == 0.15 < q("Correct the rounding of invoice_total in exports") <= 1


def test_lines_and_duplicates(spark):
    block = "\n".join(f"value_{i} = compute_something({i}) + other_term" for i in range(8))
    rows = [("r", "a.py", "// comment\ncode()\n\n"), ("r", "b.py", block), ("r", "c.py", block), ("s", "d.py", "x = 1")]
    files = spark.createDataFrame(rows, "repo_id string, path string, text string")
    got = {r.path: r for r in lines.line_accounting(lines.lines_of(files)).collect()}
    assert (got["a.py"].comment_lines, got["a.py"].code_lines, got["a.py"].blank_lines) == (1, 1, 2)
    ratio = {r.repo_id: r.ratio for r in lines.duplication_ratio(lines.lines_of(files)).collect()}
    assert ratio == {"r": 0.5}
    assert lines.duplicate_examples(lines.lines_of(files)).first().path == "b.py"
    pairs, members = similarity.near_duplicates(similarity.chunks(files))
    assert pairs.count() == 0 and {r.id for r in members.where("path in ('b.py', 'c.py')").collect()} == {"b.py"}


def test_near_pairs(spark):
    text = " ".join(f"call{i} ( arg{i} )" for i in range(80))
    rows = [("r", "a", text), ("r", "b", text + " extra ( tail )"), ("r", "c", " ".join(f"other{i} [ z{i} ]" for i in range(60)))]
    chunked = similarity.chunks(spark.createDataFrame(rows, "repo_id string, path string, text string"))
    pairs, _ = similarity.near_duplicates(chunked)
    (pair,) = pairs.collect()
    sets = {r.path: set(r.fingerprints) for r in chunked.collect()}
    assert (pair.a, pair.b) == ("a", "b") and abs(pair.similarity - len(sets["a"] & sets["b"]) / len(sets["a"] | sets["b"])) < 1e-12


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJ234567"
    text = f'k = "{key}"\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"\napi_key = "your_key_example_here"\npassword = "aaaaaaaaaaaaaaaa"\npostgres://bob:hunter22@db.internal/x'
    files = spark.createDataFrame([("r", "src/a.py", text), ("r", "tests/a.py", f"x = '{key}'")], "repo_id string, path string, text string")
    found = security.dedupe_findings(security.scan_secrets(lines.lines_of(files))).collect()
    assert {(r.path, r.line_no, r.rule_id) for r in found} == {("src/a.py", 1, "aws_access_key_id"), ("src/a.py", 2, "generic_secret"), ("src/a.py", 5, "connection_string"), ("tests/a.py", 1, "aws_access_key_id")}
    assert all(r.masked_value.endswith("…[REDACTED]") and len(r.masked_value) <= 13 for r in found)
    scores = security.security_score(security.scan_secrets(lines.lines_of(files)), spark.createDataFrame([("r",), ("clean",)], "repo_id string"))
    assert {r.repo_id: r.score for r in scores.collect()}["clean"] == 100


def test_patterns_by_language(spark):
    text = "debug = True\n# debug = True\nuse(mark_safe(x))"
    files = classify.classified(spark.createDataFrame([("r", "a.py", text, 1), ("r", "a.java", text, 1)], "repo_id string, path string, text string, size_bytes long"))
    got = {(r.path, r.rule_id) for r in security.scan_patterns(lines.lines_of(files), files).collect()}
    assert got == {("a.py", "debug_enabled"), ("a.java", "debug_enabled"), ("a.py", "jinja_autoescape_off")}


def test_overall_score_leaves_missing_out(spark):
    w = spark.createDataFrame([(c, 1.0) for c in "abcd"], "category string, weight double")
    rows = [(1, "a", 80.0), (1, "b", 80.0), (1, "c", 80.0), (1, "d", None), (2, "a", None)]
    s = spark.createDataFrame([(e, c, v, 0.9) for e, c, v in rows], "evaluation_id int, category string, score double, confidence double")
    got = {r.evaluation_id: r for r in scoring.overall_score(s, w).collect()}
    assert got[1].score == 80 and got[1].coverage == 0.75 and got[2].score is None
    bad = spark.createDataFrame([("p", "a", -1.0)], "policy_key string, category string, weight double")
    with pytest.raises(Exception, match="policy weights"):
        scoring.policy_weights(bad).collect()


def test_cycles_and_edges(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")], "repo_id string, src string, dst string")
    assert [r.cycle for r in graph.import_cycles(e).collect()] == ["a -> b -> c -> a"]
    files = spark.createDataFrame([("r", "pkg/core/io.py"), ("r", "tests/io.py"), ("r", "main.py")], "repo_id string, path string")
    imports = spark.createDataFrame([("r", "main.py", "core.io"), ("r", "main.py", "io"), ("r", "main.py", "os")], "repo_id string, path string, target string")
    assert {(r.src, r.dst) for r in graph.import_edges(imports, files).collect()} == {("main.py", "pkg/core/io.py")}


def test_manifests(spark):
    rows = [
        ("r", "package.json", json.dumps({"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29.0.0"}})), ("r", "bad/package.json", "{"),
        ("r", "requirements.txt", "# c\nflask==2.0 # web\n-r other.txt\nrequests[socks]>=2\n"), ("r", "Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0" }\n[dev-dependencies]\nrand = "0.8"\n'),
        ("r", "go.mod", "module example.com/m\nrequire github.com/a/b v1.2.3\n"), ("r", "pyproject.toml", '[project]\ndependencies = [\n  "numpy>=1",\n]\n[tool.poetry.dependencies]\npython = "3.12"\nhttpx = "^0.27"\n'),
    ]
    got = {(r.ecosystem, r.name, r.version_spec, r.dev) for r in dependencies.inventory(spark.createDataFrame(rows, "repo_id string, path string, text string")).collect()}
    assert got == {("npm", "react", "^18", False), ("npm", "jest", "29.0.0", True), ("pypi", "flask", "==2.0", False), ("pypi", "requests", ">=2", False), ("cargo", "serde", "1.0", False), ("cargo", "rand", "0.8", True), ("go", "github.com/a/b", "v1.2.3", False), ("pypi", "numpy", ">=1", False), ("pypi", "httpx", "^0.27", False)}


def test_readers(spark, tmp_path):
    (tmp_path / "trees/repo1/src").mkdir(parents=True)
    (tmp_path / "trees/repo1/src/a.py").write_text("x = 1\n")
    (tmp_path / "trees/repo1/b.bin").write_bytes(b"ab\0cd")
    got = {r.path: r for r in readers.read_files(spark, str(tmp_path / "trees")).collect()}
    assert got["src/a.py"].text == "x = 1\n" and got["src/a.py"].repo_id == "repo1" and got["b.bin"].text is None
    log = "\x1e" + "\x1f".join(["s1", "Ann", "Ann@X.org", "2024-01-02T03:04:05+00:00", "p1 p2", "Subject\n\nbody 1\n3\t-\tsrc/a.py\n2\t1\tb.md\n"]) + "\x1e" + "\x1f".join(["s2", "B", "b@x", "2024-01-03T00:00:00Z", "", "No files"])
    (tmp_path / "repo1.log").write_text(log)
    commits = readers.read_commit_log(spark, str(tmp_path / "repo1.log"))
    rows = {r.sha: r for r in commits.collect()}
    assert rows["s1"].message == "Subject\n\nbody 1" and rows["s1"].is_merge and rows["s1"].author_email == "ann@x.org" and not rows["s2"].is_merge
    assert {(r.path, r.added, r.removed) for r in readers.commit_files(commits).collect()} == {("src/a.py", 3, 0), ("b.md", 2, 1)}


def test_sinks_and_streams(spark, tmp_path):
    a = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 2)], "repo_id string, path string, n int")
    out = str(tmp_path / "snapshot")
    sinks.replace_snapshot(a, out)
    sinks.replace_snapshot(a.where("repo_id = 'r1'").withColumn("n", F.lit(9)), out)
    held = lambda: {(r.repo_id, r.n) for r in sinks.read_snapshot(spark, out, a.schema).collect()}
    assert held() == {("r1", 9), ("r2", 2)}
    sinks.replace_snapshot(a.limit(0), out, repositories=spark.createDataFrame([("r2",)], "repo_id string"))
    assert held() == {("r1", 9)}
    a.withColumns({"n": F.lit(7), "version": F.lit("lost")}).write.mode("append").partitionBy("version").parquet(f"{out}/rows")  # a run that was lost before its manifest
    assert held() == {("r1", 9)}
    events = spark.createDataFrame([(i, "click" if i % 2 else "view", i % 3) for i in range(20)], "i int, action string, actor_id int").withColumn("created_at", F.timestamp_seconds(F.col("i") * 10))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "events")).schema).parquet(str(tmp_path / "events"))
    for name, df in (("act", jobs.activity(stream, "60 seconds")), ("off", jobs.offenders(stream, 1)), ("last", jobs.job_states(stream.select(F.col("actor_id").alias("job_id"), F.col("action").alias("status"), F.col("created_at").alias("at"))))):
        query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.table("act").agg(F.sum("n")).first()[0] == 20 and spark.table("last").count() == 3
    assert {r.n for r in spark.table("off").collect()} == {2}


def test_ingest_reads_what_it_touches(spark, tmp_path):
    schema = "repo_id string, path string, content_hash string, n int"
    batches = [[("r", "a", "h1", 1), ("r", "b", "h2", 1), ("r", "a", "h1", 1)], [("r", "a", "h1", 2), ("r", "a", "h3", 2), ("s", "a", "h1", 2)], [("s", "a", "h1", 3)]]
    out, source = str(tmp_path / "index"), str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.into_snapshot(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "mark"), parts=4).awaitTermination(60)
    assert sorted((r.repo_id, r.path, r.content_hash, r.n) for r in spark.read.parquet(out).collect()) == [("r", "a", "h1", 1), ("r", "a", "h3", 2), ("r", "b", "h2", 1), ("s", "a", "h1", 2)]
    lost = jobs.into_snapshot(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "other mark"), parts=4)  # all again, by a query that knows of nothing
    lost.awaitTermination(60)
    assert lost.exception() is None and spark.read.parquet(out).count() == 4


def test_trees_are_pruned_and_decoded(spark, tmp_path):
    files = {"one/src/a.py": "x = 'é'\n".encode(), "one/top.md": b"# hi", "one/node_modules/p/index.js": b"no", "one/src/deep/__pycache__/a.pyc": b"no", "two/a/b/c/d.txt": "höher!".encode("utf-16-le"), "two/latin.txt": "é1x".encode("latin-1"), "two/bom.txt": b"\xff\xfe" + "żłćą".encode("utf-16-le"), "two/large.txt": b"x" * 3000, "two/zero.bin": b"a\0b"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "two/link.txt").symlink_to(tmp_path / "one/top.md")
    got = {f"{r.repo_id}/{r.path}": r.text for r in readers.read_files(spark, str(tmp_path), 2000).collect()}
    assert got == {"one/src/a.py": "x = 'é'\n", "one/top.md": "# hi", "two/latin.txt": "é1x", "two/bom.txt": "żłćą", "two/zero.bin": None, "two/a/b/c/d.txt": None}
    assert readers.read_files(spark, str(tmp_path / "one/src/deep")).count() == 0


def test_budgets(spark):
    sizes = [("r", f"p{i:03}", 10 + i % 3) for i in range(300)] + [("s", "a", 5), ("s", "b", 500), (None, "c", 7)]
    rows = spark.createDataFrame(sizes, "repo_id string, path string, size_bytes long").repartition(7)
    got, want, before, place = {(r.repo_id, r.path): (r.kept, r.exceeded) for r in classify.within_budget(rows, 200, 400, 1000).collect()}, {}, {}, {}
    for repo, path, size in sorted(sizes, key=str):
        if size <= 400:
            before[repo], place[repo] = before.get(repo, 0) + size, place.get(repo, 0) + 1
            want[repo, path] = (place[repo] <= 200 and before[repo] <= 1000, before[repo] > 1000)
    assert got == want
    commits = spark.createDataFrame([("r", f"s{i:02}", f"2024-01-{1 + i // 2:02} 00:00:00") for i in range(20)] + [("q", "x", "2024-01-01 00:00:00")], "repo_id string, sha string, committed_at string")
    kept = {(r.repo_id, r.sha, r.truncated) for r in history.newest_commits(commits, 5).collect()}
    assert kept == {("r", "s18", True), ("r", "s19", True), ("r", "s16", True), ("r", "s17", True), ("r", "s14", True), ("q", "x", False)}


def test_visibility_and_pages(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "id int, owner_id int, organization_id int")
    members = spark.createDataFrame([(1, 5), (1, 5)], "organization_id int, user_id int")
    assert {r.id for r in serving.visible(rows, members, 5).collect()} == {i for i in range(12) if i % 2 == 1}
    assert [r.id for r in serving.page(rows, [F.desc("id")], 3, 2).orderBy(F.desc("id")).collect()] == [9, 8, 7]
    commits = spark.createDataFrame([("r", "s1", "1+ann@x.org", False), ("r", "s2", "ann@x.org", False), ("r", "s3", "bob@x.org", False), ("r", "s4", "ann@x.org", True)], "repo_id string, sha string, author_email string, is_merge boolean")
    emails = spark.createDataFrame([("Ann@x.org",)], "email string")
    assert {r.sha for r in history.candidate_commits(commits, emails).collect()} == {"s1", "s2"}


def test_full_report(spark):
    e = spark.createDataFrame([(1, "r1", 5, 7, 71.5, "verified"), (2, "r2", 6, 8, None, None)], "evaluation_id int, repo_id string, candidate_id int, job_id int, overall double, verification_status string")
    tables = {
        "repositories": spark.createDataFrame([("r1", "org/one"), (None, "none")], "repo_id string, full_name string"),
        "scores": spark.createDataFrame([(1, "a", 50.0, 0.2, 0.9), (1, "b", None, 0.8, 0.4)], "evaluation_id int, category string, score double, weight double, confidence double"),
        "evidence": spark.createDataFrame([(1, "tested well", "testing", "strength", 0.9), (1, "no readme", "documentation", "weakness", 0.5), (1, "own work", "ownership", "strength", 0.95)], "evaluation_id int, claim string, category string, supports string, confidence double"),
        "findings": spark.createDataFrame([("r1", f"f{i:03}", "high", "a.py", i, 0.5) for i in range(400)], "repo_id string, title string, severity string, path string, line_no int, confidence double"),
        "similarity": spark.createDataFrame([("r1", "internal", "x", "y", 0.9), ("r1", "external", "x", "z", 0.7)], "repo_id string, scope string, source string, matched string, similarity double"),
        "notes": spark.createDataFrame([(1, "ann", "fine", "2024-01-01", True), (1, "bob", "secret", "2024-01-02", False)], "evaluation_id int, author string, body string, created_at string, visible_to_candidate boolean"),
    }
    got = {r.evaluation_id: r for r in reports.full_report(e, tables).collect()}
    one = got[1]
    assert one.repository.full_name == "org/one" and [s.category for s in one.scores] == ["b", "a"] and [s.claim for s in one.strengths] == ["own work", "tested well"]
    assert len(one.security) == 25 and one.security[0].line_no == 0 and [m.matched for m in one.external_matches] == ["z"] and [n.author for n in one.notes] == ["ann"] and one.questions == [] and got[2].scores == [] and got[2].repository is None
    assert [len(r.notes) for r in reports.full_report(e, tables, private=True).orderBy("evaluation_id").collect()] == [2, 0]
    text = {r.evaluation_id: r.report for r in reports.as_markdown(reports.full_report(e, tables)).collect()}
    assert "- overall: 71.5" in text[1] and "| b | not measured | 80% | 40% |" in text[1] and "- **no readme** (confidence 50%)" in text[1] and "secret" not in text[1] and "None recorded." in text[2]
    loaded = {r.evaluation_id: json.loads(r.report) for r in reports.as_json(reports.full_report(e, tables)).collect()}
    assert loaded[1]["security"][24]["title"] == "f024" and loaded[2]["scores"] == []
    assert reports.full_report(e.limit(0), {}).count() == 0


def test_hosting_exports(spark, tmp_path):
    (tmp_path / "users.json").write_text('{"id": 1, "login": "ann", "name": " ", "email": "Ann@X.org", "followers": 3, "created_at": "2020-01-02T03:04:05Z"}\n{"id": 2, "login": "bob"}\n')
    one, two = readers.read_hosting_users(spark, str(tmp_path / "users.json")).orderBy("id").collect()
    assert (one.login, one.name, one.email, one.followers, one.public_repos, one.created_at.year) == ("ann", None, "ann@x.org", 3, 0, 2020) and (two.email, two.created_at) == (None, None)
    (tmp_path / "issues.json").write_text('{"number": 1, "title": "a", "state": "open"}\n{"number": 2, "title": "b", "state": "open", "pull_request": {"url": "u"}}\n')
    assert [r.number for r in readers.read_issues(spark, str(tmp_path / "issues.json")).collect()] == [1]
    (tmp_path / "cv").mkdir()
    (tmp_path / "cv/ann.md").write_text("# Ann\nSkills")
    assert [tuple(r) for r in readers.read_resumes(spark, str(tmp_path / "cv")).collect()] == [("ann", "# Ann\nSkills")]


def test_queries_in_passes(spark):
    rows = [(i, f"r{i % 3}", [float((i * 7 + d * 3) % 11 - 5) for d in range(6)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, repo_id string, embedding array<double>")
    got = [sorted(tuple(r) for r in similarity.top_similar(vectors.where("id % 3 < 2"), vectors, 4, most=n).select("query_id", "place", "id", "similarity").collect()) for n in (1 << 15, 9)]
    assert got[0] == got[1] and len(got[0]) == 160


def test_matches_by_meaning(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 64))
    near = np.concatenate([base * c + rng.standard_normal(base.shape) * (1 - c * c) ** 0.5 for c in (0.62, 0.7, 0.9, 1.0)])
    unit = lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).tolist()
    schema = "repo_id string, id string, embedding array<double>"
    own, other = [("r", f"o{i}", v) for i, v in enumerate(unit(base))] + [("r", "zero", [0.0] * 64)], [(f"s{i % 3}", f"c{i}", v) for i, v in enumerate(unit(near))] + [("r", "own", unit(base)[0]), ("s0", "zero", [0.0] * 64)]
    found = {(x.id, x.matched_id): x.cosine for x in similarity.near_in_meaning(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema)).collect()}
    want = {(a[1], b[1]): float(np.dot(a[2], b[2])) for a in own for b in other if a[0] != b[0] and np.dot(a[2], b[2]) >= 0.6}
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want) > 80 and all(abs(found[k] - want[k]) < 1e-9 for k in found)
    text = {"a": "load rows from the table and count them by key", "b": "load rows from this table and count them by key now", "c": "entirely different words stand here"}
    e = {r.id: r.embedding for r in similarity.dense_embedding(spark.createDataFrame([*text.items(), ("d", "")], "id string, text string")).collect()}
    assert len(e["d"]) == 256 and not any(e["d"]) and abs(np.linalg.norm(e["a"]) - 1) < 1e-9
    chunk = lambda repo, i: (repo, i, f"sig{i}{repo}", [f"f{i}{repo}"], e[i])
    chunks = spark.createDataFrame([chunk("r", "a"), chunk("s", "b"), chunk("s", "c"), chunk("t", "d")], "repo_id string, id string, signature string, fingerprints array<string>, embedding array<double>")
    best = {(x.repo_id, x.id): (x.matched_repo, x.matched_id, round(x.similarity, 6)) for x in similarity.corpus_matches(chunks, chunks).collect()}
    score = round(0.75 * float(np.dot(e["a"], e["b"])), 6)
    assert score >= 0.45 and best == {("r", "a"): ("s", "b", score), ("s", "b"): ("r", "a", score)}


def test_nearest_in_meaning_by_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    base = rng.standard_normal((30, 16))
    vectors = np.concatenate([base, base + 0.15 * rng.standard_normal(base.shape), base + 0.6 * rng.standard_normal(base.shape), base[:6]])
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).tolist()
    rows = [(f"r{i % 4}", f"c{i:03}", v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "repo_id string, id string, embedding array<double>")
    cosine = {(a[1], b[1]): float(np.dot(a[2], b[2])) for a in rows for b in rows if a[0] != b[0]}
    for block in (1 << 14, 16):
        every = {(x.id, x.matched_id): x.cosine for x in similarity.near_in_meaning(frame, frame, block=block).collect()}
        first = {}
        for (a, b), c in cosine.items():  # of entries with one vector the first stands
            if c >= 0.6:
                key = (a, tuple(vectors[int(b[1:])]))
                first[key] = min(first.get(key, (b,)), (b,), key=lambda x: (rows[int(x[0][1:])][0], x[0]))
        assert set(every) == {(a, b) for (a, _), (b,) in first.items()}
        best = {}
        for x in similarity.near_in_meaning(frame, frame, nearest=True, block=block).collect():
            best[x.id] = max(best.get(x.id, 0.0), x.cosine)
        want = {a: max(c for (k, _), c in cosine.items() if k == a) for a in {k for k, _ in cosine}}
        assert set(best) == {a for a, c in want.items() if c >= 0.6} and all(abs(c - want[a]) < 1e-9 for a, c in best.items())


def test_corpus_matches_like_brute_force(spark):
    from random import Random

    draw = Random(9)
    rows = [(f"r{draw.randrange(4)}", f"c{i:02}", f"s{draw.randrange(40)}", [f"f{x:02}" for x in sorted(draw.sample(range(14), draw.randrange(2, 9)))]) for i in range(70)]
    rows += [("r1", "whole", "w", [f"g{i:02}" for i in range(20)]), ("r2", "part", "p", [f"g{i:02}" for i in range(11, 20)])]  # Jaccard 0.45, containment 0.45: the eleven that aren't shared are as rare
    rows += [("r3", "other", "o", [f"g{i:02}" for i in range(11, 20)] + [f"h{i:02}" for i in range(40)])]
    best = {}
    for r, i, s, f in rows:
        for q, j, t, g in rows:
            both = len({*f} & {*g})
            score = max(both / len({*f} | {*g}), 0.9 * (both / len(f)), 0.7 if s == t else 0.0)
            if r != q and score >= 0.45:
                best[r, i] = min(best.get((r, i), (-score, q, j)), (-score, q, j))
    frame = spark.createDataFrame(rows, "repo_id string, id string, signature string, fingerprints array<string>")
    got = {(x.repo_id, x.id): (-x.similarity, x.matched_repo, x.matched_id) for x in similarity.corpus_matches(frame, frame).collect()}
    assert got == best and got["r1", "whole"][1:] == ("r2", "part")


def test_measures_are_kept_as_compressed_files(spark, tmp_path):
    from quarry.plans import project

    class Given:
        def __call__(self, name):
            return spark.range(2000).selectExpr("'r' as repo_id", "concat('a/', id) as path", "repeat('x = 1\n', 200) as text")

    kept = project.rows(Given())
    assert kept.count() == 2000 * 201 and kept.inputFiles()
    from pathlib import Path

    assert sum(Path(f.removeprefix("file:")).stat().st_size for f in {x.replace("file:///", "file:/") for x in kept.inputFiles()}) < 2000 * 1200
