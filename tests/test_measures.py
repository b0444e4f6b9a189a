"""Jobs, skills, people, structure and scores on small literal rows."""


from quarry.operators import classify, dependencies, evidence, graph, history, jobs, lines, measures, people, scoring, serving, similarity, skills, structure

JOB = """About the role
We build assistants.

Requirements:
- Python and PyTorch, 3+ years
- Docker

Nice to have:
- Kubernetes
"""


def test_requirements_of_a_job(spark):
    rows = spark.createDataFrame([(1, "AI/ML Intern", JOB), (2, "", "Nothing named here."), (3, None, None)], "job_id int, title string, description string")
    got = {(r.job_id, r.skill): r for r in jobs.requirements(rows).collect()}
    assert {k for k in got if k[0] != 1} == set()
    required = {s for (_, s), r in got.items() if r.required}
    assert required == {"python", "pytorch", "docker", "machine_learning"} and not got[1, "kubernetes"].required
    assert abs(sum(r.importance for r in got.values()) - 1) < 1e-9 and got[1, "machine_learning"].importance > got[1, "docker"].importance
    own = {r.job_id: r for r in jobs.parsed(rows).collect()}
    assert (own[1].level, own[1].min_years) == ("intern", 3) and own[2].domain == "general" and own[3].level == "unspecified"


def test_longer_terms_take_their_words(spark):
    docs = spark.createDataFrame([(1, "Vector databases and vector search; C++ and C, my_python"), (2, None), (3, "next.js React")], "id int, text string")
    got = {(r.id, r.skill) for r in skills.extract(docs).collect()}
    assert got == {(1, "vector_database"), (1, "rag"), (1, "cpp"), (1, "c"), (3, "nextjs"), (3, "react")}


def test_strength_of_a_skill(spark):
    files = spark.createDataFrame([("r", "src/api/a.py", "python", "candidate_code", 100), ("r", "b.sql", "sql", "candidate_code", 0)], "repo_id string, path string, language string, category string, size_bytes long")
    names = spark.createDataFrame([("r", "fastapi"), ("r", "psycopg2-binary"), ("r", "fastapi")], "repo_id string, name string")
    signals = spark.createDataFrame([("r", "git", 1.0)], "repo_id string, skill string, strength double")
    texts = spark.createDataFrame([("r", "readme", "React app"), ("r", "topic", None)], "repo_id string, source string, text string")
    got = {r.skill: r.strength for r in skills.skill_strength(skills.repository_evidence(files, names, signals, texts)).collect()}
    assert got["python"] == 0.9 and abs(got["fastapi"] - (0.45 * 0.8 + 0.35)) < 1e-9 and got["git"] == 0.5 and got["react"] == 0.1 and abs(got["rest_api"] - 0.35) < 1e-9


SOURCE = '''class Service:
    """Serves."""

    def handle(self, a, b):
        if a:
            for x in b:
                try:
                    x()
                except ValueError:
                    pass
        return a


def test_handle():
    return 1
'''


def test_entities_complexity_and_nesting(spark):
    rows = lines.lines_of(spark.createDataFrame([("r", "a.py", SOURCE), ("r", "b.py", ""), ("r", "c.py", None)], "repo_id string, path string, text string"))
    found = structure.entities(rows)
    got = {r.symbol: r for r in found.collect()}
    assert (got["Service"].start_line, got["Service"].end_line, got["Service"].has_doc, got["Service"].parent) == (1, 13, True, None)
    assert (got["handle"].n_params, got["handle"].parent, got["handle"].end_line) == (2, 1, 13) and not got["test_handle"].has_doc
    assert {r.symbol: r.complexity for r in structure.entity_complexity(found, rows).collect()}["handle"] == 4
    assert {r.symbol: r.nesting for r in structure.entity_nesting(found, rows).collect()}["handle"] == 4


def test_scores_of_a_small_repository(spark):
    rows = [("r", "src/api/a.py", SOURCE), ("r", "tests/test_a.py", "def test_a():\n    assert 1\n"), ("r", ".github/workflows/ci.yml", "run: pytest --cov\n"), ("r", ".env", "A=1"), ("r", ".gitignore", ".env\n"), ("r", "main.py", "print(1)\n"), ("q", "notes.txt", "x")]
    files = classify.classified(spark.createDataFrame([(*r, len(r[2])) for r in rows], "repo_id string, path string, text string, size_bytes long"))
    tests = {r.repo_id: r for r in measures.testing_metrics(files).collect()}
    assert tests["r"].test_cases == 1 and tests["r"].ci_runs_tests and tests["r"].coverage_tracked and not tests["q"].has_ci
    scores = {r.repo_id: r.score for r in measures.testing_score(measures.testing_metrics(files)).collect()}
    assert scores["r"] > 70 and scores["q"] == 0
    none = spark.createDataFrame([], "repo_id string, severity string, confidence double")
    secure = {r.repo_id: r.score for r in measures.security_score(measures.security_metrics(files, none, none)).collect()}
    assert secure["r"] == 100 - 25 + 6 and secure["q"] == 100
    text = lines.lines_of(files.select("repo_id", "path", "text"))
    quality = {r.repo_id: r.score for r in measures.code_quality(measures.code_metrics(files, text, structure.entities(text))).collect()}
    assert quality["r"] > 60 and quality["q"] is None
    edges = spark.createDataFrame([], "repo_id string, src string, dst string")
    built = {r.repo_id: r.score for r in measures.architecture_score(measures.architecture_metrics(files, edges, edges.select("repo_id"))).collect()}
    assert 0 < built["r"] <= 100


def test_levels_in_resumes(spark):
    text = "Jane\nSkills\nPython (Advanced), React\nexpert in machine learning\nProjects\n- A compiler in Rust\nEducation:\nBSc Mathematics"
    df = spark.createDataFrame([(1, text), (2, None)], "candidate_id int, text string")
    got = {r.skill: (r.claimed_level, r.expected) for r in people.resume_skills(df).collect()}
    assert got["python"] == ("advanced", 0.65) and got["react"] == (None, 0.35) and got["machine_learning"] == ("expert", 0.75)
    assert {(r.kind, r.entry) for r in people.resume_entries(df).collect()} == {("project", "A compiler in Rust"), ("education", "BSc Mathematics")}


def test_answers(spark):
    schema = "answer_id int, answer_text string, expected_points array<string>, anchors array<string>, files array<string>, symbols array<string>, languages array<string>, test_cases long, ci_runs_tests boolean"
    good = "First we measured the cache in `load_rows` (mod2.py), because reads were slow; the trade-off is memory, which means eviction matters."
    rows = [(1, good, ["measured cache reads"], ["mod2.py", "load_rows"], ["mod2.py"], ["load_rows"], ["python"], 3, True), (2, "no", ["x"], [], [], [], [], 0, False), (3, "It is written in rust and we have tests for everything here.", [], None, None, None, ["python"], 0, False), (4, None, None, None, None, None, None, None, None)]
    got = {r.answer_id: r for r in people.assess_answers(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].technical_correctness == 100 and got[1].specificity > 70 and got[1].score > 70
    assert got[2].score == 0 and got[4].score == 0 and got[3].repository_consistency == 30


def test_categories_merge_and_failures(spark):
    rows = [("r", "architecture", 80.0, 0.7), ("r", "dependencies", 40.0, 0.9), ("r", "testing", None, 0.5)]
    results = spark.createDataFrame(rows, "repo_id string, analyzer string, score double, confidence double")
    names = {"architecture": "architecture", "dependencies": "architecture", "testing": "testing"}
    scores = evidence.category_scores(results, names)
    got = {r.category: r for r in scores.collect()}
    assert abs(got["architecture"].score - (80 * 0.65 + 40 * 0.35)) < 1e-9 and got["architecture"].confidence == 0.7 and not got["testing"].available
    failed = spark.createDataFrame([("r", "dependencies", "timed out")], "repo_id string, analyzer string, reason string")
    assert {r.category: r.score for r in evidence.with_failures(scores, failed, names).collect()}["architecture"] is None
    assert {(r.analyzer, r.reason) for r in evidence.limitations(results, failed).collect()} == {("testing", "nothing to measure"), ("dependencies", "timed out")}


def test_manifest_lists_and_tables(spark):
    rows = [("r", "pyproject.toml", '[project]\nname = "x"\ndependencies = ["a>=1", "b"]\n[project.optional-dependencies]\ndev = ["pytest"]\nplot = [\n  "c<2",\n]\n'), ("r", "Cargo.toml", '[dependencies.serde]\nversion = "1.0"\nfeatures = ["derive"]\n')]
    got = {(r.name, r.version_spec, r.dev) for r in dependencies.inventory(spark.createDataFrame(rows, "repo_id string, path string, text string")).collect()}
    assert got == {("a", ">=1", False), ("b", "", False), ("pytest", "", True), ("c", "<2", False), ("serde", "1.0", False)}


def test_components_and_shared_fingerprints(spark):
    edges = spark.createDataFrame([("r", a, b) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g")]], "repo_id string, src string, dst string")
    assert {(r.node, r.component) for r in graph.strong_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    rows = [("r", f"p{i:04}", ["hot", f"x{i}", f"y{i}", f"z{i // 2}", f"w{i // 2}", f"v{i // 2}"]) for i in range(600)]
    pairs, _ = similarity.near_duplicates(spark.createDataFrame(rows, "repo_id string, path string, fingerprints array<string>"), 0.4)
    assert pairs.count() == 300


def test_filters_and_policies(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, "a", 9.0)], "id int, kind string, score double")
    assert [r.id for r in serving.filtered(rows, {"kind": "a"}, {"score": 6.0}).collect()] == [3] and serving.filtered(rows, {"kind": None}).count() == 3
    assert scoring.job_match(spark.createDataFrame([], "job_id int, skill string, importance double, required boolean"), spark.createDataFrame([("r", "x", 1.0)], "repo_id string, skill string, strength double")).count() == 0


def test_short_cycles_and_substring_references(spark):
    pairs = [("r", a, b) for a, b in ["ab", "bc", "ca", "cd", "dc", "ee", "xy", "yz", "bd"]] + [("ring", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    pairs += [("dense", a, b) for a in "abcdefgh" for b in "abcdefgh" if a != b]
    edges = spark.createDataFrame(pairs, "repo_id string, src string, dst string")
    got = {}
    for r in graph.short_cycles(edges).orderBy("repo_id", "place").collect():
        got.setdefault(r.repo_id, []).append(r.cycle)
    assert got["r"] == ["e -> e", "c -> d -> c", "a -> b -> c -> a", "a -> b -> d -> c -> a"]
    assert got["ring"] == ["n0 -> n1 -> n2 -> n3 -> n4 -> n5 -> n0"] and len(got["dense"]) == 10 and got["dense"][0] == "a -> b -> a"
    assert graph.short_cycles(edges.where("repo_id = 'ring'"), longest=5).count() == 0 and graph.short_cycles(edges.limit(0)).count() == 0
    rows = [("r", "src/utils.py", "candidate_code", ""), ("r", "t/a.py", "test_code", "def mod_UTILS_test(): pass"), ("s", "src/util.py", "candidate_code", ""), ("s", "t/a.py", "test_code", "uti tils"), ("q", "src/abc.py", "candidate_code", ""), ("q", "t/a.py", "test_code", "abc"), ("n", "x.py", "test_code", None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, category string, text string")
    assert {r.repo_id: r.references_own for r in structure.own_references(files).collect()} == {"r": True, "s": False, "q": False, "n": False}


def test_every_repository_has_a_history_row(spark):
    commits = spark.createDataFrame([("a", "s1", "x@y", "2020-01-01 00:00:00", "fix: it", 3, 1, False)], "repo_id string, sha string, author_email string, committed_at string, message string, insertions long, deletions long, is_merge boolean")
    branches, tags = (spark.createDataFrame([(r, "v")], "repo_id string, name string") for r in ("b", "c"))
    got = {r.repo_id: (r.score is None, r.confidence) for r in history.history_score(commits, branches, tags).collect()}
    assert got == {"a": (False, 0.55), "b": (True, 0.0), "c": (True, 0.0)}


def test_brace_languages(spark):
    script = """// top {
/** doc */
export default class Shop extends Base<T> {
  constructor({ a, b }) { this.a = "}"; }
  async load({ id, deep = 1 }, more) {
    const one = async (x) => {
      return `${x} }`;
    };
    if (a && b) { go(); } else if (c) { x(); }
    for (let i = 0; i < 3; i++) { y(); }
    items.forEach(function (z) { w(z); });
  }
}
const f = function* (p) { yield 1; };
obj = { run: (q) => {
  return 1;
} };
function last(a,
  b) {
  while (true) { break; }
"""
    java = """package x;
public class Foo<T> implements Bar {
  private final int[] z = { 1, 2 };
  // says
  public static List<String> names(int a, String b) throws IOException, Bad {
    return new ArrayList<>() {{ add("x"); }};
  }
  enum Kind { A, B }
}
struct node make(int v) {
  switch (v) { case 1: return n; }
}
"""
    rows = [("r", "a.js", "javascript", script), ("r", "b.java", "java", java), ("r", "e.ts", "typescript", ""), ("r", "n.ts", "typescript", None), ("r", "x.toml", "toml", "def f(a):\n    return 1"), ("r", "p.py", "python", "def f(a):\n    if a:\n        return 1"), ("r", "m.md", None, "class X:\n    def y(self): pass")]
    files = spark.createDataFrame(rows, "repo_id string, path string, language string, text string")
    found = structure.parsed_entities(files, lines.lines_of(files))
    got = {(r.path, r.symbol, r.kind, r.start_line, r.end_line, r.n_params, r.has_doc, r.parent) for r in found.collect()}
    assert got == {
        ("a.js", "Shop", "class", 3, 13, 0, True, None), ("a.js", "constructor", "function", 4, 4, 1, False, 3), ("a.js", "load", "function", 5, 12, 2, False, 3), ("a.js", "one", "function", 6, 8, 1, False, 5),
        ("a.js", "anonymous", "function", 11, 11, 1, False, 5), ("a.js", "f", "function", 14, 14, 1, False, None), ("a.js", "run", "function", 15, 17, 1, False, None), ("a.js", "last", "function", 18, 20, 2, False, None),
        ("b.java", "Foo", "class", 2, 9, 0, False, None), ("b.java", "names", "function", 5, 7, 2, True, 2), ("b.java", "Kind", "class", 8, 8, 0, False, 2), ("b.java", "make", "function", 10, 12, 1, False, None), ("p.py", "f", "def", 1, 3, 1, False, None),
    }
    complexity = {r.symbol: r.complexity for r in structure.entity_complexity(found.where("path = 'a.js'"), lines.lines_of(files)).collect()}
    assert complexity["load"] == 5 and complexity["last"] == 2 and complexity["run"] == 1


def test_strong_components_of_long_chains_rings_and_random_graphs(spark):
    from random import Random

    draw, pairs = Random(3), []
    for g in range(40):
        pairs += [(f"g{g}", str(draw.randrange(14)), str(draw.randrange(14))) for _ in range(8 + g % 20)]
    pairs += [("long", f"c{i}", f"c{i - 1}") for i in range(1, 500)] + [("ring", f"r{i:03}", f"r{(i + 1) % 450:03}") for i in range(450)] + [("ring", "r007", "tail"), ("ring", "head", "r100")]
    pairs += [("beads", f"b{i:03}{x}", f"b{j:03}{y}") for i in range(40) for j, x, y in ((i, "p", "q"), (i, "q", "p"), (i + 1, "q", "p"))]
    want, after = {}, {}
    for r, a, b in pairs:
        after.setdefault((r, a), set()).add(b)
    reach = {}
    for r, a, b in pairs:
        for start in (a, b):
            if (r, start) not in reach and r.startswith("g"):
                seen, todo = set(), [start]
                while todo:
                    todo += [x for x in after.get((r, todo.pop()), ()) if x not in seen and not seen.add(x)]
                reach[r, start] = seen
    for (r, a), seen in reach.items():
        own = {b for b in seen if a in reach[r, b]} | {a}
        if len(own) > 1:
            want[r, a] = min(own)
    want |= {("ring", f"r{i:03}"): "r000" for i in range(450)} | {("beads", f"b{i:03}{x}"): f"b{i:03}p" for i in range(40) for x in "pq"}
    got = graph.strong_components(spark.createDataFrame(pairs, "repo_id string, src string, dst string").repartition(4)).collect()
    assert len(got) == len(want) and {(r.repo_id, r.node): r.component for r in got} == want
