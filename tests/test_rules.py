"""Rules carried over from the reference, and scans that miss nothing in a line."""

import re

from quarry.functions import fixed
from quarry.operators import classify, lines, security

PLANTED = {
    "sql_string_concat": ("a.py", "cursor.execute('select * from t where id = ' + x)"), "sql_fstring": ("b.py", "db.execute(f'select * from {t}')"),
    "shell_true": ("c.py", "subprocess.run(cmd, shell=True)"), "node_exec": ("d.js", "exec(`ls ${dir}`)"), "python_eval": ("e.py", "eval(user_input)"),
    "pickle_load": ("f.py", "yaml.load(stream)"), "js_eval": ("g.js", "eval(body.code)"), "react_dangerous_html": ("h.js", "dangerouslySetInnerHTML={{ __html: body }}"),
    "inner_html_assign": ("i.ts", "box.innerHTML = value;"), "cors_wildcard_credentials": ("j.py", "f(allow_origins=['*'], allow_credentials=True)"), "path_traversal": ("k.js", "readFile(req.query.name)"),
}


def test_every_rule_of_the_reference(spark):
    rows = [("r", path, text, len(text)) for path, text in PLANTED.values()] + [("r", "z.py", "yaml.load(stream, Loader=Safe)", 30)]
    files = classify.classified(spark.createDataFrame(rows, "repo_id string, path string, text string, size_bytes long"))
    got = {(r.rule_id, r.path) for r in security.scan_patterns(lines.lines_of(files), files).collect()}
    assert got >= {(rule, path) for rule, (path, _) in PLANTED.items()} and not any(path == "z.py" for _, path in got)
    assert len(fixed.INSECURE) == 20 and len(fixed.TUTORIAL_SIGNALS) == 9 and len(fixed.DEPENDENCY_CATEGORIES) == 9 and len(fixed.ARTIFACTS) == 7


def test_loader_pattern_equals_lookahead():
    import random

    rng = random.Random(1)
    ours, theirs = re.compile(r"\byaml\.load\s*\(" + fixed.NO_LOADER), re.compile(r"\byaml\.load\s*\((?![^)]*Loader\s*=)")
    for _ in range(20000):
        text = "yaml.load(" + "".join(rng.choice(["L", "o", "a", "der", "Loader", " ", "=", ")", "x"]) for _ in range(rng.randint(0, 9)))
        assert bool(ours.search(text)) == bool(theirs.search(text)), text


def test_every_secret_of_a_line_of_any_length(spark):
    first, second = "AKIA" + "ABCDEFGHIJ234567", "AKIA" + "ABZZEFGHIJ234567"
    fake = 'api_key = "your_key_example_here" '
    rows = [("r", "a.json", "x " * 2500 + first), ("r", "b.py", f"{first} {second} {first}"), ("r", "c.py", fake + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')]
    files = spark.createDataFrame(rows, "repo_id string, path string, text string")
    found = security.dedupe_findings(security.scan_secrets(lines.lines_of(files))).collect()
    assert sorted((r.path, r.rule_id) for r in found) == [("a.json", "aws_access_key_id"), ("b.py", "aws_access_key_id"), ("b.py", "aws_access_key_id"), ("c.py", "generic_secret")]


def test_each_document_is_a_file_of_its_own(spark, tmp_path):
    from quarry.plans import domain
    from quarry.plans.queries import QUERIES

    rows = [(i, f"text {i}", "en", "s", 6) for i in range(28)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    paths = {r.path for r in domain.view(spark, str(tmp_path), "code").select("path").collect()}
    assert len(paths) == 28
    parsed = {p for p in paths if p.endswith((".py", ".ts", ".js"))}  # files of other kinds have no entities
    assert len(parsed) == 16 and {r.path for r in QUERIES["g2_entities"](spark, str(tmp_path)).select("path").collect()} == parsed
