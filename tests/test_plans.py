"""Scores, reports, configuration, sources, adapters, fixes and streams."""

import json

import pytest
from pyspark.sql import functions as F

from codesieve.operators import adapters, fixes, schema
from codesieve.plans import catalogue, config, registry, report, scan, score
from codesieve.sources import changes, corpus, discover, listing
from codesieve.streaming import hooks

SF = "/root/testdata/sf0.001"
WEIGHTS = {"format": 0.5, "lint": 1, "code-quality": 1.5, "security": 2}


def diag(spark, *rows):
    """Rows of (engine, severity, rule, file, line)."""
    full = [("p", f, e, r, s, f"m {r}", "", n, 0, "c", s == "warning") for e, s, r, f, n in rows]
    return spark.createDataFrame(full, schema.DIAGNOSTICS)


@pytest.mark.parametrize(
    "rows, value, label",
    [
        ([], 100, "Healthy"),
        ([("format", "info")], 99, "Healthy"),
        ([("lint", "warning")], 94, "Healthy"),
        ([("lint", "error")], 86, "Healthy"),
        ([("security", "error")], 78, "Healthy"),
        ([("code-quality", "error")], 81, "Healthy"),
        ([("lint", "warning")] * 3, 80, "Healthy"),
        ([("format", "info")] * 10, 83, "Healthy"),
        ([("security", "error")] * 3, 50, "Needs Work"),
    ],
)
def test_score_goldens(spark, rows, value, label):
    rows = diag(spark, *[(e, s, "r", "f.ts", 1) for e, s in rows])
    projects = spark.createDataFrame([("p", 0)], "project string, files long")
    got = score.score(rows, projects, weights=WEIGHTS).first()
    assert (got.score, got.label) == (value, label)


def test_score_bounds_and_gate(spark):
    rows = diag(spark, *[("security", "error", "r", f"f{k}.ts", k) for k in range(300)])
    got = score.gate(score.score(rows), 10).first()
    assert 0 <= got.score <= 5 and got.label == "Critical" and got.failed
    both = spark.createDataFrame([("p", 10), ("clean", 3)], "project string, files long")
    assert {r.project: r.score for r in score.score(rows, both, good=101).collect()}["clean"] == 100
    clean = score.gate(score.score(rows, both)).where("project = 'clean'").first()
    assert not clean.failed and clean.label == "Healthy"


def test_reports(spark):
    rows = diag(spark, *[("lint", "warning", "a", f"f{k}.ts", k) for k in range(25)], ("lint", "error", "b", "f1.ts", 3), ("lint", "info", "c", "z.ts", 0))
    assert report.summary(rows).first()[1:] == (1, 25, 25, 27)
    assert {r.engine: r.issues for r in report.by_engine(rows).collect()} == {e: 27 if e == "lint" else 0 for e, _ in schema.ENGINES}
    group = report.rule_groups(rows).where("rule = 'a'").first()
    assert (group.n, group.more, group["sample"]) == (25, 22, "f0.ts, f1.ts:1, f10.ts:10")
    assert report.file_ranking(rows).where("place = 1").first().filePath == "f1.ts"
    scores = score.score(rows)
    back = report.feedback(rows, scores, scores.withColumn("score", F.lit(100).cast("long"))).first()
    assert (len(back.findings), back.elided, back.total, back.regressed) == (20, 6, 26, True)
    assert back.next_steps[0] == "Fix 1 error before the next turn." and back.next_steps[2].startswith("Address 2 findings in f1.ts (lines 1, 3")
    files = spark.createDataFrame([("p", "f1.ts", ".ts", "a\nb\nc\nd\ne\nf\ng\nh")], "project string, path string, ext string, content string")
    assert report.snippets(rows, files).where("rule = 'b'").first().snippet == "1: a\n2: b\n3: c\n4: d\n5: e\n6: f"
    doc = json.loads(report.json_report(rows, scores, scan.file_counts(files)).first().report)
    assert doc["summary"] == {"errors": 1, "warnings": 25, "fixable": 25, "files": 1} and doc["engines"]["lint"]["issues"] == 27 and len(doc["diagnostics"]) == 27
    change = {r.rule: r[1:] for r in report.delta(rows, rows.where("line > 2")).collect()}
    assert change["a"] == (25, 22, 3)


def test_config(tmp_path):
    (tmp_path / "base.yml").write_text("quality: {maxFileLoc: 100, maxParams: 3}\nexclude: [a, b]\n")
    (tmp_path / ".codesieve").mkdir()
    (tmp_path / ".codesieve/config.yml").write_text("extends: ../base.yml\nquality: {maxParams: 9}\nexclude: [c]\nscoring: {weights: {lint: 2}}\n")
    (tmp_path / "deep/er").mkdir(parents=True)
    got = config.load(tmp_path / "deep/er")
    assert got["quality"] == {"maxFunctionLoc": 80, "maxFileLoc": 100, "maxNesting": 5, "maxParams": 9} and got["exclude"] == ["c"] and got["scoring"]["weights"]["lint"] == 2 and got["scoring"]["weights"]["security"] == 1.5
    (tmp_path / "a.yml").write_text("extends: ./b.yml")
    (tmp_path / "b.yml").write_text("extends: ./a.yml")
    for text in ("extends: ./a.yml", "extends: ./none.yml", "extends: https://x", "extends: pkg"):
        (tmp_path / "c.yml").write_text(text)
        with pytest.raises(ValueError):
            config.load_chain(tmp_path / "c.yml")
    for bad in ({"quality": {"maxParams": 0}}, {"scoring": {"smoothing": -1}}, {"engines": {"lint": "yes"}}, "text", None):
        assert config.parse(bad) == config.DEFAULTS


def test_file_selection(spark):
    paths = ["src/app.ts", "src/app.test.ts", "node_modules/x/a.js", "a/dist/b.ts", "distance/b.ts", "test_x.py", "x_test.go", "README.md", "src/gen.ts", "src/ignored.ts", "docs/a.py", "a/b.tsx"]
    files = spark.createDataFrame([("p", p, "." + p.rsplit(".", 1)[-1], "// DO NOT EDIT" if "gen" in p else "x") for p in paths], "project string, path string, ext string, content string")
    ignored = spark.createDataFrame([("p", "src/ignored.ts")], "project string, path string")
    kept = corpus.without_generated(corpus.filter_files(files, ignored, ["docs", ".tsx"]))
    assert sorted(r.path for r in kept.collect()) == ["distance/b.ts", "src/app.ts"]
    wanted = spark.createDataFrame([("p", "test_x.py"), ("p", "README.md"), ("p", "none.ts")], "project string, path string")
    assert [r.path for r in corpus.explicit_files(files, wanted).collect()] == ["test_x.py"]
    assert corpus.explicit_files(files, wanted.where("false")).count() == 0


@pytest.mark.parametrize("glob, path, hit", [("src/**", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/*.ts", "b.ts", True), ("a?[bc].ts", "axb.ts", True), ("a.ts", "axts", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(corpus.glob_regex(glob), path)) is hit


def test_read_project_and_discover(spark, tmp_path):
    for name, text in {"package.json": '{"dependencies": {"react": "1", "next": "2"}}', "requirements.txt": "Flask==1\n", "src/a.ts": "x\n", "go.mod": "module x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = corpus.read_project(spark, str(tmp_path))
    assert {(r.path, r.ext, r.content) for r in files.where("ext = '.ts'").collect()} == {("src/a.ts", ".ts", "x\n")}
    got = discover.discover(files).first()
    assert got.languages == ["go", "javascript", "python"] and got.frameworks == ["flask", "nextjs", "react"]
    assert discover.discover(files.where("ext = '.ts'")).first()[1:] == ([], ["none"])


def test_listing_and_quarantine(spark, tmp_path):
    for name, data in {"src/a.ts": b"x\n", "src/_b.ts": b"hidden", "src/deep/er/empty.ts": b"", "latin.ts": b"caf\xe9", "torn.ts": b"hello" * 9, ".git/x.ts": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".torn.ts.crc").write_bytes(b"crc\0\0\0\2\0" + b"\1\2\3\4")  # its checksum is wrong
    listed = listing.listed_files(spark, str(tmp_path) + "/")
    assert {(r.path, r.ext, r.length, r.reason) for r in listed.collect()} == {("src/a.ts", ".ts", 2, None), ("src/_b.ts", ".ts", 6, None), ("src/deep/er/empty.ts", ".ts", 0, None), ("latin.ts", ".ts", 4, None), ("torn.ts", ".ts", 45, None)}
    files = corpus.read_project(spark, str(tmp_path)).unionByName(listing.left_out(listed, str(tmp_path)))
    assert {(r.path, r.content) for r in files.where("path LIKE 'src/%'").collect()} == {("src/a.ts", "x\n"), ("src/_b.ts", "hidden"), ("src/deep/er/empty.ts", "")}
    assert {(r.path, r.reason) for r in listing.quarantine(listed, files).collect()} == {("src/deep/er/empty.ts", "empty"), ("latin.ts", "not UTF-8"), ("torn.ts", "unreadable")}
    gone = listing.listed_files(spark, f"{tmp_path}/none").first()
    assert (gone.path, gone.reason) == ("", "folder not listed: FileNotFoundError")


def test_report_order(spark):
    rows = diag(
        spark,
        ("security", "error", "security/eval", "a.ts", 1), ("security", "error", "security/hardcoded-secret", "b.ts", 9), ("ai-slop", "warning", "ai-slop/narrative-comment", "a.ts", 1), ("ai-slop", "warning", "ai-slop/console-leftover", "z.ts", 5),
        ("code-quality", "warning", "complexity/too-many-params", "z.ts", 7), ("lint", "warning", "ruff/E501", "b.py", 2), ("lint", "warning", "eslint/no-var", "z.ts", 2), ("format", "warning", "formatting", "z.ts", 1), ("ai-slop", "info", "ai-slop/todo-stub", "a.ts", 1),
    )
    got = report.findings(rows, 7).orderBy("place").collect()
    assert [r.rule for r in got] == ["formatting", "eslint/no-var", "ruff/E501", "complexity/too-many-params", "ai-slop/console-leftover", "ai-slop/narrative-comment", "security/hardcoded-secret"]
    shown = catalogue.prompt_rows(rows).where("filePath = 'a.ts'").orderBy("place").collect()
    assert [r.rule for r in shown] == ["ai-slop/todo-stub", "ai-slop/narrative-comment", "security/eval"]


OUTPUTS = {
    "web_formatter": ('{"diagnostics": [{"location": {"path": "a.ts", "start": {"line": 3, "column": 2}}, "message": "Formatter would have printed x"}, {"message": "no path"}]}\nnoise', [("a.ts", "formatting", 3)]),
    "python_formatter": ("--- a/x.py\n+++ b/x.py\n--- y.py\n", [("x.py", "python-formatting", 0), ("y.py", "python-formatting", 0)]),
    "go_formatter": ("a.go\n\nb.go\n", [("a.go", "go-formatting", 0), ("b.go", "go-formatting", 0)]),
    "rust_formatter": ("Diff in src/a.rs at line 7:\nx\n", [("src/a.rs", "rust-formatting", 7)]),
    "ruby_formatter": ('{"files": [{"path": "a.rb", "offenses": [{"cop_name": "Layout/X", "message": "m", "correctable": true, "location": {"start_line": 4}}]}]}', [("a.rb", "Layout/X", 4)]),
    "php_formatter": ('{"files": [{"name": "a.php"}]}', [("a.php", "php-formatting", 0)]),
    "web_linter": (
        json.dumps({"diagnostics": [{"message": "bad x.ts:1:2 more", "code": "eslint-plugin-react(no-x)", "severity": "error", "filename": "a.tsx", "labels": [{"span": {"line": 5, "column": 1}}]}] * 2 + [{"message": "m", "code": None, "severity": "warning", "filename": "b.ts", "labels": []}]}),
        [("a.tsx", "react/no-x", 5), ("b.ts", "eslint/syntax-error", 0)],
    ),
    "python_linter": ('[{"code": "E501", "message": "m", "filename": "a.py", "location": {"row": 2, "column": 1}, "fix": {"applicability": "safe"}}]', [("a.py", "ruff/E501", 2)]),
    "go_linter": ('{"Issues": [{"FromLinter": "vet", "Text": "t", "Pos": {"Filename": "a.go", "Line": 9, "Column": 1}}]}', [("a.go", "go/vet", 9)]),
    "rust_linter": ('{"reason": "compiler-message", "message": {"level": "error", "message": "m", "code": {"code": "x"}, "spans": [{"file_name": "a.rs", "line_start": 3}]}}\n{"reason": "other"}', [("a.rs", "clippy/x", 3)]),
    "ruby_linter": ('{"files": [{"path": "a.rb", "offenses": [{"cop_name": "Lint/X", "severity": "fatal", "message": "m", "location": {"start_line": 4}}]}]}', [("a.rb", "rubocop/Lint/X", 4)]),
    "dead_code": ('{"files": ["u.ts"], "issues": [{"file": "package.json", "dependencies": [{"name": "left-pad"}], "binaries": [{"name": "gh"}]}, {"file": ".github/workflows/x.yml", "binaries": [{"name": "gh"}]}]}', [("package.json", "knip/binaries", 0), ("package.json", "knip/dependencies", 0), ("u.ts", "knip/files", 0)]),
    "package_audit": ('{"vulnerabilities": {"a": {"severity": "high", "isDirect": true, "fixAvailable": {"name": "a", "version": "2"}}, "b": {"severity": "low", "fixAvailable": false}}}', [("package.json", "security/vulnerable-dependency", 0)] * 2),
    "python_audit": ('{"dependencies": [{"name": "a", "vulns": [{"id": "x"}]}, {"name": "b", "vulns": []}]}', [("requirements.txt", "security/vulnerable-dependency", 0)]),
    "go_audit": ('{"vulnerability": {"id": "GO-1", "details": "d"}}\n{"other": 1}', [("go.mod", "security/vulnerable-dependency", 0)]),
    "rust_audit": ('{"vulnerabilities": {"list": [{"advisory": {"id": "R", "title": "t"}}]}}', [("Cargo.toml", "security/vulnerable-dependency", 0)]),
    "project_doctor": ("✔ Fine\n✖ Check Expo config\n details\n advice\n✔ Other\n", [("package.json", "expo-doctor/check-expo-config", 0)]),
}


@pytest.mark.parametrize("name", sorted(adapters.ADAPTERS))
def test_adapters(spark, name):
    text, expected = OUTPUTS[name]
    outputs = spark.createDataFrame([("p", text), ("p", "{broken"), ("p", None)], "project string, output string")
    outputs = outputs.where("output = '" + text.replace("'", "''").replace("\\", "\\\\") + "'") if name in ("go_formatter",) else outputs
    rows = adapters.ADAPTERS[name](outputs)
    assert rows.columns == schema.COLUMNS and sorted((r.filePath, r.rule, r.line) for r in rows.collect()) == sorted(expected)


def test_audit_notes(spark):
    rows = adapters.package_audit(spark.createDataFrame([("p", '{"error": {"code": "ENOLOCK"}}'), ("q", '{"advisories": {"1": {"module_name": "m", "severity": "critical"}}}')], "project string, output string")).collect()
    assert sorted((r.rule, r.severity, r.message) for r in rows) == [
        ("security/dependency-audit-skipped", "info", "Dependency audit skipped (npm audit): lockfile is missing"), ("security/vulnerable-dependency", "error", "Vulnerable dependency (npm audit): m (critical)"),
    ]


def fixed(spark, step, text, path="a.ts"):
    files = spark.createDataFrame([("p", path, "." + path.rsplit(".", 1)[-1], text)], "project string, path string, ext string, content string")
    return step(files).first().content


def test_fix_leftovers(spark):
    text = "a();\n\n// Get the user\n\nconsole.log(\n  x,\n);\nconsole.log('failed', x);\nb();"
    assert fixed(spark, fixes.fix_leftovers, text.replace("user\n\n", "user\nu();\n\n")) == "a();\n\nu();\n\nconsole.error('failed', x);\nb();"


def test_fix_narrative(spark):
    assert fixed(spark, fixes.fix_narrative, "a();\n\n// ----------\n\nb();") == "a();\n\nb();"


@pytest.mark.parametrize(
    "path, text, out",
    [
        ("a.ts", 'import a, { b, c } from "x";\nb();', 'import { b } from "x";\nb();'),
        ("a.ts", 'import a, { b } from "x";\na();', 'import a from "x";\na();'),
        ("a.ts", 'import {\n  a,\n  b,\n  c,\n  d,\n} from "x";\na(b, c);', 'import {\n  a,\n  b,\n  c,\n} from "x";\na(b, c);'),
        ("a.ts", 'import { a } from "x";\n\nb();', "b();"),
        ("a.py", "from m import (x, y)\nimport os\nprint(x)", "from m import (x)\nprint(x)"),
        ("a.py", "import os\nprint(os)", "import os\nprint(os)"),
    ],
)
def test_fix_imports(spark, path, text, out):
    assert fixed(spark, fixes.fix_imports, text, path) == out


def test_other_fixes(spark):
    assert fixes.remove_duplicate_keys("a: 1,\nb: 2,\n'a': 3,", ["a"]) == "a: 1,\nb: 2,"
    manifests = spark.createDataFrame([("p", '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "3"}}')], "project string, content string")
    unused = diag(spark, ("code-quality", "warning", "knip/dependencies", "package.json", 0)).withColumn("message", F.lit("Unused dependency: a"))
    row = fixes.without_unused_dependencies(manifests, unused).first()
    assert (row.dependencies, row.devDependencies) == ({"b": "2"}, {"c": "3"})


def events(spark):
    shapes = [{"file_path": "a.ts", "edits": [{"file_path": "b.ts"}, {}]}, {"tool_input": {"file_path": "a.ts", "edits": [{"file_path": "c.ts"}, {"file_path": "a.ts"}]}}, {"tool_input": {"path": "d.ts", "file_path": ""}}]
    rows = [("p", f"2026-01-01 00:0{k}:00", json.dumps(x)) for k, x in enumerate(shapes)] + [("p", "2026-01-01 00:05:00", "{broken"), ("p", "2026-01-01 00:06:00", None)]
    return spark.createDataFrame(rows, "session string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_events_decode(spark):
    assert [r.files for r in hooks.decode_events(events(spark)).orderBy("ts").collect()] == [["a.ts", "b.ts"], ["a.ts", "c.ts"], ["d.ts"], [], []]


def test_streams(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = hooks.decode_events(spark.readStream.schema("session string, ts timestamp, payload string").parquet(str(tmp_path / "in")))
    query = hooks.session_files(stream).writeStream.format("memory").queryName("sessions").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.path for r in spark.table("sessions").collect()) == ["a.ts", "b.ts", "c.ts", "d.ts"]
    files = spark.createDataFrame([("p", "a.ts", ".ts", "console.log(1);\neval(x);"), ("p", "zzz.ts", ".ts", "console.log(1);")], "project string, path string, ext string, content string")
    baseline = spark.createDataFrame([("p", 100)], "project string, score long")
    query = hooks.run_hook(stream, files, baseline, str(tmp_path / "out"), str(tmp_path / "state"), "session")
    query.awaitTermination(180)
    back = spark.read.parquet(str(tmp_path / "out")).first()
    assert (back.total, back.error, back.regressed, len(back.findings)) == (1, 0, True, 1)
    held = hooks.stop_gate(spark.read.parquet(str(tmp_path / "out"))).first()
    assert held.reason.startswith("Score dropped from 100 to ") and "Fix the 1 finding before" in held.reason
    assert hooks.stop_gate(spark.read.parquet(str(tmp_path / "out")), baseline).count() == 0


def test_windows_stream_like_tables(spark):
    rows = hooks.edits_per_window(hooks.decode_events(events(spark))).collect()
    assert [(r.edits, r.files) for r in rows] == [(5, 5)]


def test_baseline(spark):
    files = spark.createDataFrame([("p", "a.ts", ".ts", "eval(x);"), ("q", "a.ts", ".ts", "x();")], "project string, path string, ext string, content string")
    got = {(r.project, r.engine): r.score for r in hooks.capture_baseline(files).collect()}
    assert got[("q", "all")] == 100 and got[("p", "security")] < 100


def normal(rows):
    return sorted(repr([None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "events", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    expected = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.SQL[name]})").fetchall()
    assert normal(tuple(r) for r in frame.select(columns).collect()) == normal(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_catalogue_and_status(spark):
    rules = {r.rule: r for r in catalogue.rule_catalogue(spark, [{"name": "x", "severity": "error"}, {}]).collect()}
    assert rules["arch/x"].severity == "error" and rules["ai-slop/console-leftover"].fixable and len(rules) > 30
    rows = diag(spark, ("lint", "error", "a", "f.ts", 1), ("lint", "warning", "b", "f.ts", 2))
    status = {r.engine: r.status for r in catalogue.engine_status(rows, [("format", "no tool")]).collect()}
    assert status["lint"] == "2 issues, 1 error, 1 warning" and status["format"] == "skipped: no tool" and status["security"] == "no issues"
    files = spark.createDataFrame([("p", "f.ts", ".ts", "one\ntwo")], "project string, path string, ext string, content string")
    assert catalogue.prompts(rows, files).first().prompt == "## f.ts\n- error a at line 1: m a\n1: one\n2: two\n- warning b at line 2: m b\n1: one\n2: two"


def test_repositories_and_changes(spark):
    urls = ["git@host.example:own/repo.git", "https://host.example/own/repo", "ssh://git@host.example/own/repo.git/", "https://host.example/a/b/c", None]
    rows = catalogue.repository_of(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string")).orderBy("k").collect()
    assert [r.repository for r in rows] == ["own/repo"] * 3 + [None, None]
    diff = spark.createDataFrame([("p", "M\ta.ts\nD\tb.ts\nR100\tc.ts\td.ts\n")], "project string, output string")
    loose = spark.createDataFrame([("p", "a.ts\ne.ts\n")], "project string, output string")
    assert sorted(r.path for r in changes.changed_files(changes.with_status(diff), changes.listed(loose)).collect()) == ["a.ts", "d.ts", "e.ts"]
    advice = [("a", ">=7.0.0-alpha.0 <8.18.0", ">=8.18.0"), ("b", "<4.17.21", " >4.17.21"), ("c", None, ">=2.0.0"), ("c", "*", ">=2.0.0"), ("d", "", "unknown"), ("e", "<1", None), (None, "<1", ">=1.0.0"), ("f", "<1", ">=1.2")]
    advice += [("m", "<2", f">={x}") for x in ("1.9.0", "1.10.0-rc.2", "1.10.0-rc.11", "1.10.0-rc.x", "1.10.0-alpha", "1.2.99")] + [("n", "<2", f">={x}") for x in ("1.0.0-rc.1", "1.0.0", "1.0.0-rc.1.1")]
    rows = changes.needed_overrides(spark.createDataFrame([("p", *a) for a in advice], "project string, module string, vulnerable string, patched string")).collect()
    assert {r.key: r.version for r in rows} == {"a@>=7.0.0-alpha.0 <8.18.0": "^8.18.0", "b@<4.17.21": "^4.17.21", "c@<2.0.0": "^2.0.0", "m@<2": "^1.10.0-rc.x", "n@<2": "^1.0.0"}
