"""Captured outputs of other tools for the queries: one of each tool for every document, and what they say as SQL.

``{n}`` stands for the document's number in outputs and findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.operators import unused
from codesieve.sources.corpus import JS

#: By tool: its output, and the findings (engine, path, rule, severity, message, help, line, column, category, fixable) in it.
TOOLS: dict[str, tuple[str, list[tuple]]] = {
    "web_formatter": (
        '{"diagnostics": [{"location": {"path": "f{n}.ts", "start": {"line": {n}, "column": 2}}, "message": "Formatter would have printed x"}, {"message": "no path"}, {"location": {"path": "g{n}.ts"}, "message": "Other"}]}',
        [("format", "f{n}.ts", "formatting", "warning", "File is not formatted correctly", "", "{n}", "2", "Format", True), ("format", "g{n}.ts", "formatting", "warning", "Other", "", "0", "0", "Format", True)],
    ),
    "python_formatter": ("--- a/f{n}.py\n+++ b/f{n}.py\n", [("format", "f{n}.py", "python-formatting", "warning", "Python file is not formatted correctly", "", "0", "0", "Format", True)]),
    "go_formatter": ("f{n}.go\n\n", [("format", "f{n}.go", "go-formatting", "warning", "Go file is not formatted correctly", "", "0", "0", "Format", True)]),
    "rust_formatter": ("Diff in src/f{n}.rs at line {n}:\nx\n", [("format", "src/f{n}.rs", "rust-formatting", "warning", "Rust file is not formatted correctly", "", "{n}", "0", "Format", True)]),
    "ruby_formatter": (
        '{"files": [{"path": "f{n}.rb", "offenses": [{"cop_name": "Layout/X", "message": "m{n}", "correctable": true, "location": {"start_line": {n}, "start_column": 3}}]}]}',
        [("format", "f{n}.rb", "Layout/X", "warning", "m{n}", "", "{n}", "3", "Format", True)],
    ),
    "php_formatter": ('{"files": [{"name": "f{n}.php"}]}', [("format", "f{n}.php", "php-formatting", "warning", "PHP file is not formatted correctly", "", "0", "0", "Format", True)]),
    "web_linter": (
        '{"diagnostics": ['
        + ", ".join(['{"message": "bad f{n}.ts:1:2 more", "code": "eslint-plugin-react(no-x)", "severity": "error", "help": "h{n}", "filename": "f{n}.tsx", "labels": [{"span": {"line": {n}, "column": 1}}]}'] * 2)
        + ', {"message": "Variable \'v{n}\' is declared but never used", "code": "eslint(no-unused-vars)", "severity": "warning", "filename": "g{n}.ts", "labels": [{"span": {"line": 5, "column": 7}}]}, {"message": "m", "severity": "warning", "filename": "h{n}.ts", "labels": []}]}',
        [
            ("lint", "f{n}.tsx", "react/no-x", "error", "bad", "h{n}", "{n}", "1", "React", False),
            ("lint", "g{n}.ts", "eslint/no-unused-vars", "warning", "Variable 'v{n}' is declared but never used", "", "5", "7", "Lint", False),
            ("lint", "h{n}.ts", "eslint/syntax-error", "warning", "m", "", "0", "0", "Lint", False),
        ],
    ),
    "python_linter": (
        '[{"code": "E501", "message": "m{n}", "filename": "f{n}.py", "location": {"row": {n}, "column": 1}, "fix": {"applicability": "safe"}}, {"code": "W1", "message": "w", "filename": "f{n}.py", "location": {"row": 2, "column": 3}}]',
        [("lint", "f{n}.py", "ruff/E501", "error", "m{n}", "", "{n}", "1", "Python Lint", True), ("lint", "f{n}.py", "ruff/W1", "warning", "w", "", "2", "3", "Python Lint", False)],
    ),
    "go_linter": ('{"Issues": [{"FromLinter": "vet", "Text": "t{n}", "Pos": {"Filename": "f{n}.go", "Line": {n}, "Column": 1}}]}', [("lint", "f{n}.go", "go/vet", "warning", "t{n}", "", "{n}", "1", "Go Lint", False)]),
    "rust_linter": (
        '{"reason": "compiler-message", "message": {"level": "error", "message": "m{n}", "code": {"code": "x"}, "children": [{"message": "h"}], "spans": [{"file_name": "f{n}.rs", "line_start": {n}, "column_start": 4}]}}\n{"reason": "other"}',
        [("lint", "f{n}.rs", "clippy/x", "error", "m{n}", "h", "{n}", "4", "Rust Lint", False)],
    ),
    "ruby_linter": (
        '{"files": [{"path": "f{n}.rb", "offenses": [{"cop_name": "Lint/X", "severity": "fatal", "message": "m{n}", "correctable": false, "location": {"start_line": {n}, "start_column": 2}}]}]}',
        [("lint", "f{n}.rb", "rubocop/Lint/X", "error", "m{n}", "", "{n}", "2", "Ruby Lint", False)],
    ),
    "project_doctor": ("✔ Fine\n✖ Check config {n}\n details\n advice\n✔ Other\n", [("lint", "package.json", "expo-doctor/check-config-{n}", "warning", "Check config {n}", "details\n advice", "0", "0", "Expo", False)]),
    "dead_code": (
        '{"files": ["u{n}.ts"], "issues": [{"file": "g{n}.ts", "exports": [{"name": "v{n}", "line": 5, "col": 7}, {"name": "w{n}", "line": {n}, "col": 1}]}, {"file": "package.json", "dependencies": [{"name": "d{n}"}], "unlisted": [{"name": "e{n}"}]}, {"file": ".github/workflows/x.yml", "binaries": [{"name": "gh"}]}]}',
        [
            ("code-quality", "u{n}.ts", "knip/files", "warning", "Unused file: u{n}.ts", "", "0", "0", "Dead Code", False),
            ("code-quality", "g{n}.ts", "knip/exports", "warning", "Unused export: v{n}", "", "5", "7", "Dead Code", True),
            ("code-quality", "g{n}.ts", "knip/exports", "warning", "Unused export: w{n}", "", "{n}", "1", "Dead Code", True),
            ("code-quality", "package.json", "knip/dependencies", "warning", "Unused dependency: d{n}", "", "0", "0", "Dependencies", True),
            ("code-quality", "package.json", "knip/unlisted", "error", "Unlisted dependency: e{n}", "", "0", "0", "Dependencies", False),
        ],
    ),
    "package_audit": (
        '{"advisories": {"{n}": {"module_name": "m{n}", "severity": "critical", "recommendation": "Upgrade"}}}',
        [("security", "package.json", "security/vulnerable-dependency", "error", "Vulnerable dependency (npm audit): m{n} (critical)", "Upgrade", "0", "0", "Security", False)],
    ),
    "python_audit": ('{"dependencies": [{"name": "a{n}", "vulns": [{"id": "x"}]}, {"name": "b", "vulns": []}]}', [("security", "requirements.txt", "security/vulnerable-dependency", "error", "Vulnerable Python dependency: a{n}", "", "0", "0", "Security", False)]),
    "go_audit": ('{"vulnerability": {"id": "GO-{n}", "details": "d"}}\n{"other": 1}', [("security", "go.mod", "security/vulnerable-dependency", "error", "Go vulnerability: GO-{n}", "d", "0", "0", "Security", False)]),
    "rust_audit": ('{"vulnerabilities": {"list": [{"advisory": {"id": "R{n}", "title": "t"}}]}}', [("security", "Cargo.toml", "security/vulnerable-dependency", "error", "Rust vulnerability: R{n}", "t", "0", "0", "Security", False)]),
}


def outputs(docs: DataFrame) -> DataFrame:
    """(project, tool, output) of every tool for every document."""
    made = F.array(*[F.struct(F.lit(tool).alias("tool"), F.lit(text).alias("text")) for tool, (text, _) in TOOLS.items()])
    rows = docs.where("doc_id IS NOT NULL").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("n"), F.explode(made).alias("x"))
    return rows.select("project", "x.tool", F.replace("x.text", F.lit("{n}"), F.col("n")).alias("output"))


def _value(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', '{n}', CAST(doc_id AS VARCHAR))"


FINDINGS_SQL = " UNION ALL ".join(
    f"SELECT source AS project, {_value(path)} AS \"filePath\", '{engine}' AS engine, {_value(rule)} AS rule, '{severity}' AS severity, {_value(message)} AS message, {_value(help)} AS help, CAST({_value(line)} AS BIGINT) AS line, CAST({column} AS BIGINT) AS \"column\", '{category}' AS category, {str(fixable).lower()} AS fixable FROM documents WHERE doc_id IS NOT NULL"
    for _, rows in TOOLS.values()
    for engine, path, rule, severity, message, help, line, column, category, fixable in rows
)
UNUSED_SQL = " UNION ALL ".join(
    f"SELECT source AS project, {_value('g{n}.ts')} AS path, CAST({_value(line)} AS BIGINT) AS line, CAST({column} AS BIGINT) AS \"column\", {_value(name)} AS name, '{kind}' AS kind FROM documents WHERE doc_id IS NOT NULL"
    for line, column, name, kind in (("5", "7", "v{n}", "variable"), ("{n}", "1", "w{n}", "export"))
)

#: Declarations in the lines of the corpus that are called unused: the name of a line that declares one, and why it stays, in SQL.
DECLARED = r"^\s*(?:export )?(?:const|function) ([A-Za-z_]\w*)"
STAYS = f"CASE WHEN regexp_matches(line, '^ ') THEN '{unused.NOT_FOUND}' WHEN contains(line, ', two') THEN '{unused.SEVERAL}' WHEN contains(line, '= build(') THEN '{unused.EFFECTS}' ELSE '' END"
#: Bindings that are called unused: the place of the name in a line, the same in SQL as what stands before and after it, how it is written when renamed, or why it is not.
BOUND = [
    (r"(?<=catch \()e(?=\))", r"catch \(", "e", r"\)", "_{}", ""),
    (r"(?<=, e, f, )g(?=\) \{)", ", e, f, ", "g", r"\) \{", "_{}", ""),
    (r"(?<=function \w{1,200}\()[ax](?=\) \{)", r"function \w+\(", "[ax]", r"\) \{", "_{}", ""),
    (r"(?<=\{ key: )alias\d+", r"\{ key: ", r"alias\d+", "", "_{}", ""),
    (r"(?<=, )short\d+(?=, \.\.\.rest)", ", ", r"short\d+", r", \.\.\.", "{}: _{}", ""),
    (r"(?<=\.\.\.)rest\d+", r"\.\.\.", r"rest\d+", "", "_{}", ""),
    (r"(?<=const \[)first\d+", r"const \[", r"first\d+", "", "_{}", ""),
    (r"(?<=, )second\d+(?=\])", ", ", r"second\d+", r"\]", "_{}", ""),
    (r"(?<=\(left, )right(?=\))", r"\(left, ", "right", r"\)", "_{}", ""),
    (r"(?<=const )data\d+(?= = 1;)", "const ", r"data\d+", " = 1;", "{}", unused.PLAIN),
    (r"(?<=^eval\()[A-Za-z]+(?=\))", r"^eval\(", "[A-Za-z]+", r"\)", "{}", unused.OTHER),
]

#: By binding: what stands in every line that has one, so that its pattern is tried there only.
_NEEDED = ["catch (e)", ", e, f, g) {", "function ", "{ key: alias", ", short", "...rest", "const [first", ", second", "(left, right)", "const data", "eval("]


def _script_lines(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(JS)).select("project", "path", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw")).withColumn("line", (F.col("at") + 1).cast("long"))


def unused_in(files: DataFrame) -> DataFrame:
    """(project, path, line, column, name, kind) of every declaration of the corpus, as if nothing used it."""
    name = F.regexp_extract("raw", DECLARED, 1)
    return _script_lines(files).select("project", "path", "line", F.regexp_instr("raw", F.lit(DECLARED)).cast("long").alias("column"), name.alias("name"), F.lit("variable").alias("kind")).where("name <> ''")


def bound_in(files: DataFrame) -> DataFrame:
    """(project, path, line, column, name, kind) of bindings of the corpus, as if nothing used them."""
    place = lambda p: F.struct(F.regexp_instr("raw", F.lit(p)).cast("long").alias("column"), F.regexp_extract("raw", p, 0).alias("name"))
    found = F.array(*[F.when(F.contains("raw", F.lit(word)), place(p)) for word, (p, *_) in zip(_NEEDED, BOUND, strict=True)])
    return _script_lines(files).select("project", "path", "line", F.explode(found).alias("x")).where("x.column > 0").select("project", "path", "line", "x.column", "x.name", F.lit("parameter").alias("kind"))


_quote = lambda x: "'" + x.replace("'", "''") + "'"
_SCRIPTS = f"lines AS (SELECT project, path, content, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files WHERE ext IN ({', '.join(map(_quote, JS))}))"
_DECLARED = f"declared AS (SELECT *, {STAYS} AS reason, regexp_extract(line, {_quote(DECLARED)}, 1) AS name FROM lines WHERE regexp_matches(line, {_quote(DECLARED)}))"
DECLARATIONS_SQL = f"{_SCRIPTS},\n{_DECLARED}\nSELECT project, path, i AS line, name, reason FROM declared"
_renamed = "line"
for _, _before, _name, _after, _new, _why in BOUND:
    _renamed = f"regexp_replace({_renamed}, {_quote(f'({_before})({_name})({_after})')}, {_quote(chr(92) + '1' + _new.replace('{}', chr(92) + '2') + chr(92) + '3')})"
RENAMED_SQL = f"{_SCRIPTS}\nSELECT project, path, sha256(string_agg({_renamed}, chr(10) ORDER BY i)) AS sha256 FROM lines GROUP BY 1, 2"
BINDINGS_SQL = f"{_SCRIPTS}\n" + " UNION ALL ".join(f"SELECT project, path, i AS line, regexp_extract(line, {_quote(f'(?:{b})({n})(?:{a})')}, 1) AS name, {_quote(w)} AS reason FROM lines WHERE regexp_matches(line, {_quote(f'(?:{b})({n})(?:{a})')})" for _, b, n, a, _, w in BOUND)
#: Lines that go: each declaration's up to its brace, and the comments right above it.
REMOVED_SQL = f"""{_SCRIPTS},
{_DECLARED},
spans AS (SELECT d.project, d.path, d.i AS a, CASE WHEN regexp_matches(d.line, '^function') AND NOT regexp_matches(d.line, '\\}}$') THEN (SELECT min(x.i) FROM lines x WHERE x.project = d.project AND x.path = d.path AND x.i > d.i AND x.line = '}}') ELSE d.i END AS b FROM declared d WHERE reason = ''),
starts AS (SELECT s.*, coalesce((SELECT max(x.i) FROM lines x WHERE x.project = s.project AND x.path = s.path AND x.i < s.a AND NOT regexp_matches(x.line, '^(//|/\\*| \\* | \\*/)')), 0) + 1 AS first FROM spans s),
kept AS (SELECT l.*, max(i) OVER (PARTITION BY project, path) AS n, EXISTS (SELECT 1 FROM starts s WHERE s.project = l.project AND s.path = l.path AND l.i BETWEEN s.first AND s.b) AS gone FROM lines l),
texts AS (SELECT project, path, coalesce(string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (NOT gone), '') AS t, bool_or(gone) AS cut FROM kept GROUP BY 1, 2)
SELECT project, path, sha256(CASE WHEN cut AND trim(t, chr(10) || ' ') = '' THEN chr(10) ELSE t END) AS sha256 FROM texts"""

#: What stands at a project's root, by its number modulo 5, and what the plan of tools makes of it where ruff and cargo are at hand.
ROOTS = [("package.json", '{"dependencies": {"expo": "1"}}'), ("go.mod", "module x"), ("Cargo.toml", "[package]"), ("requirements.txt", "Flask==1"), ("README.md", "text")]
DISCOVERED = [("javascript", "expo"), ("go", "none"), ("rust", "none"), ("python", "flask"), ("", "none")]
PLANS = {
    "format": [("biome (bundled)", "ok"), ("gofmt not found", "missing"), ("cargo fmt (system)", "ok"), ("ruff (system)", "ok"), ("no formatter", "skipped", "no supported language")],
    "lint": [("expo-doctor + oxlint (bundled)", "ok"), ("golangci-lint not found", "missing"), ("clippy not found", "missing"), ("ruff (system)", "ok"), ("no linter", "skipped", "no supported language")],
    "code-quality": [("knip (bundled)", "ok"), *[("built-in", "ok")] * 4],
    "ai-slop": [("built-in", "ok")] * 5,
    "security": [("no auditor", "skipped", "no lockfile"), ("govulncheck not found", "missing"), ("cargo audit not found", "missing"), ("pip-audit not found", "missing"), ("no auditor", "skipped", "no lockfile")],
}


def roots(docs: DataFrame) -> DataFrame:
    """(project, path, content) of each source's root."""
    table = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in ROOTS])
    rows = docs.where("source IS NOT NULL").select(F.col("source").alias("project")).distinct()
    return rows.select("project", F.get(table, F.pmod(F.regexp_extract("project", r"(\d+)", 1).try_cast("int"), F.lit(len(ROOTS)))).alias("x")).where("x IS NOT NULL").select("project", "x.*")


_projects = f"SELECT DISTINCT source AS project, TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % {len(ROOTS)} AS k FROM documents WHERE source IS NOT NULL"
DISCOVERED_SQL = f"SELECT project, languages, frameworks FROM ({_projects}) JOIN (VALUES {', '.join(f'({k}, {a!r}, {b!r})' for k, (a, b) in enumerate(DISCOVERED))}) d(k, languages, frameworks) USING (k)"
PLAN_SQL = f"SELECT project, engine, tool, status, reason FROM ({_projects}) JOIN (VALUES " + ", ".join(
    f"({k}, '{engine}', '{x[0]}', '{x[1]}', {repr(x[2]) if len(x) > 2 else 'NULL'})" for engine, xs in PLANS.items() for k, x in enumerate(xs)
) + ") p(k, engine, tool, status, reason) USING (k)"
