"""Findings of other tools: captured output (project, output) as diagnostics.

Outputs are parsed by Spark's JSON functions and exploded where they stand; a broken output has no findings.
Arrays are exploded in the outer form, for else Spark tests the parsed array in a filter first, beside that of the tool,
and parses the outputs of all other tools too.
No tool is run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators.schema import COLUMNS, empty, first_of_each, let

# Issue types of the dead-code tool with their messages, and those that are errors or about dependencies.
DEAD_CODE = {
    "dependencies": "Unused dependency", "devDependencies": "Unused devDependency", "unlisted": "Unlisted dependency", "unresolved": "Unresolved import", "binaries": "Unlisted binary",
    "exports": "Unused export", "types": "Unused type", "duplicates": "Duplicate export",
}
DEPENDENCY_TYPES = ("dependencies", "devDependencies", "unlisted", "unresolved", "binaries")
FIXABLE_TYPES = ("dependencies", "devDependencies", "exports", "types", "duplicates")
NOT_FORMATTED = "File is not formatted correctly"


def _out(rows: DataFrame, engine: str, path: Column, rule: Column, severity: Column | str, message: Column | str, category: Column | str, line: Column | int = 0, column: Column | int = 0, fixable: Column | bool = False, help: Column | str = "") -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {
        "filePath": path, "engine": F.lit(engine), "rule": as_column(rule), "severity": as_column(severity), "message": as_column(message), "help": as_column(help),
        "line": F.coalesce(as_column(line), F.lit(0)).cast("long"), "column": F.coalesce(as_column(column), F.lit(0)).cast("long"), "category": as_column(category), "fixable": F.coalesce(as_column(fixable), F.lit(False)),
    }
    return rows.select("project", *[v.alias(k) for k, v in values.items()]).select(COLUMNS)


def _items(rows: DataFrame, array: Column | str, *keep: str, ord: str = "_at") -> DataFrame:
    """``keep`` and x, an item of an array, for each item; its place too if ``ord`` names it."""
    out = rows.select(*keep, F.posexplode_outer(array).alias(ord, "x")).where(F.col(ord).isNotNull())
    return out.drop("_at")


def _parsed(outputs: DataFrame, schema: str, explode: str | None = None, per_line: bool = False) -> DataFrame:
    """(project, x): an item of the parsed output for each row."""
    text = F.explode(F.filter(F.split("output", "\n"), lambda x: x.startswith("{"))) if per_line else F.col("output")
    rows = outputs.select("project", text.alias("text")).select("project", F.from_json("text", schema).alias("j"))
    return _items(rows, explode, "project") if explode else rows.select("project", F.col("j").alias("x"))


def web_formatter(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs.withColumn("output", F.regexp_replace("output", r"(?m)^\s+", "")), "diagnostics array<struct<severity:string,message:string,location:struct<path:string,start:struct<line:long,column:long>>>>", "j.diagnostics", True)
    rows = rows.where("x.location.path <> ''")
    message = F.when(F.coalesce("x.message", F.lit("")).isin("") | F.contains(F.lower("x.message"), F.lit("would have printed")), NOT_FORMATTED).otherwise(F.col("x.message"))
    return _out(rows, "format", F.col("x.location.path"), F.lit("formatting"), "warning", message, "Format", F.col("x.location.start.line"), F.col("x.location.start.column"), True)


def python_formatter(outputs: DataFrame) -> DataFrame:
    rows = outputs.select("project", F.explode(F.regexp_extract_all("output", F.lit(r"(?md)^--- ([^\n]+)$"), F.lit(1))).alias("x"))
    return _out(rows, "format", F.regexp_replace("x", "^a/", ""), F.lit("python-formatting"), "warning", "Python file is not formatted correctly", "Format", fixable=True)


def go_formatter(outputs: DataFrame) -> DataFrame:
    rows = outputs.select("project", F.explode(F.split("output", "\n")).alias("x")).where("trim(x) <> ''")
    return _out(rows, "format", F.trim("x"), F.lit("go-formatting"), "warning", "Go file is not formatted correctly", "Format", fixable=True)


def rust_formatter(outputs: DataFrame) -> DataFrame:
    rows = outputs.select("project", F.explode(F.split("output", "\n")).alias("x")).where(F.col("x").rlike(r"^Diff in .+ at line \d+"))
    place = r"^Diff in (.+) at line (\d+)"
    return _out(rows, "format", F.regexp_extract("x", place, 1), F.lit("rust-formatting"), "warning", "Rust file is not formatted correctly", "Format", F.regexp_extract("x", place, 2).cast("long"), fixable=True)


_COPS = "files array<struct<path:string,name:string,offenses:array<struct<cop_name:string,message:string,severity:string,correctable:boolean,location:struct<start_line:long,start_column:long>>>>>"


def _cops(outputs: DataFrame) -> DataFrame:
    return _items(_parsed(outputs, _COPS, "j.files").select("project", F.col("x.path").alias("path"), F.col("x.offenses").alias("offenses")), "offenses", "project", "path")


def ruby_formatter(outputs: DataFrame) -> DataFrame:
    return _out(_cops(outputs), "format", F.col("path"), F.coalesce("x.cop_name", F.lit("ruby-formatting")), "warning", F.coalesce("x.message", F.lit("Ruby formatting issue")), "Format", F.col("x.location.start_line"), F.col("x.location.start_column"), F.col("x.correctable"))


def php_formatter(outputs: DataFrame) -> DataFrame:
    return _out(_parsed(outputs, _COPS, "j.files"), "format", F.col("x.name"), F.lit("php-formatting"), "warning", "PHP file is not formatted correctly", "Format", fixable=True)


def web_linter(outputs: DataFrame) -> DataFrame:
    """Rules are plugin and name; of equal findings the first counts."""
    rows = outputs.select("project", F.from_json("output", "diagnostics array<struct<message:string,code:string,severity:string,help:string,filename:string,labels:array<struct<span:struct<line:long,column:long>>>>>").alias("j"))
    rows = _items(rows, "j.diagnostics", "project", ord="ord")
    code, parts = F.coalesce("x.code", F.lit("")), r"^(.+)\((.+)\)$"
    plugin = F.when(code.rlike(parts), F.regexp_replace(F.regexp_extract(code, parts, 1), "^eslint-plugin-", "")).otherwise("eslint")
    name = F.when(code == "", "syntax-error").when(code.rlike(parts), F.regexp_extract(code, parts, 2)).otherwise(code)
    short = F.trim(F.regexp_replace("x.message", r"(?s)\S+\.\w+:\d+:\d+.*\z", ""))
    rows = rows.withColumn("plugin", plugin).withColumn("rule", F.concat_ws("/", "plugin", name)).withColumn("text", F.when(short == "", F.col("x.message")).otherwise(short))
    rows = rows.withColumn("span", F.get("x.labels", F.lit(0))["span"]).withColumn("line", F.coalesce("span.line", F.lit(0)))
    rows = first_of_each(rows.withColumn("file", F.col("x.filename")), ["project", "file", "line", "rule", "text"], ["ord"])
    category = F.when(F.col("plugin") == "react", "React").when(F.col("plugin") == "import", "Imports").otherwise("Lint")
    return _out(rows, "lint", F.col("file"), F.col("rule"), F.col("x.severity"), F.col("text"), category, F.col("line"), F.col("span.column"), help=F.coalesce("x.help", F.lit("")))


def python_linter(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs, "array<struct<code:string,message:string,filename:string,location:struct<row:long,column:long>,fix:struct<applicability:string>>>", "j")
    severity = F.when(F.col("x.code").rlike("^[EF]"), "error").otherwise("warning")
    return _out(rows, "lint", F.col("x.filename"), F.concat(F.lit("ruff/"), "x.code"), severity, F.col("x.message"), "Python Lint", F.col("x.location.row"), F.col("x.location.column"), F.col("x.fix.applicability") == "safe")


def go_linter(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs, "Issues array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:long,Column:long>>>", "j.Issues")
    return _out(rows, "lint", F.col("x.Pos.Filename"), F.concat(F.lit("go/"), "x.FromLinter"), "warning", F.col("x.Text"), "Go Lint", F.col("x.Pos.Line"), F.col("x.Pos.Column"))


def rust_linter(outputs: DataFrame) -> DataFrame:
    schema = "reason string, message struct<code:struct<code:string>,level:string,message:string,children:array<struct<message:string>>,spans:array<struct<file_name:string,line_start:long,column_start:long>>>"
    rows = _parsed(outputs, schema, per_line=True).where("x.reason = 'compiler-message' AND x.message IS NOT NULL").select("project", F.col("x.message").alias("x")).withColumn("s", F.get("x.spans", F.lit(0)))
    severity = F.when(F.col("x.level") == "error", "error").otherwise("warning")
    return _out(rows, "lint", F.coalesce("s.file_name", F.lit("")), F.concat(F.lit("clippy/"), F.coalesce("x.code.code", F.lit("unknown"))), severity, F.coalesce("x.message", F.lit("")), "Rust Lint", F.col("s.line_start"), F.col("s.column_start"), help=F.coalesce(F.get("x.children", F.lit(0))["message"], F.lit("")))


def ruby_linter(outputs: DataFrame) -> DataFrame:
    severity = F.when(F.col("x.severity").isin("error", "fatal"), "error").otherwise("warning")
    return _out(_cops(outputs), "lint", F.col("path"), F.concat(F.lit("rubocop/"), "x.cop_name"), severity, F.col("x.message"), "Ruby Lint", F.col("x.location.start_line"), F.col("x.location.start_column"), F.col("x.correctable"))


def dead_code(outputs: DataFrame) -> DataFrame:
    """Unused files, dependencies, exports and types; binaries of workflow files don't count."""
    item = "array<struct<name:string,line:long,col:long,symbol:string>>"
    schema = "files array<string>, issues array<struct<file:string," + ",".join(f"{k}:{item}" for k in DEAD_CODE) + ">>"
    rows = outputs.select("project", F.from_json("output", schema).alias("j"))
    files = _out(_items(rows, "j.files", "project"), "code-quality", F.col("x"), F.lit("knip/files"), "warning", F.concat(F.lit("Unused file: "), "x"), "Dead Code")
    issues = _items(rows, "j.issues", "project").withColumnRenamed("x", "i")
    typed = F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"i.{k}"), F.array().cast(item)), _typed(F.lit(k).alias("kind"))) for k in DEAD_CODE]))
    found = issues.select("project", F.col("i.file").alias("file"), F.explode(typed).alias("t")).select("project", "file", "t.kind", "t.x")
    found = found.where(~((F.col("kind") == "binaries") & F.contains(F.replace("file", F.lit("\\"), F.lit("/")), F.lit(".github/workflows/"))))
    names = F.create_map(*[F.lit(v) for kv in DEAD_CODE.items() for v in kv])
    message = F.concat(names[F.col("kind")], F.lit(": "), F.coalesce("x.name", "x.symbol", F.lit("unknown")))
    severity = F.when(F.col("kind").isin("unlisted", "unresolved"), "error").otherwise("warning")
    category = F.when(F.col("kind").isin(*DEPENDENCY_TYPES), "Dependencies").otherwise("Dead Code")
    return files.unionByName(_out(found, "code-quality", F.col("file"), F.concat(F.lit("knip/"), "kind"), severity, message, category, F.col("x.line"), F.col("x.col"), F.col("kind").isin(*FIXABLE_TYPES)))


def _typed(kind: Column):
    return lambda x: F.struct(kind, x.alias("x"))


def _vulnerable(rows: DataFrame, path: str, severity: Column | str, message: Column, help: Column | str = "") -> DataFrame:
    return _out(rows, "security", F.lit(path), F.lit("security/vulnerable-dependency"), severity, message, "Security", help=help)


def package_audit(outputs: DataFrame, source: str = "npm audit") -> DataFrame:
    """Both formats of the JavaScript audits, and notes of audits that did not complete."""
    schema = (
        "error struct<code:string,summary:string,detail:string>, advisories map<string,struct<module_name:string,name:string,package:string,severity:string,recommendation:string,title:string>>, "
        "vulnerabilities map<string,struct<severity:string,isDirect:boolean,fixAvailable:string>>"
    )
    item = lambda rule, severity, message, help: F.struct(F.lit(f"security/{rule}").alias("rule"), severity.alias("severity"), message.alias("message"), help.alias("help"))
    level = lambda v: F.lower(F.coalesce(v["severity"], F.lit("moderate")))
    severity = lambda v: F.when(level(v).isin("critical", "high"), "error").otherwise("warning")
    text = lambda name, v: F.concat(F.lit(f"Vulnerable dependency ({source}): "), name, F.lit(" ("), level(v), F.lit(")"))

    def note(error: Column) -> Column:
        message = F.when(error["code"] == "ENOLOCK", f"Dependency audit skipped ({source}): lockfile is missing").otherwise(f"Dependency audit did not complete ({source})")
        return item("dependency-audit-skipped", F.lit("info"), message, F.coalesce(error["detail"], error["summary"], F.lit("")))

    def old(e: Column) -> Column:
        v = e["value"]
        return item("vulnerable-dependency", severity(v), text(F.coalesce(v["module_name"], v["name"], v["package"], e["key"]), v), F.coalesce(v["recommendation"], v["title"], F.lit("")))

    def new(e: Column) -> Column:
        v = e["value"]
        fix, target = v["fixAvailable"], F.from_json(v["fixAvailable"], "name string, version string")
        advice = F.when((fix == "false") & v["isDirect"], "No automatic fix: look for a newer major version").when(fix == "false", "No automatic fix: override it or upgrade its parent").when(
            target["version"].isNotNull(), F.concat(F.lit("Upgrade to "), target["name"], F.lit("@"), target["version"], F.lit("."))
        ).otherwise("Run the audit's own fix")
        return item("vulnerable-dependency", severity(v), text(e["key"], v), advice)

    def said(x: Column) -> Column:
        listed = F.when(x["advisories"].isNotNull(), F.transform(F.map_entries(x["advisories"]), old)).otherwise(F.transform(F.map_entries(x["vulnerabilities"]), new))
        return F.when(F.coalesce(x["error"]["code"], x["error"]["summary"]).isNotNull(), F.array(note(x["error"]))).otherwise(listed)

    rows = _items(outputs, let(F.from_json("output", schema), said), "project")
    return _out(rows, "security", F.lit("package.json"), F.col("x.rule"), F.col("x.severity"), F.col("x.message"), "Security", help=F.col("x.help"))


def python_audit(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs, "dependencies array<struct<name:string,vulns:array<struct<id:string>>>>", "j.dependencies").where("size(x.vulns) > 0")
    return _vulnerable(rows, "requirements.txt", "error", F.concat(F.lit("Vulnerable Python dependency: "), "x.name"))


def go_audit(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs, "vulnerability struct<id:string,details:string>", per_line=True).where("x.vulnerability IS NOT NULL")
    return _vulnerable(rows, "go.mod", "error", F.concat(F.lit("Go vulnerability: "), F.coalesce("x.vulnerability.id", F.lit("unknown"))), F.coalesce("x.vulnerability.details", F.lit("")))


def rust_audit(outputs: DataFrame) -> DataFrame:
    rows = _parsed(outputs, "vulnerabilities struct<list:array<struct<advisory:struct<id:string,title:string>>>>", "j.vulnerabilities.list")
    return _vulnerable(rows, "Cargo.toml", "error", F.concat(F.lit("Rust vulnerability: "), F.coalesce("x.advisory.id", F.lit("unknown"))), F.coalesce("x.advisory.title", F.lit("")))


def project_doctor(outputs: DataFrame) -> DataFrame:
    """Failed checks of a sectioned report: a line ``✖ title``, and its details up to the next mark."""
    rows = outputs.select("project", F.explode(F.filter(F.split(F.concat(F.lit("\n"), "output"), r"\n(?=[✔✖])"), lambda x: F.ltrim(x).startswith("✖"))).alias("x"))
    title = F.trim(F.regexp_extract("x", r"✖\s*([^\n]*)", 1))
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    return _out(rows, "lint", F.lit("package.json"), F.concat(F.lit("expo-doctor/"), slug), "warning", title, "Expo", help=F.trim(F.regexp_extract("x", r"(?s)✖[^\n]*\n(.*)", 1)))


#: Readers of outputs by the engine that their findings belong to.
BY_ENGINE = {
    "format": [web_formatter, python_formatter, go_formatter, rust_formatter, ruby_formatter, php_formatter],
    "lint": [web_linter, python_linter, go_linter, rust_linter, ruby_linter, project_doctor],
    "code-quality": [dead_code],
    "security": [package_audit, python_audit, go_audit, rust_audit],
}
ADAPTERS = {f.__name__: f for readers in BY_ENGINE.values() for f in readers}


def findings(outputs: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Diagnostics of captured outputs (project, tool, output), where ``tool`` names a reader; others are left out."""
    readers = [f for e, fs in BY_ENGINE.items() if engines is None or e in engines for f in fs]
    return reduce(DataFrame.unionByName, (f(outputs.where(F.col("tool") == f.__name__).select("project", "output")) for f in readers)) if readers else empty(outputs.sparkSession)


def unused_declarations(outputs: DataFrame) -> DataFrame:
    """(project, path, line, column, name, kind) of declarations that the web linter or the dead-code tool calls unused, each once, the linter's first.

    ``kind`` is variable, parameter or import of the linter's, and the dead-code tool's exports and types.
    """
    found = lambda reader: reader(outputs.where(F.col("tool") == reader.__name__).select("project", "output"))
    lint = found(web_linter).where(F.col("rule").endswith("no-unused-vars"))
    named = r"(?i)^(variable|parameter|import|identifier|function|class|type|interface|enum)?[^'`]*['`]([A-Za-z_$][\w$]*)['`]"
    kind = F.lower(F.regexp_extract("message", named, 1))
    lint = lint.select("project", F.col("filePath").alias("path"), "line", "column", F.regexp_extract("message", named, 2).alias("name"), F.when(kind == "", "variable").otherwise(kind).alias("kind"), F.lit(0).alias("ord")).where("name <> ''")
    dead = found(dead_code).where(F.col("rule").isin("knip/exports", "knip/types"))
    dead = dead.select("project", F.col("filePath").alias("path"), "line", "column", F.regexp_extract("message", r": (.*)\z", 1).alias("name"), F.regexp_replace("rule", "^knip/(.*)s$", "$1").alias("kind"), F.lit(1).alias("ord"))
    return first_of_each(lint.unionByName(dead), ["project", "path", "name"], ["ord", "line", "column", "kind"]).drop("ord")
