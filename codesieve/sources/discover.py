"""What a project is made of: languages and frameworks from its manifests, as joins with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files that tell a language, packages and files that tell a framework.
LANGUAGE_FILES = {
    "tsconfig.json": "typescript", "go.mod": "go", "Cargo.toml": "rust", "Gemfile": "ruby", "composer.json": "php", "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python",
    "setup.cfg": "python", "Pipfile": "python", "poetry.lock": "python", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
}
PACKAGES = {"next": "nextjs", "react": "react", "vite": "vite", "@remix-run/react": "remix", "expo": "expo", "astro": "astro"}
FRAMEWORK_FILES = {f"{a}.config.{b}": c for a, c in (("next", "nextjs"), ("astro", "astro")) for b in ("js", "mjs", "ts", "cjs")}
PYTHON_PACKAGES = {"django": "django", "flask": "flask", "fastapi": "fastapi"}


def _table(spark, values: dict[str, str], key: str, value: str) -> DataFrame:
    """One of the fixed tables above."""
    return F.broadcast(spark.createDataFrame(sorted(values.items()), f"{key} string, {value} string"))


def discover(files: DataFrame) -> DataFrame:
    """(project, languages, frameworks) of trees (project, path, content); manifests stand at the root."""
    spark = files.sparkSession
    roots = files.where(~F.contains("path", F.lit("/")))
    languages = roots.join(_table(spark, LANGUAGE_FILES, "path", "language"), "path").select("project", "language")
    script = roots.where("path = 'package.json'").join(roots.where("path = 'tsconfig.json'").select("project"), "project", "left_anti").select("project", F.lit("javascript").alias("language"))
    listed = roots.where("path = 'package.json'").select("project", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    packages = listed.select("project", F.explode(F.concat(*[F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])).alias("package"))
    frameworks = packages.join(_table(spark, PACKAGES, "package", "framework"), "package").select("project", "framework")
    frameworks = frameworks.unionByName(roots.join(_table(spark, FRAMEWORK_FILES, "path", "framework"), "path").select("project", "framework"))
    wanted = roots.where("path = 'requirements.txt'").select("project", F.lower("content").alias("content"))
    frameworks = frameworks.unionByName(wanted.join(_table(spark, PYTHON_PACKAGES, "package", "framework"), F.contains("content", "package")).select("project", "framework"))
    projects = files.select("project").distinct()
    sets = lambda rows, name: rows.groupBy("project").agg(F.array_sort(F.collect_set(name)).alias(f"{name}s"))
    rows = projects.join(sets(languages.unionByName(script), "language"), "project", "left").join(sets(frameworks, "framework"), "project", "left")
    return rows.select("project", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.coalesce("frameworks", F.array(F.lit("none"))).alias("frameworks"))


# By engine, in the order tried: what a project must have, the tool, and the programs that it takes (none: it comes along).
TOOLS = {
    "format": [
        ("typescript", "biome (bundled)", []), ("javascript", "biome (bundled)", []), ("python", "ruff", ["ruff"]), ("go", "gofmt", ["gofmt"]), ("rust", "cargo fmt", ["cargo"]), ("ruby", "rubocop", ["rubocop"]),
        ("php", "php-cs-fixer", ["php-cs-fixer"]),
    ],
    "lint": [
        ("expo", "expo-doctor + oxlint (bundled)", []), ("typescript", "oxlint (bundled)", []), ("javascript", "oxlint (bundled)", []), ("python", "ruff", ["ruff"]), ("go", "golangci-lint", ["golangci-lint"]),
        ("rust", "clippy", ["clippy-driver"]), ("ruby", "rubocop", ["rubocop"]),
    ],
    "code-quality": [("typescript", "knip (bundled)", []), ("javascript", "knip (bundled)", [])],
    "security": [
        ("pnpm-lock.yaml", "pnpm audit", []), ("package-lock.json", "npm audit", []), *((f, "pip-audit", ["pip-audit"]) for f in ("requirements.txt", "poetry.lock", "Pipfile.lock")),
        ("Cargo.toml", "cargo audit", ["cargo", "cargo-audit"]), ("go.mod", "govulncheck", ["govulncheck"]),
    ],
}
#: What an engine has where nothing fits: its tool, status and reason.
ELSE = {"format": ("no formatter", "skipped", "no supported language"), "lint": ("no linter", "skipped", "no supported language"), "code-quality": ("built-in", "ok", None), "ai-slop": ("built-in", "ok", None), "security": ("no auditor", "skipped", "no lockfile")}


def tool_plan(files: DataFrame, discovered: DataFrame, installed: DataFrame) -> DataFrame:
    """(project, engine, tool, status, reason): for each engine the first tool that fits a project.

    ``discovered`` are its (project, languages, frameworks), ``installed`` (binary) the programs at hand; status is
    ok, missing or skipped. Joins with small tables, and one aggregation.
    """
    spark = files.sparkSession
    table = [(e, k, need, tool, binaries) for e, tools in TOOLS.items() for k, (need, tool, binaries) in enumerate(tools)]
    tools = F.broadcast(spark.createDataFrame(table, "engine string, ord int, need string, tool string, binaries array<string>"))
    rest = F.broadcast(spark.createDataFrame([(e, *x) for e, x in ELSE.items()], "engine string, other string, status string, reason string"))
    has = discovered.select("project", F.explode(F.array_union("languages", "frameworks")).alias("need")).unionByName(files.where(~F.contains("path", F.lit("/"))).select("project", F.col("path").alias("need")))
    have = F.broadcast(installed.select("binary").distinct().agg(F.collect_set("binary").alias("have")))  # programs of one machine
    first = has.join(tools, "need").groupBy("project", "engine").agg(F.min_by(F.struct("tool", "binaries"), "ord").alias("t"))
    rows = discovered.select("project").join(rest).join(first, ["project", "engine"], "left").join(have)
    whole = F.size(F.array_except("t.binaries", "have")) == 0
    tool = F.when(F.size("t.binaries") == 0, F.col("t.tool")).when(whole, F.concat("t.tool", F.lit(" (system)"))).otherwise(F.concat("t.tool", F.lit(" not found")))
    return rows.select("project", "engine", F.coalesce(tool, "other").alias("tool"), F.when(F.col("t").isNull(), F.col("status")).when(whole, "ok").otherwise("missing").alias("status"), F.when(F.col("t").isNull(), F.col("reason")).alias("reason"))
