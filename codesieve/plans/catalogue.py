"""The catalogue of rules, statuses of engines, prompts for what is left to fix, and badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.operators import line_rules, quality, schema, security
from codesieve.plans.report import FILE_FINDINGS, FILES, snippets

# Rules that are not in a table of their own (name, engine, severity, fixable).
OTHER_RULES = [
    ("formatting", "format", "warning", True),
    ("python-formatting", "format", "warning", True),
    ("go-formatting", "format", "warning", True),
    ("rust-formatting", "format", "warning", True),
    ("php-formatting", "format", "warning", True),
    ("complexity/file-too-large", "code-quality", "warning", False),
    ("complexity/function-too-long", "code-quality", "warning", False),
    ("complexity/deep-nesting", "code-quality", "warning", False),
    ("complexity/too-many-params", "code-quality", "warning", False),
    ("code-quality/duplicate-block", "code-quality", "warning", False),
    ("code-quality/repeated-chained-call", "code-quality", "warning", False),
    ("ai-slop/thin-wrapper", "ai-slop", "warning", False),
    ("ai-slop/swallowed-exception", "ai-slop", "error", False),
    ("ai-slop/unused-import", "ai-slop", "warning", True),
    ("ai-slop/narrative-comment", "ai-slop", "warning", True),
    ("security/hardcoded-secret", "security", "error", False),
    ("security/vulnerable-dependency", "security", "error", False),
    ("security/dependency-audit-skipped", "security", "info", False),
]


def rule_rows(rules: list[dict] | None = None) -> set[tuple]:
    rows = {(f"ai-slop/{r.name}", "ai-slop", r.severity, r.fixable) for r in line_rules.RULES} | {(f"security/{r[0]}", "security", "error", False) for r in security.RISKY} | set(OTHER_RULES)
    return rows | {(f"arch/{r['name']}", "architecture", r.get("severity"), False) for r in rules or [] if r.get("name")}


def rule_catalogue(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """(rule, engine, severity, fixable) of all rules, with those of the architecture rules given."""
    return spark.createDataFrame(sorted(rule_rows(rules), key=str), "rule string, engine string, severity string, fixable boolean")


def engine_status(diagnostics: DataFrame, skipped: list[tuple[str, str]] | None = None) -> DataFrame:
    """(engine, status): how an engine's line reads."""
    spark = diagnostics.sparkSession
    counts = diagnostics.groupBy("engine").agg(F.sum((F.col("severity") == "error").cast("long")).alias("e"), F.sum((F.col("severity") == "warning").cast("long")).alias("w"), F.count("*").alias("n"))
    why = spark.createDataFrame(skipped or [], "engine string, why string")
    rows = F.broadcast(schema.engine_table(spark)).join(counts, "engine", "left").join(F.broadcast(why), "engine", "left")
    plural = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))
    text = F.when(F.col("why").isNotNull(), F.concat(F.lit("skipped: "), "why")).when(F.col("n").isNull(), "no issues").otherwise(F.concat_ws(", ", plural(F.col("n"), "issue"), plural(F.col("e"), "error"), plural(F.col("w"), "warning")))
    return rows.select("engine", text.alias("status"))


def prompt_rows(diagnostics: DataFrame, files: int = FILES, each: int = FILE_FINDINGS) -> DataFrame:
    """(project, filePath, file_place, place, line, rule, severity, message): what a prompt shows, worst files first."""
    totals = diagnostics.groupBy("project", "filePath").agg(F.sum((F.col("severity") == "error").cast("long")).alias("e"), F.count("*").alias("n"))
    order = Window.partitionBy("project").orderBy(F.desc("e"), F.desc("n"), "filePath")
    worst = totals.withColumn("file_place", F.row_number().over(order).cast("long")).where(F.col("file_place") <= files).select("project", "filePath", "file_place")
    own = Window.partitionBy("project", "filePath").orderBy(*schema.report_order())
    rows = diagnostics.join(worst, ["project", "filePath"]).withColumn("place", F.row_number().over(own).cast("long")).where(F.col("place") <= each)
    return rows.select("project", "filePath", "file_place", "place", "line", "rule", "severity", "message")


def prompts(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """(project, prompt): a text for each project, bounded by the numbers of files and findings that it shows."""
    rows = snippets(prompt_rows(diagnostics), files)
    item = F.concat_ws("\n", F.concat(F.lit("- "), "severity", F.lit(" "), "rule", F.lit(" at line "), "line", F.lit(": "), "message"), "snippet")
    by_file = rows.groupBy("project", "file_place", "filePath").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_place", F.concat(F.lit("## "), "filePath", F.lit("\n"), "t").alias("t")))), lambda x: x["t"]), "\n\n")
    return by_file.groupBy("project").agg(text.alias("prompt"))


def repository_of(remotes: DataFrame, url: str = "url") -> DataFrame:
    """Add ``repository`` (owner/name) of a hosted remote's address; null for other addresses."""
    found = F.regexp_extract(url, r"^(?:git@[^:/]+:|(?:https?|ssh|git)://(?:[^@/]+@)?[^/]+/)([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return remotes.withColumn("repository", F.when(found != "", found))


def check_limits(functions: DataFrame) -> DataFrame:
    """(project, functions, over): how many functions pass the default limits."""
    over = (F.col("lines") > quality.MAX_FUNCTION) | (F.col("nesting") > quality.MAX_NESTING) | (F.col("params") > quality.MAX_PARAMS)
    return functions.groupBy("project").agg(F.count("*").alias("functions"), F.sum(over.cast("long")).alias("over"))
