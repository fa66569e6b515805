"""The diagnostics relation, and what is fixed about its engines and severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIAGNOSTICS = "project string, filePath string, engine string, rule string, severity string, message string, help string, line bigint, column bigint, category string, fixable boolean"
COLUMNS = [x.split()[0] for x in DIAGNOSTICS.split(", ")]

# Engines in their order with their weights, and the penalty of a severity.
ENGINES = [("format", 0.3), ("lint", 0.6), ("code-quality", 0.8), ("ai-slop", 2.5), ("architecture", 1.0), ("security", 1.5)]
PENALTY = {"error": 3.0, "warning": 1.0}
OTHER_PENALTY = 0.25
# Detectors of each engine in the order in which their findings are reported, by how their rules begin; "" is all others.
REPORTED = {
    "format": ["formatting", "python-formatting", "go-formatting", "rust-formatting", "", "php-formatting"],
    "lint": ["", "expo-doctor/", "ruff/", "go/", "clippy/", "rubocop/"],
    "code-quality": ["knip/", "complexity/", "code-quality/repeated-chained-call", "code-quality/duplicate-block", ""],
    "ai-slop": ["ai-slop/trivial-comment", "ai-slop/swallowed-exception", "ai-slop/thin-wrapper", "ai-slop/generic-naming", "", "ai-slop/unused-import", "ai-slop/narrative-comment"],
    "architecture": [""],
    "security": ["security/hardcoded-secret", "", "security/vulnerable-dependency", "security/dependency-audit-skipped"],
}


def diagnostics(rows: DataFrame, engine: str, rule: Column | str, severity: Column | str, message: Column | str, line: Column, category: str, fixable: bool, help: str = "") -> DataFrame:
    """Rows with columns project and path as diagnostics."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "project", F.col("path").alias("filePath"), F.lit(engine).alias("engine"), text(rule).alias("rule"), text(severity).alias("severity"), text(message).alias("message"),
        F.lit(help).alias("help"), line.cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.lit(category).alias("category"), F.lit(fixable).alias("fixable"),
    )


FOUND = "array<struct<engine:string,rule:string,severity:string,message:string,help:string,line:bigint,category:string,fixable:boolean>>"


def finding(engine: str, rule: Column | str, severity: Column | str, message: Column | str, line: Column, category: str, fixable: Column | bool = False, help: Column | str = "") -> Column:
    """One finding, as an element of a file's array of findings."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {"engine": engine, "rule": rule, "severity": severity, "message": message, "help": help, "line": line.cast("long"), "category": category, "fixable": fixable}
    return F.struct(*[value(v).alias(k) for k, v in values.items()])


def _detector(begins: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN rule LIKE '{b}%' THEN {k}" for k, b in enumerate(begins) if b) + f" ELSE {begins.index('')} END" if len(begins) > 1 else "0"


#: The order of reports as SQL, without ties but for equal rows: engine, detector, file, line, column. All of it comes from the row itself.
REPORT_ORDER = [
    "CASE engine " + " ".join(f"WHEN '{e}' THEN {k}" for k, (e, _) in enumerate(ENGINES)) + f" ELSE {len(ENGINES)} END",
    "CASE engine " + " ".join(f"WHEN '{e}' THEN {_detector(b)}" for e, b in REPORTED.items()) + " ELSE 0 END",
    *('"filePath"', "line", '"column"', "rule", "message", "severity"),
]


def report_order() -> list[Column]:
    """The order of reports for windows over diagnostics."""
    return [F.expr(x.replace('"', "`")) for x in REPORT_ORDER]


def none() -> Column:
    return F.array().cast(FOUND)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(files: DataFrame, found: Column) -> DataFrame:
    """Diagnostics of an array of findings for each file.

    The outer form keeps Spark from testing the array in a filter first, which would compute it twice.
    """
    rows = files.select("project", F.col("path").alias("filePath"), found.alias("found")).select("project", "filePath", F.explode_outer("found").alias("x")).where("x IS NOT NULL")
    return rows.select("project", "filePath", "x.*", F.lit(0).cast("long").alias("column")).select(COLUMNS)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DIAGNOSTICS)


def engine_table(spark: SparkSession) -> DataFrame:
    """(engine, ord, weight) of all engines."""
    return spark.createDataFrame([(name, k, w) for k, (name, w) in enumerate(ENGINES)], "engine string, ord int, weight double")
