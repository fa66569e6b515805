"""User-declared import rules: a theta join of the files' imports with a small broadcast rule table.

Rules are a parameter of at most ``MAX_RULES`` rows: (name, type, match, from, forbid, pattern, where, severity).
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import breaks, holds, java
from codesieve.operators.schema import diagnostics, let
from codesieve.sources.corpus import JS, glob_regex

MAX_RULES = 10_000
FIELDS = ("name", "type", "match", "from", "forbid", "pattern", "where", "severity")

# How imports are written, by language.
ES_IMPORT, REQUIRE = r"""(?:import|from)\s+["']([^"']+)["']""", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""
PY_IMPORT, GO_IMPORT, GO_BLOCK = r"(?:from|import)\s+([\w.]+)", r"(?m)^\s*import\s+\"([^\"]+)\"", r"import\s*\(([^)]*)\)"


def load_rules(path: str) -> list[dict]:
    """Rules of a YAML file; a missing or broken file has none."""
    import yaml

    try:
        rules = (yaml.safe_load(Path(path).read_text()) or {}).get("rules")
    except (OSError, yaml.YAMLError, AttributeError):
        return []
    return rules if isinstance(rules, list) else []


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules to broadcast")
    rows = [tuple(r.get(f) for f in FIELDS) + (glob_regex(r["from"]) if r.get("from") else None, glob_regex(r["forbid"]) if r.get("forbid") else None, glob_regex(r["where"]) if r.get("where") else None) for r in rules]
    return spark.createDataFrame(rows, ", ".join(f"`{f}` string" for f in FIELDS) + ", from_rx string, forbid_rx string, where_rx string")


def imports(content: Column, ext: Column) -> Column:
    """What a file imports, in order and with repetitions."""
    every = lambda pattern, *needs: F.when(holds(content, (needs,)), F.regexp_extract_all(content, F.lit(java(pattern, "" if pattern.startswith("(?m)") else "".join(n[0] for n in needs))), F.lit(1))).otherwise(F.array().cast("array<string>"))
    blocks = F.flatten(F.transform(every(GO_BLOCK, "import"), lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), F.lit(1))))
    return F.when(ext.isin(JS), F.concat(every(ES_IMPORT, "import", "from"), every(REQUIRE, "require"))).when(ext == ".py", every(PY_IMPORT, "import", "from")).when(ext == ".go", F.concat(every(GO_IMPORT, "import"), blocks)).otherwise(F.array().cast("array<string>"))


def import_rows(files: DataFrame) -> DataFrame:
    """(project, path, import, line): the line is the first that holds the import's text, or 0."""

    def placed(found: Column) -> Column:
        before = lambda name: F.substring(F.col("content"), F.lit(1), F.instr(F.col("content"), name) - 1)
        first = lambda name: F.when(F.contains(name, F.lit("\n")), 0).otherwise(1 + breaks(before(name))).cast("long")
        return F.transform(found, lambda name, k: F.struct(k.alias("ord"), name.alias("import"), first(name).alias("line")))

    rows = files.select("project", "path", F.explode_outer(let(imports(F.col("content"), F.col("ext")), placed)).alias("x")).where("x IS NOT NULL")
    return rows.select("project", "path", "x.ord", "x.import", "x.line")


def check_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Diagnostics of all rules. Rules of unknown types give none; a missing severity stays missing.

    The rules are broadcast: more than ``MAX_RULES`` are refused.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError("too many rules to broadcast")
    name = F.concat(F.lit("arch/"), F.col("name"))
    of = lambda kind, *fields: (F.col("type") == kind) & reduce(Column.__and__, (F.coalesce(F.col(f), F.lit("")) != "" for f in fields))
    plain = of("forbid_import", "match")
    held = F.rlike("path", "from_rx") & (F.rlike("import", "forbid_rx") | F.contains("import", F.replace("forbid", F.lit("**"), F.lit(""))))
    forbidden = import_rows(files).join(F.broadcast(rules.where(plain | of("forbid_import_from_path", "from", "forbid"))), F.when(F.col("type") == "forbid_import", F.contains("import", "match")).otherwise(held))
    rule = F.concat(F.lit("' (rule: "), "name", F.lit(")"))
    message = F.when(F.col("type") == "forbid_import", F.concat(F.lit("Forbidden import '"), "import", rule)).otherwise(F.concat(F.lit("Import '"), "import", F.lit("' is forbidden from '"), "from", rule))
    forbidden = diagnostics(forbidden, "architecture", name, F.col("severity"), message, F.col("line"), "Architecture", False)
    required = files.join(F.broadcast(rules.where(of("require_pattern", "where", "pattern"))), F.rlike("path", "where_rx") & ~F.contains("content", "pattern"))
    required = diagnostics(required, "architecture", name, F.col("severity"), F.concat(F.lit("Required pattern '"), "pattern", F.lit("' not found (rule: "), "name", F.lit(")")), F.lit(0), "Architecture", False)
    return forbidden.unionByName(required)
