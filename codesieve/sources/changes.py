"""Sets of changed files, from the captured listings of a version control tool (one path in a line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that count as a change: added, copied, modified, renamed.
CHANGED = "ACMR"


def listed(outputs: DataFrame, project: str = "project", output: str = "output") -> DataFrame:
    """(project, path) of listings."""
    rows = outputs.select(F.col(project).alias("project"), F.explode(F.split(output, "\r?\n")).alias("path"))
    return rows.where(F.trim("path") != "")


def with_status(outputs: DataFrame, project: str = "project", output: str = "output") -> DataFrame:
    """(project, path) of listings with a status before each path; a rename counts by its new path."""
    rows = listed(outputs, project, output).select("project", F.split("path", "\t").alias("x"))
    return rows.where(F.substring(F.col("x")[0], 1, 1).isin(*CHANGED)).select("project", F.element_at("x", -1).alias("path"))


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """(project, path) of the union of changed and untracked files, each once."""
    return tracked.unionByName(untracked).distinct()


def edited_files(named: DataFrame, changed: DataFrame) -> DataFrame:
    """(project, path) of what an event names (project, files); a project whose events name nothing has its changed files."""
    rows = named.select("project", F.explode_outer("files").alias("path"))
    empty = rows.groupBy("project").agg(F.count("path").alias("n")).where("n = 0").select("project")
    return rows.where("path IS NOT NULL").unionByName(changed.join(empty, "project", "left_semi")).distinct()


def version_order(version: Column) -> Column:
    """What semantic versions are ordered by: numbers, releases after their prereleases, and those by their parts, numbers before words."""
    number = lambda k: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)", k).try_cast("decimal(38,0)")
    before = F.regexp_extract(version, r"^\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    numeric = lambda x: x.rlike(r"^\d+\z")
    part = lambda x: F.struct(F.when(numeric(x), 0).otherwise(1).alias("kind"), F.when(numeric(x), x.try_cast("decimal(38,0)")).alias("number"), F.when(~numeric(x), x).alias("word"))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (before == "").alias("release"), F.transform(F.array_remove(F.split(before, r"\."), ""), part).alias("parts"))


def needed_overrides(advisories: DataFrame) -> DataFrame:
    """(project, key, version) of overrides for (project, module, vulnerable, patched).

    The key is the module with its vulnerable range, or with what is below the first version of the patched one where
    the range is missing or everything; the version is the caret range of the first version that ``patched`` allows by
    ``>`` or ``>=``; other advisories need no override. Of equal keys the highest version counts, in semantic order.
    """
    version = F.regexp_extract("patched", r"^\s*>=?\s*([0-9]+\.[0-9]+\.[0-9]+[^\s]*)", 1)
    below = F.regexp_extract("patched", r"([0-9]+\.[0-9]+\.[0-9]+)", 1)
    vulnerable = F.trim(F.coalesce("vulnerable", F.lit("")))
    key = F.concat("module", F.when(~vulnerable.isin("", "*"), F.concat(F.lit("@"), vulnerable)).otherwise(F.concat(F.lit("@<"), below)))
    rows = advisories.where("module IS NOT NULL AND module <> '' AND patched IS NOT NULL").select("project", key.alias("key"), version.alias("version")).where("version <> ''")
    return rows.groupBy("project", "key").agg(F.concat(F.lit("^"), F.max_by("version", F.struct(version_order(F.col("version")), "version"))).alias("version"))
