"""Scores of projects from their diagnostics.

One partial aggregation by project; engine weights and penalties are expressions, so nothing is joined but
the projects themselves, which keep those without diagnostics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators.schema import ENGINES, OTHER_PENALTY, PENALTY

# Thresholds, smoothing by default of the configuration and of the function, and score buckets.
GOOD, OK, SMOOTHING, BARE_SMOOTHING = 75, 50, 20, 10
WEIGHTS = dict(ENGINES)
BUCKETS = (75, 50, 25)


def penalty(severity: Column) -> Column:
    out = F.lit(OTHER_PENALTY)
    for name, value in PENALTY.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def weight(engine: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in weights.items():
        out = F.when(engine == name, F.lit(float(value))).otherwise(out)
    return out


def score_of(deductions: Column, issues: Column, files: Column, smoothing: float) -> Column:
    """0 to 100: logarithmic in the deductions, which weigh less the fewer issues there are for each file."""
    scaled = deductions * F.sqrt(F.least(F.lit(1.0), issues / (files + F.lit(float(smoothing)))))
    return F.greatest(F.lit(0), F.floor(F.lit(100.0) - F.lit(100.0) * F.log1p(scaled) / F.log1p(F.lit(100.0) + scaled) + 0.5)).cast("long")


def label(score: Column, good: int = GOOD, ok: int = OK) -> Column:
    return F.when(score >= good, "Healthy").when(score >= ok, "Needs Work").otherwise("Critical")


def color(score: Column, good: int = GOOD, ok: int = OK) -> Column:
    return F.when(score >= good, "success").when(score >= ok, "warn").otherwise("error")


def bucket(score: Column) -> Column:
    out = F.lit(f"0-{BUCKETS[-1]}")
    for low, high in zip(BUCKETS[::-1], [*BUCKETS[-2::-1], 100], strict=True):
        out = F.when(score >= low, F.lit(f"{low}-{high}")).otherwise(out)
    return out


def score(diagnostics: DataFrame, projects: DataFrame | None = None, by: tuple[str, ...] = ("project",), weights: dict[str, float] | None = None, good: int = GOOD, ok: int = OK, smoothing: float | None = None) -> DataFrame:
    """(by..., issues, errors, score, label). ``projects`` (project, files) gives file counts and clean projects.

    Without file counts the files that have diagnostics count. A project without diagnostics scores 100 and
    is healthy whatever the thresholds are.
    """
    smoothing = BARE_SMOOTHING if smoothing is None else smoothing
    rows = diagnostics.groupBy(*by).agg(
        F.count("*").alias("issues"),
        F.sum((F.col("severity") == "error").cast("long")).alias("errors"),
        F.sum(penalty(F.col("severity")) * weight(F.col("engine"), WEIGHTS if weights is None else weights)).alias("deductions"),
        F.count_distinct("filePath").alias("seen"),
    )
    if projects is not None:
        rows = projects.join(rows, "project", "left") if tuple(by) == ("project",) else rows.join(projects, "project", "left")
        files = F.when(F.col("files") > 0, F.col("files")).otherwise(F.greatest(F.lit(1), "seen"))
    else:
        files = F.greatest(F.lit(1), "seen")
    value = F.when(F.col("issues").isNull(), F.lit(100)).otherwise(score_of(F.col("deductions"), F.col("issues"), files, smoothing)).cast("long")
    rows = rows.select(*by, F.coalesce("issues", F.lit(0)).cast("long").alias("issues"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), value.alias("score"))
    return rows.withColumn("label", F.when(F.col("issues") == 0, "Healthy").otherwise(label(F.col("score"), good, ok)))


def gate(scores: DataFrame, fail_below: int = 0) -> DataFrame:
    """(…, failed): a project fails with any error or a score below the limit."""
    return scores.withColumn("failed", (F.col("errors") > 0) | (F.col("score") < fail_below))
