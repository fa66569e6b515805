"""Reports over diagnostics: counts, rollups, rankings, feedback and the JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.operators.schema import COLUMNS, ENGINES, engine_table, report_order

# Sizes of the reports' lists.
SAMPLES, FINDINGS, FILES, FILE_FINDINGS, STEP_FILES = 3, 20, 20, 10, 3
SNIPPET = 3
#: Diagnostics in one row of the JSON report at most.
PART = 10_000

_count = lambda condition: F.sum(condition.cast("long"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def summary(diagnostics: DataFrame) -> DataFrame:
    """(project, errors, warnings, fixable, total)."""
    return diagnostics.groupBy("project").agg(
        _count(F.col("severity") == "error").alias("errors"), _count(F.col("severity") == "warning").alias("warnings"), _count(F.col("fixable")).alias("fixable"), F.count("*").alias("total")
    )


def by_engine(diagnostics: DataFrame) -> DataFrame:
    """(engine, issues, errors, warnings) of every engine, those without issues too."""
    rows = diagnostics.groupBy("engine").agg(F.count("*").alias("issues"), _count(F.col("severity") == "error").alias("errors"), _count(F.col("severity") == "warning").alias("warnings"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(engine_table(diagnostics.sparkSession)).join(rows, "engine", "left").select("engine", *map(none, ("issues", "errors", "warnings")))


def rule_groups(diagnostics: DataFrame) -> DataFrame:
    """(project, engine, rule, message, severity, n, sample, more): findings that say the same, with the first places.

    The first places are ranks up to a small limit, which Spark already applies to each partition before the
    shuffle, so no group is gathered.
    """
    place = F.struct("filePath", "line")
    keys = ["project", "engine", "rule", "message"]
    ranked = diagnostics.groupBy(*keys, "filePath", "line").agg(F.min(severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("k"))
    order = Window.partitionBy(*keys).orderBy("filePath", "line")
    counts = ranked.groupBy(*keys).agg(F.sum("k").alias("n"), F.min("rank").alias("rank"))
    tops = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLES).groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("p"))
    shown = F.array_join(F.transform("p", lambda x: F.when(x["line"] > 0, F.concat_ws(":", x["filePath"], x["line"].cast("string"))).otherwise(x["filePath"])), ", ")
    rows = counts.join(tops, keys)
    names = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("rank") + 1)
    return rows.select(*keys, names.alias("severity"), "n", shown.alias("sample"), F.greatest(F.lit(0), F.col("n") - SAMPLES).cast("long").alias("more"))


def file_ranking(diagnostics: DataFrame, most: int = FILES) -> DataFrame:
    """(project, filePath, errors, total, place): the worst files of each project."""
    rows = diagnostics.groupBy("project", "filePath").agg(_count(F.col("severity") == "error").alias("errors"), F.count("*").alias("total"))
    order = Window.partitionBy("project").orderBy(F.desc("errors"), F.desc("total"), "filePath")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def findings(diagnostics: DataFrame, most: int = FINDINGS) -> DataFrame:
    """(project, place, filePath, line, rule, severity, message): the first findings of each project in the order of reports, notes left out."""
    rows = diagnostics.where(F.col("severity").isin("error", "warning"))
    order = Window.partitionBy("project").orderBy(*report_order())
    rows = rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)
    return rows.select("project", "place", "filePath", "line", "rule", "severity", "message")


def feedback(diagnostics: DataFrame, scores: DataFrame, baseline: DataFrame | None = None, schema: str = "codesieve.hook.v1", most: int = FINDINGS) -> DataFrame:
    """One row for each project: score, baseline, regressed, counts, findings, elided and next steps."""
    top = findings(diagnostics, most)
    steps = top.groupBy("project", "filePath").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), 1, 3), ", ").alias("ls"))
    text = F.concat(F.lit("Address "), "n", F.when(F.col("n") == 1, " finding in ").otherwise(" findings in "), "filePath", F.when(F.col("n") == 1, " (line ").otherwise(" (lines "), "ls", F.lit(")."))
    steps = steps.groupBy("project").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))), lambda x: x["text"]), 1, STEP_FILES).alias("files"))
    listed = top.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("rule").alias("ruleId"), "severity", F.col("filePath").alias("file"), "line", "message"))).alias("findings"), _count(F.col("severity") == "error").alias("wrong")
    )
    counts = diagnostics.groupBy("project").agg(
        _count(F.col("severity") == "error").alias("error"), _count(F.col("severity") == "warning").alias("warning"), _count(F.col("fixable")).alias("fixable"), _count(F.col("severity").isin("error", "warning")).alias("total")
    )
    rows = scores.select("project", "score").join(counts, "project", "left").join(listed, "project", "left").join(steps, "project", "left")
    rows = rows.join(baseline.select("project", F.col("score").alias("baseline")), "project", "left") if baseline is not None else rows.withColumn("baseline", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    urgent = F.when(F.col("wrong") > 0, F.array(F.concat(F.lit("Fix "), "wrong", F.when(F.col("wrong") == 1, " error").otherwise(" errors"), F.lit(" before the next turn.")))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "project", F.lit(schema).alias("schema"), "score", "baseline", F.coalesce(F.col("score") < F.col("baseline"), F.lit(False)).alias("regressed"), *map(zero, ("error", "warning", "fixable", "total")),
        F.coalesce("findings", F.array()).alias("findings"), F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - most).cast("long").alias("elided"),
        F.concat(urgent, F.coalesce("files", F.array().cast("array<string>"))).alias("next_steps"),
    )


def snippets(diagnostics: DataFrame, files: DataFrame, around: int = SNIPPET) -> DataFrame:
    """Diagnostics with the lines around them: an equi-join on the file, the range is cut out of its lines."""
    rows = diagnostics.join(files.select("project", F.col("path").alias("filePath"), F.split("content", "\n", -1).alias("ls")), ["project", "filePath"])
    first = F.greatest(F.lit(1), F.col("line") - around).cast("int")
    text = F.array_join(F.transform(F.slice("ls", first, (F.col("line") + around + 1).cast("int") - first), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n")
    return rows.withColumn("snippet", F.when(F.col("line") > 0, text)).drop("ls")


def engine_results(diagnostics: DataFrame, projects: DataFrame, skipped: list[tuple[str, str]] = ()) -> DataFrame:
    """(project, engine, issues, skipped, reason) of every engine in every project; ``skipped`` (engine, reason) are those left out or failed."""
    why = dict(skipped)
    told = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(e in why).alias("skipped"), F.lit(why.get(e)).cast("string").alias("reason")) for e, _ in ENGINES])
    rows = projects.select("project", F.explode(told).alias("x")).select("project", "x.*")
    counts = diagnostics.groupBy("project", "engine").agg(F.count("*").alias("issues"))
    return rows.join(counts, ["project", "engine"], "left").select("project", "engine", F.coalesce("issues", F.lit(0)).cast("long").alias("issues"), "skipped", "reason")


def json_report(diagnostics: DataFrame, scores: DataFrame, projects: DataFrame, version: str = "1", skipped: list[tuple[str, str]] = ()) -> DataFrame:
    """(project, report): JSON documents with at most ``PART`` diagnostics each, and the project's head in every one.

    A project's diagnostics are dealt by their hashes to as many buckets as they fill parts; what a bucket has
    beyond ``PART`` goes to further parts of it, so no row and no task holds a whole project.
    """
    results = engine_results(diagnostics, scores, skipped)
    engines = results.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", F.struct("issues", "skipped", "reason"))))).alias("engines"))
    own = [c for c in COLUMNS if c != "project"]
    sizes = summary(diagnostics).select("project", F.ceil(F.col("total") / PART).alias("buckets"))
    dealt = diagnostics.join(sizes, "project").withColumn("bucket", F.pmod(F.xxhash64(*own), F.col("buckets")))
    dealt = dealt.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("project", "bucket").orderBy(*own)) - 1) / PART))
    listed = dealt.groupBy("project", "bucket", "chunk").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("diagnostics"), F.first("buckets").alias("buckets"))
    part = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "buckets", "chunk")).alias("part")
    counts = F.struct(*[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("summary_errors", "errors"), ("warnings", "warnings"), ("fixable", "fixable"), ("files", "files"))])
    rows = scores.join(summary(diagnostics).withColumnRenamed("errors", "summary_errors"), "project", "left").join(engines, "project", "left").join(listed, "project", "left").join(projects, "project", "left")
    return rows.select("project", F.to_json(F.struct(F.lit(version).alias("schemaVersion"), "score", "label", "engines", part, "diagnostics", counts.alias("summary"))).alias("report"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule, before, after, resolved): what a step of fixes has done."""
    names = ["project", "filePath", "rule", "message", "line"]
    gone = before.select(names).exceptAll(after.select(names)).groupBy("rule").agg(F.count("*").alias("resolved"))
    counts = before.select("rule", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select("rule", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("rule").agg(F.sum("a").alias("before"), F.sum("b").alias("after"))
    return counts.join(gone, "rule", "left").select("rule", "before", "after", F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"))

