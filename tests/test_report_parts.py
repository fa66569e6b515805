"""The JSON report in bounded parts."""

import json

from pyspark.sql import functions as F

from codesieve.operators.schema import COLUMNS
from codesieve.plans import report


def test_report_parts_hold_every_diagnostic_once(spark, monkeypatch):
    rows = spark.range(40).unionByName(spark.range(9).select(F.lit(5).cast("long").alias("id"))).coalesce(1)
    rows = rows.select(F.when(F.col("id") < 37, "p").otherwise("q").alias("project"), F.lit("f.ts").alias("filePath"), F.col("id").alias("line"), F.lit("r").alias("rule"), F.lit("m").alias("message"), F.lit("lint").alias("engine"), F.lit("error").alias("severity"), F.lit(True).alias("fixable"), *[F.lit("x").alias(c) for c in COLUMNS if c not in ("project", "filePath", "line", "rule", "message", "engine", "severity", "fixable")]).cache()
    files = rows.select("project", F.lit(1).alias("files")).distinct()
    scores = rows.select("project").distinct().select("project", F.lit(5).alias("score"), F.lit("x").alias("label"))
    monkeypatch.setattr(report, "PART", 7)
    got = [(r.project, json.loads(r.report)) for r in report.json_report(rows, scores, files).collect()]
    assert all(len(d["diagnostics"]) <= 7 for _, d in got) and len({(p, *d["part"].values()) for p, d in got}) == len(got)
    found = sorted(str([p, *(x.get(c) for c in ("filePath", "line", "rule", "message"))]) for p, d in got for x in d["diagnostics"])
    assert found == sorted(str([r.project, r.filePath, r.line, r.rule, r.message]) for r in rows.collect())
