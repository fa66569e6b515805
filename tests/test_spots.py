"""Matches found in tasks: the same as those of Spark's patterns, by one pass."""

import time

from pyspark.sql import functions as F

from codesieve.functions.text import java
from codesieve.operators import file_rules, quality, security, spots
from codesieve.plans import scan
from tests.test_needs import FRAGMENTS, _files

ODD = ["toKen = 'abcdefghijklmnopqrstu'", "paſſword='123456789'", "éeval(x)", "eval (x)", "def f١(a):\n  return g(a)", "catch　(e) {\n// x\n}", "\U0001f600\n\npassword = '12345678'"]


def test_matches_are_those_of_spark(spark):
    patterns = [p for _, p, _ in file_rules.SWALLOWED] + file_rules.WRAPPERS + [p for _, p in file_rules.SECRETS] + [p for _, _, p, _ in security.RISKY]
    files = _files(spark).select("ext", "content").unionByName(spark.createDataFrame([(".ts", x) for x in [*ODD, "\n".join(FRAGMENTS)]], "ext string, content string")).cache()
    rows = files.select("content", spots.in_files(spots.seeker([spots.Sought(p) for p in patterns])).alias("found"), *[F.regexp_extract_all("content", F.lit(java(p)), F.lit(0)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for r in rows:
        for k in range(len(patterns)):
            found = [s for s in r.found if s.k == k]
            assert [s.match for s in found] == r[f"p{k}"]
            for s in found:
                assert r.content[s.at : s.at + len(s.match)] == s.match and s.line == 1 + r.content.count("\n", 0, s.at)


def test_a_scan_looks_for_words_in_one_pass_of_tasks(spark):
    plan = scan.scan(_files(spark))._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [x for x in plan if "contains(content" in x] and len([x for x in plan if x.lstrip(" :+-*()0123456789").startswith("ArrowEvalPython")]) == 1


def test_repeats_in_a_long_file_take_no_time_in_its_square(spark):
    block = [f"step{chr(97 + k)}(a, '{k}');" for k in range(12)]
    middle = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}();" for k in range(60_000)]
    files = spark.createDataFrame([("p", "a.ts", ".ts", "\n".join([*block, *middle, *block]))], "project string, path string, ext string, content string")
    began = time.perf_counter()
    assert [(r.line, r.prior) for r in quality.duplicate_windows(files).collect()] == [(60_013 + k, 1 + k) for k in range(3)]
    assert time.perf_counter() - began < 30
