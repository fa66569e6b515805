"""Isolated engines, other tools' outputs in a scan, dispatch of files, stores, the chain of fixes and the tool plan."""

import json

import pytest
from pyspark.sql import functions as F

from codesieve.operators import adapters, architecture, fixes, schema
from codesieve.plans import scan
from codesieve.sources import changes, corpus, discover
from codesieve.streaming import hooks

FILES = "project string, path string, ext string, content string"
LINT = json.dumps({"diagnostics": [{"message": "Variable 'x' is declared but never used", "code": "eslint(no-unused-vars)", "severity": "warning", "filename": "a.ts", "labels": [{"span": {"line": 5, "column": 1}}]}]})
DEAD = json.dumps({"files": [], "issues": [{"file": "a.ts", "exports": [{"name": "x", "line": 5, "col": 1}, {"name": "y", "line": 7, "col": 1}], "types": [{"name": "T", "line": 8, "col": 2}]}]})
AUDIT = json.dumps({"advisories": {"1": {"module_name": "m", "severity": "critical"}}})


def files_of(spark, **named):
    return spark.createDataFrame([("p", path.replace("__", "/"), "." + path.rsplit(".", 1)[-1], text) for path, text in named.items()], FILES)


def outputs_of(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project string, tool string, output string")


def test_outputs_of_tools_enter_a_scan(spark):
    files, outputs = files_of(spark, **{"a.ts": "console.log(1);"}), outputs_of(spark, ("web_linter", LINT), ("package_audit", AUDIT), ("other", LINT), ("dead_code", "{broken"))
    rules = lambda rows: sorted(r.rule for r in rows.collect())
    assert rules(scan.scan(files, outputs=outputs)) == ["ai-slop/console-leftover", "eslint/no-unused-vars", "security/vulnerable-dependency"]
    assert rules(scan.scan(files, ["security"], outputs=outputs)) == ["security/vulnerable-dependency"]
    assert adapters.findings(outputs.where("false")).columns == schema.COLUMNS


def test_unused_declarations(spark):
    rows = adapters.unused_declarations(outputs_of(spark, ("web_linter", LINT), ("dead_code", DEAD))).collect()
    assert sorted((r.name, r.kind, r.line) for r in rows) == [("T", "type", 8), ("x", "variable", 5), ("y", "export", 7)]


def test_a_failing_engine_is_skipped(spark):
    files = files_of(spark, **{"a.ts": "eval(x);\nconsole.log(1);"})

    def broken(files, engines, rules, outputs):
        return scan.scan(files.withColumn("content", F.raise_error(F.lit("no tool here"))) if "security" in engines else files, engines, rules, outputs)

    rows, failed = scan.isolated(files, run=broken)
    assert [r.rule for r in rows.collect()] == ["ai-slop/console-leftover"] and [e for e, _ in failed] == ["security"] and "no tool here" in failed[0][1]
    rows, failed = scan.isolated(files)
    assert sorted(r.rule for r in rows.collect()) == ["ai-slop/console-leftover", "security/eval"] and not failed


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(architecture, "MAX_RULES", 1)
    rules = spark.range(2).select(*[F.lit("x").alias(f) for f in (*architecture.FIELDS, "from_rx", "forbid_rx", "where_rx")])
    with pytest.raises(ValueError):
        architecture.check_rules(files_of(spark, **{"a.ts": ""}), rules)


def test_dispatch_of_files(spark):
    files = files_of(spark, **{"src__a.ts": "x", "src__a.test.ts": "x", "README.md": "x"})
    paths = lambda rows: sorted(r.path for r in rows.collect())
    wanted = files.select("project", "path")
    assert paths(corpus.chosen_files(files)) == ["src/a.ts"]
    assert paths(corpus.chosen_files(files, wanted)) == ["src/a.test.ts", "src/a.ts"]
    assert paths(corpus.chosen_files(files, wanted.where("false"))) == []
    named = spark.createDataFrame([("p", []), ("p", None), ("q", ["b.ts"]), ("q", [])], "project string, files array<string>")
    changed = spark.createDataFrame([("p", "c.ts"), ("q", "d.ts")], "project string, path string")
    assert sorted(map(tuple, changes.edited_files(named, changed).collect())) == [("p", "c.ts"), ("q", "b.ts")]


def test_stores(spark, tmp_path):
    base = hooks.capture_baseline(files_of(spark, **{"a.ts": "eval(x);"}))
    for _ in range(2):
        hooks.write_baseline(base, str(tmp_path / "base"))
    assert sorted(map(tuple, hooks.read_baseline(spark, str(tmp_path / "base")).collect())) == sorted(map(tuple, base.collect()))
    assert not hooks.read_baseline(spark, str(tmp_path / "base"), "other").collect()
    (tmp_path / "log.jsonl").write_text('{"session": "s", "ts": 5, "files": ["a.ts", "b.ts"]}\n{broken\n{"session": "s", "ts": 3, "files": ["a.ts"]}\n\n')
    assert sorted(map(tuple, hooks.read_sessions(spark, str(tmp_path / "log.jsonl")).collect())) == [("s", 3, "a.ts"), ("s", 5, "b.ts")]


def test_chain_of_fixes(spark):
    files = files_of(spark, **{"package.json": '{"dependencies": {"a": "1", "b": "2"}}', "a.ts": 'import z from "z";\n// ----------\nconsole.log(1);\nconst o = {\n  k: 1,\n  k: 2,\n};'})
    row = ("p", "a.ts", "lint", "eslint/no-dupe-keys", "error", "Duplicate key 'k'", "", 6, 0, "Lint", True)
    unused = ("p", "package.json", "code-quality", "knip/dependencies", "warning", "Unused dependency: a", "", 0, 0, "Dependencies", True)
    advice = spark.createDataFrame([("p", "m", None, ">=1.2.0")], "project string, module string, vulnerable string, patched string")
    out = fixes.fix_project(files, spark.createDataFrame([row, unused], schema.DIAGNOSTICS), advice)
    assert out["files"].first().content == "const o = {\n  k: 1,\n};" and out["manifests"].first().dependencies == {"b": "2"} and tuple(out["overrides"].first())[1:] == ("m@<1.2.0", "^1.2.0")


def test_tool_plan(spark):
    files = files_of(spark, **{"package.json": '{"dependencies": {"expo": "1"}}', "Cargo.toml": "x", "src__go.mod": "x"})
    plan = discover.tool_plan(files, discover.discover(files), spark.createDataFrame([("cargo",)], "binary string"))
    assert {r.engine: (r.tool, r.status) for r in plan.collect()} == {
        "format": ("biome (bundled)", "ok"), "lint": ("expo-doctor + oxlint (bundled)", "ok"), "code-quality": ("knip (bundled)", "ok"), "ai-slop": ("built-in", "ok"), "security": ("cargo audit not found", "missing"),
    }
    bare = files_of(spark, **{"a.txt": ""})
    plan = {r.engine: r for r in discover.tool_plan(bare, discover.discover(bare), spark.createDataFrame([], "binary string")).collect()}
    assert plan["lint"].reason == "no supported language" and plan["security"].tool == "no auditor" and plan["code-quality"].status == "ok"


def test_small_inputs_are_spread(spark):
    assert corpus.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8 and corpus.spread(spark.range(0, 10, 1, 6)).rdd.getNumPartitions() == 6


def test_baselines_change_in_one_step(spark, tmp_path, monkeypatch):
    """Readers see the old or the new one; a baseline can be made of the one it replaces; a failed writer changes nothing."""
    place = str(tmp_path / "b")
    rows = lambda score: spark.createDataFrame([("p", "all", score, 1)], "project string, engine string, score bigint, files bigint")
    assert not hooks.read_baseline(spark, place).collect()
    hooks.write_baseline(rows(1), place)
    old = hooks.read_baseline(spark, place)
    for score in (2, 3):
        hooks.write_baseline(hooks.read_baseline(spark, place).withColumn("score", F.lit(score).cast("long")), place)
        assert old.first().score == 1 and hooks.read_baseline(spark, place).first().score == score
    with pytest.raises(Exception, match="broken"):
        hooks.write_baseline(rows(4).withColumn("score", F.raise_error(F.lit("broken")).cast("long")), place)
    assert hooks.read_baseline(spark, place).first().score == 3
    for score in range(5, 9):
        hooks.write_baseline(rows(score), place)
    assert hooks.read_baseline(spark, place).first().score == 8 and len(list((tmp_path / "b" / "versions").iterdir())) == hooks.VERSIONS
    assert not [x for x in (tmp_path / "b").iterdir() if x.name.endswith(".new")]


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    import shutil

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    events = [("p", "2026-01-01 00:00:00", json.dumps({"file_path": "a.ts"}))]
    spark.createDataFrame(events, "session string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = hooks.decode_events(spark.readStream.schema("session string, ts timestamp, payload string").parquet(source))
    files = files_of(spark, **{"a.ts": "console.log(1);"})
    for _ in range(2):
        hooks.run_hook(stream, files, None, out, state, "session").awaitTermination(180)
        assert [(r.project, r.total, r.batch) for r in spark.read.parquet(out).collect()] == [("p", 1, 0)]
        shutil.rmtree(tmp_path / "state" / "commits")  # as if the driver was lost before the batch was known to be done


def test_stop_gate_keeps_and_clears_sessions(spark, tmp_path):
    source, out, cleared, state = (str(tmp_path / x) for x in ("in", "out", "cleared", "state"))
    schema = "session string, ts timestamp, payload string"
    bad, good = files_of(spark, **{"a.ts": "console.log(1);", "b.ts": "console.log(2);"}), files_of(spark, **{"a.ts": "x();", "b.ts": "console.log(2);"})
    baseline = spark.createDataFrame([("p", 100)], "project string, score long")
    (tmp_path / "in").mkdir()
    stream = hooks.gate_events(spark.readStream.schema(schema).parquet(source))
    clock = iter(range(100))

    def run(files, *events):
        rows = [("p", f"2026-01-01 00:{next(clock):02d}:00", json.dumps(x)) for x in events]
        spark.createDataFrame(rows, "session string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        seen = set() if not (tmp_path / "out").exists() else {tuple(r) for r in spark.read.parquet(out).collect()}
        hooks.run_stop_gate(stream, files, baseline, out, cleared, state).awaitTermination(180)
        return [r.reason for r in spark.read.parquet(out).collect() if tuple(r) not in seen]

    stop, again, edit = {"hook_event_name": "Stop"}, {"hook_event_name": "Stop", "stop_hook_active": True}, {"file_path": "a.ts"}
    assert len(run(bad, edit)) == 0
    held = run(bad, stop)
    assert len(held) == 1 and held[0].startswith("Score dropped from 100 to ") and "Fix the 1 finding before" in held[0]
    assert run(bad, again) == []
    assert len(run(bad, stop)) == 1  # the session is still there after a restart
    assert run(good, stop) == [] and spark.read.parquet(cleared).count() == 1
    assert run(bad, stop) == []  # cleared: nothing was edited since
    assert len(run(bad, {"file_path": "b.ts"}, stop)) == 1


def test_failed_engines_are_skipped_in_the_report(spark):
    from codesieve.plans import report, score

    files = files_of(spark, **{"a.ts": "eval(x);\nconsole.log(1);"})

    def run(files, engines, *rest):
        if "security" in engines:
            raise ValueError("no rules\nmore")
        return scan.scan(files, engines, *rest)

    found, failed = scan.isolated(files, ["ai-slop", "security"], run=run)
    counts = scan.file_counts(files)
    doc = json.loads(report.json_report(found, score.score(found, counts), counts, skipped=[*failed, ("format", "disabled")]).first().report)
    assert doc["engines"]["security"] == {"issues": 0, "skipped": True, "reason": "no rules"} and doc["engines"]["format"] == {"issues": 0, "skipped": True, "reason": "disabled"}
    assert doc["engines"]["ai-slop"]["issues"] == 1 and doc["engines"]["ai-slop"]["skipped"] is False and len(doc["engines"]) == len(schema.ENGINES)


def test_fixes_of_unused_names_go_first(spark):
    files = files_of(spark, **{"a.ts": "// ----------\nconst gone = 1;\nexport const f = (x) => 1;\nconsole.log(1);\n"})
    target = "project string, path string, line long, column long, name string, kind string"
    declarations, bindings = spark.createDataFrame([("p", "a.ts", 2, 7, "gone", "variable")], target), spark.createDataFrame([("p", "a.ts", 3, 19, "x", "parameter")], target)
    assert fixes.fix_all(files, None, declarations, bindings).first().content == "export const f = (_x) => 1;\n"
