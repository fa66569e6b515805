"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import re2
from codesieve.operators import adapters, architecture, file_rules, fixes, imports, line_rules, narrative, quality, schema, security, unused
from codesieve.plans import captured, catalogue, oracles, report, scan, score
from codesieve.sources import changes, discover
from codesieve.sources.corpus import CORPUS_SQL, JS, filter_files, shared_folder, short_batches, spread, stored, synthetic_corpus, without_generated
from codesieve.streaming import hooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RULES = [
    {"name": "no-axios", "type": "forbid_import", "match": "axios", "severity": "error"},
    {"name": "front-no-db", "type": "forbid_import_from_path", "from": "src/src1*/**", "forbid": "src/db/**", "severity": "warning"},
    {"name": "needs-the", "type": "require_pattern", "where": "src/src2/*.ts", "pattern": " the ", "severity": "info"},
    {"name": "unknown", "type": "other", "match": "x"},
]


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, written once, as files are in a store: what a query reads twice is not made twice."""
    short_batches(spark)
    return stored(synthetic_corpus(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_generated(_corpus(spark, sf_dir))


def _scan(files: DataFrame) -> DataFrame:
    """Diagnostics of all detectors, written once for all that is made of them."""
    return stored(scan.scan(files, rules=architecture.rule_table(files.sparkSession, RULES)))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(_corpus(spark, sf_dir))


def _score(found: DataFrame, files: DataFrame) -> DataFrame:
    return score.score(found, scan.file_counts(files), smoothing=score.SMOOTHING)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _corpus(spark, sf_dir)
    return _score(_scan(files), files)


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback against a baseline of 30; lists are written as text."""
    files = _corpus(spark, sf_dir)
    found = _scan(files)
    scores = stored(_score(found, files))
    rows = report.feedback(found, scores, scores.withColumn("score", F.lit(30).cast("long")))
    listed = F.transform("findings", lambda x: F.concat_ws("|", x["place"].cast("string"), x["ruleId"], x["severity"], x["file"], x["line"].cast("string"), x["message"]))
    return rows.select("project", "score", "baseline", "regressed", "error", "warning", "fixable", "total", "elided", F.array_join(listed, "\n").alias("findings"), F.array_join("next_steps", "\n").alias("next_steps"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _corpus(spark, sf_dir)
    found = _scan(files)
    return report.json_report(found, _score(found, files), scan.file_counts(files))


def _with_files(make):
    """A query of all diagnostics and the files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _corpus(spark, sf_dir)
        return make(_scan(files), files)

    return run


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


_row = oracles.row


_js = ", ".join(map(repr, JS))
_large_of = lambda most: _row("code-quality", "'complexity/file-too-large'", "'warning'", "'File has ' || n || ' lines (max: ' || most || ')'", "Split the file", "CAST(0 AS BIGINT)", "Complexity") + f"""FROM (
    SELECT project, path, len(ls) AS n, CASE WHEN lower(ext) IN ('.jsx', '.tsx') THEN {most * 3 // 2} ELSE {most} END AS most,
        len(list_filter(ls, lambda x: regexp_replace(x, {re2(r'^\s+|\s+$')}, '', 'g') <> '')) AS full_lines, len(list_filter(ls, lambda x: regexp_matches(x, {re2(r'^\s*[{}\[\]"' + "'" + ']')}))) AS data_lines
    FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)) WHERE n > most AND NOT (full_lines > 0 AND data_lines / greatest(full_lines, 1) > 0.8)"""  # noqa: E731
_chains = _row("code-quality", "'code-quality/repeated-chained-call'", "'warning'", "n || ' consecutive `.' || method || '()` calls that differ only in string literals. Extract a data table + loop.'", "Loop over a table", "line", "Complexity") + f"""FROM (
    SELECT *, row_number() OVER (PARTITION BY project, path, run ORDER BY part DESC) AS place FROM (
        SELECT project, path, run, part, min(line) AS line, count(*) AS n, any_value(method) AS method FROM (
            SELECT *, sum(CASE WHEN together AND method = pm THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN together AND method = pm AND shape = ps THEN 0 ELSE 1 END) OVER w AS part FROM (
                SELECT *, coalesce(line - lag(line) OVER w = 1, false) AS together, lag(method) OVER w AS pm, lag(shape) OVER w AS ps FROM (
                    SELECT project, path, line, regexp_extract(raw, {re2(quality.CHAINED)}, 1) AS method,
                        regexp_replace(regexp_replace(regexp_replace(raw, {re2(quality.LITERALS)}, '"L"', 'g'), {re2(r'^\s+|\s+$')}, '', 'g'), {re2(r';\s*$')}, '') AS shape
                    FROM fields WHERE lower(ext) IN ({_js})) WHERE method <> '' WINDOW w AS (PARTITION BY project, path ORDER BY line))
            WINDOW w AS (PARTITION BY project, path ORDER BY line)) GROUP BY ALL)) WHERE place = 1 AND n >= 5"""
_every = lambda p, text="content": f"regexp_extract_all({text}, {re2(p)}, 1)"
_imports = f"""imported AS (SELECT project, path, i AS import, CAST(coalesce(list_position(list_transform(ls, lambda x: contains(x, i)), true), 0) AS BIGINT) AS line FROM (
    SELECT project, path, string_split(content, chr(10)) AS ls, unnest(CASE WHEN ext IN ({_js}) THEN list_concat({_every(architecture.ES_IMPORT)}, {_every(architecture.REQUIRE)}) WHEN ext = '.py' THEN {_every(architecture.PY_IMPORT)}
        WHEN ext = '.go' THEN list_concat({_every(architecture.GO_IMPORT)}, flatten(list_transform({_every(architecture.GO_BLOCK)}, lambda b: regexp_extract_all(b, '"([^"]+)"', 1)))) ELSE [] END) AS i FROM files))"""
_arch = " UNION ALL ".join(
    (
        _row("architecture", "'arch/no-axios'", "'error'", "'Forbidden import ''' || import || ''' (rule: no-axios)'", "", "line", "Architecture") + "FROM imported WHERE contains(import, 'axios')",
        _row("architecture", "'arch/front-no-db'", "'warning'", "'Import ''' || import || ''' is forbidden from ''src/src1*/**'' (rule: front-no-db)'", "", "line", "Architecture") + "FROM imported WHERE regexp_matches(path, '^src/src1[^/]*/.*$') AND (regexp_matches(import, '^src/db/.*$') OR contains(import, 'src/db/'))",
        _row("architecture", "'arch/needs-the'", "'info'", "'Required pattern '' the '' not found (rule: needs-the)'", "", "CAST(0 AS BIGINT)", "Architecture") + r"FROM files WHERE regexp_matches(path, '^src/src2/[^/]*\.ts$') AND NOT contains(content, ' the ')",
    )
)
_with = f"WITH {CORPUS_SQL},\n{line_rules.LINES_SQL},\n{_imports}"
_walked = ",\n".join((oracles.IMPORTS, oracles.NARRATIVE, oracles.MASKED, oracles.WINDOWS, oracles.BLOCKS, oracles.FUNCTIONS))
_all = " UNION ALL ".join(
    [*map(line_rules.rule_sql, line_rules.RULES), file_rules.SWALLOWED_SQL, file_rules.SECRETS_SQL, file_rules.WRAPPERS_SQL, _large_of(400), _chains, _arch, oracles.UNUSED, oracles.NARRATED, oracles.RISKY, oracles.DUPLICATES, oracles.COMPLEX]
)
_diagnostics = f"{_with},\n{_walked},\ndiagnostics AS ({_all})"
_reported = ", ".join(schema.REPORT_ORDER)
_weights = "CASE engine " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in schema.ENGINES) + " ELSE 1.0 END"
_value = lambda files: f"""CAST(greatest(0, floor(100 - 100 * ln(1 + scaled) / ln(101 + scaled) + 0.5)) AS BIGINT)"""
_scored = f"""counts AS (SELECT project, count(*) AS files FROM files GROUP BY 1),
sums AS (SELECT project, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, sum(CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.25 END::DOUBLE * ({_weights})::DOUBLE) AS deductions FROM diagnostics GROUP BY 1),
scores AS (SELECT project, issues, errors, score, CASE WHEN issues = 0 OR score >= 75 THEN 'Healthy' WHEN score >= 50 THEN 'Needs Work' ELSE 'Critical' END AS label FROM (
    SELECT c.project, coalesce(issues, 0) AS issues, coalesce(errors, 0) AS errors, CASE WHEN issues IS NULL THEN 100 ELSE {_value('files')} END AS score FROM (
        SELECT *, deductions * sqrt(least(1.0, issues / (files + 20.0))) AS scaled FROM counts LEFT JOIN sums USING (project)) c))"""

for _rule in line_rules.RULES:
    _add(f"rule_{_rule.name.replace('-', '_')}", lambda s, d, n=_rule.name: line_rules.detect_lines(_written(s, d), [n]), f"WITH {CORPUS_SQL},\n{line_rules.LINES_SQL}\n{line_rules.rule_sql(_rule)}")
_walk = lambda parts, select: f"{_with},\n{parts}\n{select}"
for _name, _detect, _sql in (
    ("rule_swallowed_exception", file_rules.swallowed_exceptions, file_rules.SWALLOWED_SQL),
    ("rule_hardcoded_secret", file_rules.hardcoded_secrets, file_rules.SECRETS_SQL),
    ("rule_thin_wrapper", file_rules.thin_wrappers, file_rules.WRAPPERS_SQL),
    ("rule_file_too_large", lambda files: quality.large_files(files, 60), _large_of(60)),
    ("rule_repeated_chained_call", quality.repeated_chains, _chains),
    ("rule_unused_import", imports.unused_imports, _walk(oracles.IMPORTS, oracles.UNUSED)),
    ("rule_narrative_comment", narrative.narrative_comments, _walk(oracles.NARRATIVE, oracles.NARRATED)),
    ("rule_risky_constructs", security.risky_constructs, _walk(oracles.MASKED, oracles.RISKY)),
    ("rule_complex_functions", quality.complex_functions, _walk(oracles.FUNCTIONS, oracles.COMPLEX)),
    ("rule_duplicate_block", quality.duplicate_blocks, _walk(f"{oracles.WINDOWS},\n{oracles.BLOCKS}", oracles.DUPLICATES)),
    ("function_rows", quality.function_rows, _walk(oracles.FUNCTIONS, "SELECT * FROM functions")),
):
    _add(_name, lambda s, d, f=_detect: f(_written(s, d)), _sql if _sql.startswith("WITH") else f"{_with}\n{_sql}")


def _functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality.register_functions(spark)
    return spark.sql("SELECT project, path, f.* FROM {files}, LATERAL detect_functions(content, ext) f", files=_written(spark, sf_dir))


_add("functions_in_sql", _functions_in_sql, SQL["function_rows"])
_add("rule_architecture", lambda s, d: architecture.check_rules(_written(s, d), architecture.rule_table(s, RULES)), f"{_with}\n{_arch}")
_add("import_rows", lambda s, d: architecture.import_rows(_written(s, d)).select("project", "path", "import", "line"), f"{_with}\nSELECT * FROM imported")
_add("source_lines", lambda s, d: line_rules.source_lines(_written(s, d)).select("project", "path", "line", F.col("t").alias("trimmed")), f"{_with}\nSELECT project, path, line, t AS trimmed FROM fields")
_add("raw_document_secrets", lambda s, d: file_rules.hardcoded_secrets(_raw(s, d)).select("filePath", "message", "line"), f"WITH files AS (SELECT source AS project, CAST(doc_id AS VARCHAR) AS path, '' AS ext, text AS content FROM documents WHERE text IS NOT NULL)\nSELECT \"filePath\", message, line FROM ({file_rules.SECRETS_SQL})")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "source", "text"))
    return docs.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"), F.lit("").alias("ext"), F.col("text").alias("content"))


_add("duplicate_windows", lambda s, d: quality.duplicate_windows(_written(s, d)), f"{_with},\n{oracles.WINDOWS}\nSELECT * FROM repeated")


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of files from trees with folders that don't count, tests, ignored and generated files."""
    files = _corpus(spark, sf_dir)
    kind = F.pmod(F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long"), F.lit(9))
    paths = [F.col("path"), F.replace("path", F.lit("src/"), F.lit("src/node_modules/")), F.regexp_replace("path", r"\.([a-z]+)$", ".test.$1"), F.replace("path", F.lit("/f"), F.lit("/test_f")), F.regexp_replace("path", r"\.([a-z]+)$", "_test.$1"), F.concat(F.lit("dist/"), "path")]
    varied = files.withColumn("kind", kind).withColumn("path", F.coalesce(F.get(F.array(*paths), F.col("kind").cast("int")), F.col("path")))
    varied = stored(varied.withColumn("content", F.when(F.col("kind") == 6, F.concat(F.lit("// @generated\n"), "content")).otherwise(F.col("content"))))
    kept = filter_files(varied, varied.where("kind = 7").select("project", "path"), ["src/src3", ".tsx"])
    return without_generated(kept).select("project", "path", "ext")


_add(
    "file_selection",
    _selected,
    f"""WITH {CORPUS_SQL}, numbered AS (SELECT *, CAST(regexp_extract(path, '/f(\\d+)\\.', 1) AS BIGINT) % 9 AS kind FROM files WHERE NOT starts_with(path, 'src/src3/') AND ext <> '.tsx')
SELECT project, CASE WHEN kind = 3 THEN replace(path, '/f', '/test_f') ELSE path END AS path, ext FROM numbered WHERE kind IN (0, 8) OR (kind = 3 AND ext = '.go')""",
)
_add("diagnostics", _found, f"{_diagnostics}\nSELECT * FROM diagnostics")
_add("project_scores", _scores, f"{_diagnostics},\n{_scored}\nSELECT * FROM scores")
_add("quality_gate", lambda s, d: score.gate(_scores(s, d), 40), f"{_diagnostics},\n{_scored}\nSELECT *, errors > 0 OR score < 40 AS failed FROM scores")
_add("score_buckets", lambda s, d: _scores(s, d).groupBy(score.bucket(F.col("score")).alias("bucket"), score.color(F.col("score")).alias("color")).agg(F.count("*").alias("projects")), f"{_diagnostics},\n{_scored}\nSELECT CASE WHEN score >= 75 THEN '75-100' WHEN score >= 50 THEN '50-75' WHEN score >= 25 THEN '25-50' ELSE '0-25' END AS bucket, CASE WHEN score >= 75 THEN 'success' WHEN score >= 50 THEN 'warn' ELSE 'error' END AS color, count(*) AS projects FROM scores GROUP BY 1, 2")
_add(
    "engine_scores",
    lambda s, d: score.score(_found(s, d), by=("project", "engine")).select("project", "engine", "issues", "score"),
    f"{_diagnostics}\nSELECT project, engine, issues, {_value('seen')} AS score FROM (SELECT *, deductions * sqrt(least(1.0, issues / (greatest(1, seen) + 10.0))) AS scaled FROM (SELECT project, engine, count(*) AS issues, count(DISTINCT \"filePath\") AS seen, sum(CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.25 END::DOUBLE * ({_weights})::DOUBLE) AS deductions FROM diagnostics GROUP BY ALL))",
)
_add("report_summary", lambda s, d: report.summary(_found(s, d)), f"{_diagnostics}\nSELECT project, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (fixable) AS fixable, count(*) AS total FROM diagnostics GROUP BY 1")
_add("report_by_engine", lambda s, d: report.by_engine(_found(s, d)), f"{_diagnostics}\nSELECT e.engine, count(d.rule) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM (VALUES {', '.join(f'({e!r})' for e, _ in schema.ENGINES)}) e(engine) LEFT JOIN diagnostics d USING (engine) GROUP BY 1")
_add(
    "report_rule_groups",
    lambda s, d: report.rule_groups(_found(s, d)),
    f"""{_diagnostics},
grouped AS (SELECT project, engine, rule, message, "filePath", line, count(*) AS k, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS r FROM diagnostics GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY project, engine, rule, message ORDER BY "filePath", line) AS place FROM grouped)
SELECT project, engine, rule, message, CASE min(r) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CAST(sum(k) AS BIGINT) AS n,
    string_agg(CASE WHEN line > 0 THEN "filePath" || ':' || line ELSE "filePath" END, ', ' ORDER BY place) FILTER (place <= 3) AS sample, CAST(greatest(0, sum(k) - 3) AS BIGINT) AS more FROM places GROUP BY ALL""",
)
_add("report_file_ranking", lambda s, d: report.file_ranking(_found(s, d)), f"{_diagnostics}\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY errors DESC, total DESC, \"filePath\") AS place FROM (SELECT project, \"filePath\", count(*) FILTER (severity = 'error') AS errors, count(*) AS total FROM diagnostics GROUP BY ALL)) WHERE place <= 20")
_add("report_findings", lambda s, d: report.findings(_found(s, d)), f"{_diagnostics}\nSELECT project, place, \"filePath\", line, rule, severity, message FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_reported}) AS place FROM diagnostics WHERE severity IN ('error', 'warning')) WHERE place <= 20")
_add(
    "hook_feedback",
    _feedback,
    f"""{_diagnostics},
{_scored},
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_reported}) AS place FROM diagnostics WHERE severity IN ('error', 'warning')),
top AS (SELECT * FROM placed WHERE place <= 20),
listed AS (SELECT project, string_agg(concat_ws('|', place, rule, severity, "filePath", line, message), chr(10) ORDER BY place) AS findings, count(*) FILTER (severity = 'error') AS wrong FROM top GROUP BY 1),
steps AS (SELECT project, string_agg('Address ' || n || CASE WHEN n = 1 THEN ' finding in ' ELSE ' findings in ' END || "filePath" || CASE WHEN n = 1 THEN ' (line ' ELSE ' (lines ' END || ls || ').', chr(10) ORDER BY first) AS steps FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY first) AS k FROM (SELECT project, "filePath", min(place) AS first, count(*) AS n, array_to_string(list(line ORDER BY place)[1:3], ', ') AS ls FROM top GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1),
sums_of AS (SELECT project, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (fixable) AS fixable, count(*) FILTER (severity IN ('error', 'warning')) AS total FROM diagnostics GROUP BY 1)
SELECT s.project, s.score, 30 AS baseline, s.score < 30 AS regressed, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(fixable, 0) AS fixable, coalesce(total, 0) AS total, greatest(0, coalesce(total, 0) - 20) AS elided, coalesce(findings, '') AS findings,
    concat_ws(chr(10), CASE WHEN wrong > 0 THEN 'Fix ' || wrong || CASE WHEN wrong = 1 THEN ' error' ELSE ' errors' END || ' before the next turn.' END, steps) AS next_steps
FROM scores s LEFT JOIN sums_of USING (project) LEFT JOIN listed USING (project) LEFT JOIN steps USING (project)""",
)
_add("full_scan", lambda s, d: scan.scan(_corpus(s, d), rules=architecture.rule_table(s, RULES)), f"{_diagnostics}\nSELECT * FROM diagnostics")
_add("json_report", _json)


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of the JSON report, read back from its documents."""
    item = F.from_json("report", f"diagnostics array<struct<{schema.DIAGNOSTICS.split(', ', 1)[1].replace(' ', ':').replace(',:', ',')}>>")
    return _json(spark, sf_dir).select("project", F.explode(item["diagnostics"]).alias("x")).select("project", "x.*")


_add("json_report_rows", _reread, f"{_diagnostics}\nSELECT * FROM diagnostics")
_snippet = "CASE WHEN line > 0 THEN array_to_string(list_transform(range(greatest(1, line - 3), least(line + 3, len(ls)) + 1), lambda i: i || ': ' || ls[i]), chr(10)) END AS snippet"
_add(
    "snippets",
    lambda s, d: (lambda files: report.snippets(quality.large_files(files, 60).unionByName(security.risky_constructs(files)), files))(_corpus(s, d)),
    f"""{_with},\n{oracles.MASKED}\nSELECT r.*, {_snippet} FROM ({_large_of(60)} UNION ALL {oracles.RISKY}) r JOIN (SELECT project, path AS "filePath", string_split(content, chr(10)) AS ls FROM files) USING (project, "filePath")""",
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit events derived from the events table."""
    return _as_edits(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _as_edits(events: DataFrame) -> DataFrame:
    path = F.concat(F.lit("src/"), "event_type", F.lit("/f"), (F.col("event_id") % 7).cast("string"), F.lit(".ts"))
    other = F.concat(F.lit("src/"), "event_type", F.lit(".py"))
    payload = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.struct(path.alias("file_path"), F.array(F.struct(other.alias("file_path"))).alias("edits")).alias("tool_input"))))
    rows = events.select(F.col("user_id").alias("session"), "ts", "event_type", "event_id", payload.alias("payload"))
    return hooks.decode_events(rows)


def _micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


_add("edit_events", lambda s, d: _events(s, d).select("event_id", F.array_join("files", ",").alias("files")), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'src/' || event_type || '/f' || CAST(event_id % 7 AS VARCHAR) || '.ts,src/' || event_type || '.py' END AS files FROM events")
_add(
    "session_files",
    lambda s, d: hooks.session_files(_events(s, d)).select("session", "path", _micros("ts").alias("first_us")),
    "SELECT session, path, min(us) AS first_us FROM (SELECT user_id AS session, epoch_us(ts) AS us, unnest(['src/' || event_type || '/f' || CAST(event_id % 7 AS VARCHAR) || '.ts', 'src/' || event_type || '.py']) AS path FROM events WHERE event_id % 5 <> 0) GROUP BY 1, 2",
)
_add(
    "edits_per_window",
    lambda s, d: hooks.edits_per_window(_events(s, d)).select(_micros("start").alias("start_us"), "edits", "files"),
    "SELECT CAST(epoch_us(ts) // 600000000 * 600000000 AS BIGINT) AS start_us, count(*) AS edits, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END) AS BIGINT) AS files FROM events GROUP BY 1",
)
_by_files = lambda by: f"""SELECT {by}, {_value('files')} AS score FROM (SELECT s.*, f.files, deductions * sqrt(least(1.0, issues / (files + 20.0))) AS scaled FROM (SELECT {by}, count(*) AS issues,
    sum(CASE severity WHEN 'error' THEN 3.0 WHEN 'warning' THEN 1.0 ELSE 0.25 END::DOUBLE * ({_weights})::DOUBLE) AS deductions FROM detected GROUP BY ALL) s JOIN counted f USING (project))"""  # noqa: E731
_add(
    "baseline",
    lambda s, d: hooks.capture_baseline(_corpus(s, d)),
    f"""{_diagnostics},
detected AS (SELECT * FROM diagnostics WHERE engine <> 'architecture'),
counted AS (SELECT project, count(*) AS files FROM files GROUP BY 1)
SELECT project, 'all' AS engine, coalesce(score, 100) AS score, files FROM counted LEFT JOIN ({_by_files('project')}) USING (project) UNION ALL SELECT project, engine, score, files FROM ({_by_files('project, engine')}) JOIN counted USING (project)""",
)
_leftover_rules = " UNION ALL ".join(line_rules.rule_sql(r) for r in line_rules.RULES if r.name in ("trivial-comment", "console-leftover"))
_add("fixed_files", lambda s, d: fixes.fix_all(_written(s, d)).select("project", "path", F.sha2("content", 256).alias("sha256")), f"SELECT project, path, sha256(content) AS sha256 FROM ({oracles.fixed_sql(CORPUS_SQL, line_rules.LINES_SQL, _leftover_rules)})")
_rules_after = f"SELECT * FROM (WITH files AS (SELECT * FROM without_leftovers),\n{line_rules.LINES_SQL}\n{_leftover_rules})"
_add(
    "fix_delta",
    lambda s, d: (lambda files: report.delta(*(line_rules.detect_lines(f, ["trivial-comment", "console-leftover"]) for f in (files, fixes.fix_leftovers(files)))))(_written(s, d)),
    f"""WITH {CORPUS_SQL},\n{line_rules.LINES_SQL},\n{oracles.LEFTOVERS.format(rules=_leftover_rules)},
old AS ({_leftover_rules}), new AS ({_rules_after}), gone AS (SELECT rule, count(*) AS resolved FROM (SELECT project, "filePath", rule, message, line FROM old EXCEPT ALL SELECT project, "filePath", rule, message, line FROM new) GROUP BY 1)
SELECT rule, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after, coalesce(any_value(resolved), 0) AS resolved FROM (SELECT rule, 1 AS a, 0 AS b FROM old UNION ALL SELECT rule, 0, 1 FROM new) LEFT JOIN gone USING (rule) GROUP BY 1""",
)
_add(
    "adapter_python_linter",
    lambda s, d: adapters.python_linter(_lint_output(s, d)).select("project", "filePath", "rule", "severity", "message", "line", "fixable"),
    "SELECT source AS project, 'f' || doc_id || '.py' AS \"filePath\", 'ruff/' || CASE WHEN doc_id % 3 = 0 THEN 'E501' ELSE 'W291' END AS rule, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, text AS message, n_chars AS line, doc_id % 2 = 0 AS fixable FROM documents",
)


def _lint_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured tool output for each document."""
    item = F.struct(
        F.when(F.col("doc_id") % 3 == 0, "E501").otherwise("W291").alias("code"), F.col("text").alias("message"), F.concat(F.lit("f"), "doc_id", F.lit(".py")).alias("filename"),
        F.struct(F.col("n_chars").alias("row"), F.lit(1).alias("column")).alias("location"), F.struct(F.when(F.col("doc_id") % 2 == 0, "safe").otherwise("unsafe").alias("applicability")).alias("fix"),
    )
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("project"), F.to_json(F.array(item)).alias("output"))


_prompted = f"""{_diagnostics},
totals AS (SELECT project, "filePath", count(*) FILTER (severity = 'error') AS e, count(*) AS n FROM diagnostics GROUP BY ALL),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY e DESC, n DESC, "filePath") AS file_place FROM totals) WHERE file_place <= 20),
prompted AS (SELECT project, "filePath", file_place, place, line, rule, severity, message FROM (SELECT d.*, w.file_place, row_number() OVER (PARTITION BY project, "filePath" ORDER BY {_reported}) AS place
    FROM diagnostics d JOIN worst w USING (project, "filePath")) WHERE place <= 10)"""
_add("prompt_rows", lambda s, d: catalogue.prompt_rows(_found(s, d)), f"{_prompted}\nSELECT * FROM prompted")
_add(
    "prompts",
    _with_files(catalogue.prompts),
    f"""{_prompted},
shown AS (SELECT p.*, {_snippet} FROM prompted p JOIN (SELECT project, path AS "filePath", string_split(content, chr(10)) AS ls FROM files) USING (project, "filePath")),
by_file AS (SELECT project, "filePath", file_place, string_agg(concat_ws(chr(10), '- ' || severity || ' ' || rule || ' at line ' || line || ': ' || message, snippet), chr(10) ORDER BY place) AS t FROM shown GROUP BY ALL)
SELECT project, string_agg('## ' || "filePath" || chr(10) || t, chr(10) || chr(10) ORDER BY file_place) AS prompt FROM by_file GROUP BY 1""",
)
_add("engine_status", lambda s, d: catalogue.engine_status(_found(s, d), [("format", "not run")]), f"{_diagnostics}\nSELECT e.engine, CASE WHEN e.engine = 'format' THEN 'skipped: not run' WHEN count(d.rule) = 0 THEN 'no issues' ELSE count(d.rule) || CASE WHEN count(d.rule) = 1 THEN ' issue, ' ELSE ' issues, ' END || count(*) FILTER (severity = 'error') || CASE WHEN count(*) FILTER (severity = 'error') = 1 THEN ' error, ' ELSE ' errors, ' END || count(*) FILTER (severity = 'warning') || CASE WHEN count(*) FILTER (severity = 'warning') = 1 THEN ' warning' ELSE ' warnings' END END AS status FROM (VALUES {', '.join(f'({e!r})' for e, _ in schema.ENGINES)}) e(engine) LEFT JOIN diagnostics d USING (engine) GROUP BY 1")
_cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"
_add("rule_catalogue", lambda s, d: catalogue.rule_catalogue(s, RULES), "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_cell, r))})" for r in sorted(catalogue.rule_rows(RULES), key=str)) + ") AS t(rule, engine, severity, fixable)")
_add("page_repositories", lambda s, d: catalogue.repository_of(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")).select("page_id", "repository"), "SELECT page_id, nullif(regexp_extract(url, '^(?:git@[^:/]+:|(?:https?|ssh|git)://(?:[^@/]+@)?[^/]+/)([^/\\s]+/[^/\\s]+?)(?:\\.git)?/?$', 1), '') AS repository FROM pages")
_add("function_limits", lambda s, d: catalogue.check_limits(quality.function_rows(_written(s, d))), f"{_with},\n{oracles.FUNCTIONS}\nSELECT project, count(*) AS functions, count(*) FILTER (lines > 80 OR nesting > 5 OR params > 6) AS over FROM functions GROUP BY 1")


def _streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each session, by a stream over the events table that ends when it is read."""
    place = f"{shared_folder(spark)}/streams/{uuid.uuid4()}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hooks.write_sessions(_as_edits(events).withColumn("ts", F.col("ts").cast("timestamp")), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("session", "path")


_add("streamed_sessions", _streamed_sessions, "SELECT DISTINCT user_id AS session, unnest(['src/' || event_type || '/f' || CAST(event_id % 7 AS VARCHAR) || '.ts', 'src/' || event_type || '.py']) AS path FROM events WHERE event_id % 5 <> 0")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs, written once with a folder for each tool: a reader of one tool's outputs does not read the others'."""
    place = f"{shared_folder(spark)}/outputs/{uuid.uuid4()}"
    captured.outputs(_docs(spark, sf_dir)).write.partitionBy("tool").parquet(place)
    return spark.read.schema("project string, output string, tool string").parquet(place)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = captured.roots(_docs(spark, sf_dir))
    return discover.tool_plan(files, discover.discover(files), spark.createDataFrame([("ruff",), ("cargo",)], "binary string"))


_scripts = lambda files: files.where(F.col("ext").isin(JS))
_digests = lambda files: files.select("project", "path", F.sha2("content", 256).alias("sha256"))


def _with_unused(fix: Callable, targets: Callable) -> Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]:
    """A fix of the corpus' scripts for targets found in them."""

    def run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        files = _scripts(_corpus(spark, sf_dir))
        return fix(files, stored(targets(files)))

    return run


_removed = _with_unused(unused.remove_unused_declarations, captured.unused_in)
_renamed = _with_unused(unused.rename_unused, captured.bound_in)
_add("removed_declarations", lambda s, d: _digests(_removed(s, d)[0]), f"WITH {CORPUS_SQL},\n{captured.REMOVED_SQL}")
_add("declaration_outcomes", lambda s, d: _removed(s, d)[1].select("project", "path", "line", "name", "reason"), f"WITH {CORPUS_SQL},\n{captured.DECLARATIONS_SQL}")
_add("renamed_bindings", lambda s, d: _digests(_renamed(s, d)[0]), f"WITH {CORPUS_SQL},\n{captured.RENAMED_SQL}")
_add("binding_outcomes", lambda s, d: _renamed(s, d)[1].select("project", "path", "line", "name", "reason"), f"WITH {CORPUS_SQL},\n{captured.BINDINGS_SQL}")
_add(
    "engine_results",
    lambda s, d: (lambda files: (lambda found: report.engine_results(found[0], scan.file_counts(files), [*found[1], *scan.skipped({"format": False, "architecture": True}, False)]))(scan.isolated(files, ["ai-slop", "security"])))(_corpus(s, d)),
    f"""{_diagnostics}
SELECT project, engine, count(d.rule) AS issues, engine IN ('format', 'architecture') AS skipped, CASE engine WHEN 'format' THEN 'disabled' WHEN 'architecture' THEN 'No architecture rules' END AS reason
FROM (SELECT DISTINCT project FROM files) p CROSS JOIN (VALUES {', '.join(f'({e!r})' for e, _ in schema.ENGINES)}) e(engine) LEFT JOIN (SELECT * FROM diagnostics WHERE engine IN ('ai-slop', 'security')) d USING (project, engine) GROUP BY project, engine""",
)


def _advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advisory for each document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select(F.col("source").alias("project"), "doc_id", "n_chars")
    version = F.expr("concat('1.', n_chars % 20, '.', doc_id % 30)")
    first = F.expr("CASE doc_id % 4 WHEN 0 THEN '>=' WHEN 1 THEN ' > ' WHEN 2 THEN '<' ELSE '>= ' END")
    vulnerable = F.expr("CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '*' ELSE concat(' <2.', doc_id % 2, '.0') END")
    return rows.select("project", F.expr("concat('m', doc_id % 7)").alias("module"), vulnerable.alias("vulnerable"), F.concat(first, version).alias("patched"))


_add(
    "needed_overrides",
    lambda s, d: changes.needed_overrides(_advisories(s, d)),
    """SELECT project, key, '^1.' || max(n) // 100 || '.' || max(n) % 100 AS version FROM (SELECT source AS project, (n_chars % 20) * 100 + doc_id % 30 AS n,
    'm' || doc_id % 7 || CASE WHEN doc_id % 3 = 2 THEN '@<2.' || doc_id % 2 || '.0' ELSE '@<1.' || n_chars % 20 || '.' || doc_id % 30 END AS key FROM documents WHERE doc_id IS NOT NULL AND doc_id % 4 <> 2) GROUP BY 1, 2""",
)
_add("adapter_findings", lambda s, d: adapters.findings(_outputs(s, d)), captured.FINDINGS_SQL)
_add("unused_declarations", lambda s, d: adapters.unused_declarations(_outputs(s, d)), captured.UNUSED_SQL)
_add("discovered_projects", lambda s, d: discover.discover(captured.roots(_docs(s, d))).select("project", F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks")), captured.DISCOVERED_SQL)
_add("tool_plan", _planned, captured.PLAN_SQL)
_add("scan_with_tools", lambda s, d: scan.scan(_corpus(s, d), rules=architecture.rule_table(s, RULES), outputs=_outputs(s, d)), f"{_diagnostics}\nSELECT * FROM diagnostics UNION ALL {captured.FINDINGS_SQL}")
_add("isolated_scan", lambda s, d: scan.isolated(_corpus(s, d), ["ai-slop", "security"])[0], f"{_diagnostics}\nSELECT * FROM diagnostics WHERE engine IN ('ai-slop', 'security')")


def _stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/baselines/{uuid.uuid4()}"
    hooks.write_baseline(hooks.capture_baseline(_corpus(spark, sf_dir)), place)
    return hooks.read_baseline(spark, place)


def _session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a log of JSON lines, broken ones among them, read back."""
    place = f"{shared_folder(spark)}/sessions/{uuid.uuid4()}"
    line = F.to_json(F.struct(F.col("session").cast("string").alias("session"), _micros("ts").alias("ts"), "files"))
    _events(spark, sf_dir).select(F.when(F.size("files") == 0, "{broken").otherwise(line).alias("value")).write.text(place)
    return hooks.read_sessions(spark, place).select("session", "path", F.col("ts").alias("first_us"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each user's events; users whose events name none have their changed files."""
    named = _events(spark, sf_dir).select(F.col("session").cast("string").alias("project"), "files")
    changed = named.select("project", F.explode(F.array(F.lit("changed.ts"), F.lit("new.ts"))).alias("path")).distinct()
    return changes.edited_files(named, changed)


_add("stored_baseline", _stored_baseline, SQL["baseline"])
_add("session_log", _session_log, "SELECT CAST(session AS VARCHAR) AS session, path, first_us FROM (" + SQL["session_files"] + ")")
_add(
    "edited_files",
    _edited,
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS project, event_id, event_type FROM events), none AS (SELECT project FROM e GROUP BY 1 HAVING count(*) FILTER (event_id % 5 <> 0) = 0) "
    "SELECT DISTINCT project, unnest(['src/' || event_type || '/f' || CAST(event_id % 7 AS VARCHAR) || '.ts', 'src/' || event_type || '.py']) AS path FROM e WHERE event_id % 5 <> 0 UNION ALL SELECT project, unnest(['changed.ts', 'new.ts']) AS path FROM none",
)
