"""Detectors that match a whole file: patterns may span lines, and every match has its line.

Matches come from one Arrow pass; findings are column expressions over a file's array of them, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import Needs, java, match_lines_sql, matches, re2, trim
from codesieve.operators.schema import FOUND, exploded, finding, let, none
from codesieve.operators.spots import Sought, in_files, seeker
from codesieve.sources.corpus import JS

# Patterns of swallowed exceptions by extension, thin wrappers, and secrets by kind.
SWALLOWED = [
    (JS, r"catch\s*\([^)]*\)\s*\{\s*(?://[^\n]*)?\s*\}", "Empty catch block swallows errors silently"),
    (JS, r"catch\s*\([^)]*\)\s*\{\s*console\.log\([^)]*\);\s*\}", "Catch block only logs error without proper handling"),
    ([".py"], r"except(?:\s+\w+)?:\s*\n\s*pass", "Bare except with pass swallows errors silently"),
    ([".py"], r"except\s+\w+(?:\s+as\s+\w+)?:\s*\n\s*print\(", "Catch block only prints error without proper handling"),
    ([".go"], r"\w+,\s*_\s*:?=\s*\w+\(", "Error return value is being ignored"),
    ([".rb"], r"rescue(?:\s+\w+)?\s*(?:=>?\s*\w+)?\s*\n\s*(?:nil|#)", "Rescue block swallows errors silently"),
    ([".java"], r"catch\s*\(\w+\s+\w+\)\s*\{\s*(?://[^\n]*)?\s*\}", "Empty catch block swallows errors silently"),
]
WRAPPERS = [
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*(?::\s*\w[^{]*)?\{\s*\n?\s*return\s+\w+\([^)]*\);\s*\n?\s*\}",
    r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*(?::\s*\w[^=]*)?\s*=>\s*\w+\([^)]*\);",
    r"(?m)def\s+(\w+)\s*\([^)]*\)(?:\s*->[^:]*)?:\s*\n\s+return\s+\w+\([^)]*\)\s*$",
]
#: What texts need to match these and the secrets below, in their order.
SWALLOWED_NEEDS: list[Needs] = [(("catch",),), (("catch",), ("console.log(",)), (("except",), ("pass",)), (("except",), ("print(",)), (("_",), ("=",), ("(",)), (("rescue",),), (("catch",),)]
WRAPPERS_NEEDS: list[Needs] = [(("function",), ("return",)), (("=>",), ("const",)), (("def",), ("return",))]
SECRETS_NEEDS: list[Needs] = [(("AKIA",),), (("PRIVATE KEY-----",),), (("eyJ",),), (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),), (("xox",),), (("://",), ("@",)), (("api",),), (("token",),), (("passw",),)]
#: By pattern: a part of each match that is found faster, and the characters that a match can begin with.
SWALLOWED_HINTS = [("", "")] * 4 + [(r",\s*_\s*:?=\s*\w+\(", "")] + [("", "")] * 2
WRAPPERS_HINTS = [(r"\{\s*return\s+\w+\(", "eaf"), (r"=>\s*\w+\(", "ec"), (r"return\s+\w+\(", "")]
_QUOTED = r"""[:=]\s*["'][^"'\s]{8}"""
SECRETS_HINTS = [("", "")] * 5 + [("", "pmr"), (_QUOTED, ""), (_QUOTED, ""), (_QUOTED, "")]
FRAMEWORK = r"^(?:setUp|tearDown|setUpClass|tearDownClass|setUpModule|tearDownModule)$|^__\w+__$"
ARROW_CALL, RETURN_CALL = r"=>\s*\w+\(([^)]*)\)\s*;?\s*$", r"return\s+\w+\(([^)]*)\)\s*;?\s*\}"
HARD_CODED = r"""['"`]\w+['"`]|(?:^|\W)\d+(?:\W|$)"""
SECRETS = [
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("Private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("JWT", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("GitHub token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("Slack token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("Database URL with credentials", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]+:[^\s:@/]+@"),
    ("API key", r"""(?i)api[_-]?key["']?\s*[:=]\s*["'][A-Za-z0-9_-]{20,}["']"""),
    ("token", r"""(?i)token["']?\s*[:=]\s*["'][A-Za-z0-9_.-]{20,}["']"""),
    ("password", r"""(?i)passw(?:or)?d["']?\s*[:=]\s*["'][^"'\s]{8,}["']"""),
]

def _spots(patterns: list[tuple[list[str] | None, str]], needs: list[Needs], hints: list[tuple[str, str]]) -> Column:
    """All matches of all patterns, each with the number of its pattern."""
    return in_files(seeker([Sought(pattern, extensions, needs[k], *hints[k]) for k, (extensions, pattern) in enumerate(patterns)]))


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)


def swallowed() -> Column:
    """The swallowed exceptions of a file (ext, content), as an array of findings."""
    one = lambda s: finding("ai-slop", "ai-slop/swallowed-exception", "error", _pick([m for _, _, m in SWALLOWED], s["k"]), s["line"], "AI Slop", False, "Handle the error")
    return F.transform(_spots([(e, p) for e, p, _ in SWALLOWED], SWALLOWED_NEEDS, SWALLOWED_HINTS), one).cast(FOUND)


def swallowed_exceptions(files: DataFrame) -> DataFrame:
    return exploded(files, swallowed())


def secrets() -> Column:
    one = lambda s: finding("security", "security/hardcoded-secret", "error", F.concat(F.lit("Possible hardcoded secret: "), _pick([n for n, _ in SECRETS], s["k"])), s["line"], "Security", False, "Read it from the environment")
    return F.transform(_spots([(None, p) for _, p in SECRETS], SECRETS_NEEDS, SECRETS_HINTS), one).cast(FOUND)


def hardcoded_secrets(files: DataFrame) -> DataFrame:
    """Secrets in unmasked text, for they stand in strings. The pattern set is built from public token formats."""
    return exploded(files, secrets())


def wrappers() -> Column:
    """The thin wrappers of a file, as an array of findings; the line before each is looked at only where there are any."""
    end = lambda p: java(p).replace("$", r"\z")

    def judged(s: Column, ls: Column) -> Column:
        text, name = s["match"], None
        for k, p in enumerate(WRAPPERS):
            one = F.regexp_extract(text, java(p), 1)
            name = F.when(s["k"] == k, one) if name is None else name.when(s["k"] == k, one)
        inner = F.when(text.rlike(end(ARROW_CALL)), F.regexp_extract(text, end(ARROW_CALL), 1)).otherwise(F.regexp_extract(text, java(RETURN_CALL), 1))
        before = F.when(s["line"] >= 2, trim(F.get(ls, s["line"].cast("int") - 2)))
        keep = ~name.rlike(end(FRAMEWORK)) & ~F.coalesce(before.startswith("@"), F.lit(False)) & ~inner.rlike(end(HARD_CODED)) & ~(matches(text, r"\buse\w+") & matches(text, r"useContext\s*\("))
        message = F.concat(F.lit("Function '"), name, F.lit("' is a thin wrapper that only calls another function"))
        return F.when(keep, finding("ai-slop", "ai-slop/thin-wrapper", "warning", message, s["line"], "AI Slop", False, "Call the inner function"))

    def all_of(spots: Column) -> Column:
        return F.when(F.size(spots) > 0, let(F.split("content", "\n", -1), lambda ls: F.filter(F.transform(spots, lambda s: judged(s, ls)), lambda f: f.isNotNull()))).otherwise(none()).cast(FOUND)

    return let(_spots([(None, p) for p in WRAPPERS], WRAPPERS_NEEDS, WRAPPERS_HINTS), all_of)


def thin_wrappers(files: DataFrame) -> DataFrame:
    return exploded(files, wrappers())


def _union_sql(patterns: list[tuple[list[str] | None, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT project, path, content, {k} AS k, unnest({match_lines_sql('content', p)}) AS s FROM files WHERE regexp_matches(content, {re2(p)})" + (f" AND ext IN ({', '.join(map(repr, e))})" if e else "") for k, (e, p) in enumerate(patterns)
    )


def _select_sql(engine: str, rule: str, severity: str, message: str, category: str, help: str, source: str, where: str = "true") -> str:
    return (
        f"SELECT project, path AS \"filePath\", '{engine}' AS engine, '{rule}' AS rule, '{severity}' AS severity, {message} AS message, '{help}' AS help, s.line AS line, CAST(0 AS BIGINT) AS \"column\", "
        f"'{category}' AS category, false AS fixable FROM ({source}) WHERE {where}"
    )


def _case(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


SWALLOWED_SQL = _select_sql("ai-slop", "ai-slop/swallowed-exception", "error", _case([m for _, _, m in SWALLOWED]), "AI Slop", "Handle the error", _union_sql([(e, p) for e, p, _ in SWALLOWED]))
SECRETS_SQL = _select_sql("security", "security/hardcoded-secret", "error", "'Possible hardcoded secret: ' || " + _case([n for n, _ in SECRETS]), "Security", "Read it from the environment", _union_sql([(None, p) for _, p in SECRETS]))
_named = "CASE k " + " ".join(f"WHEN {k} THEN regexp_extract(s.match, {re2(p)}, 1)" for k, p in enumerate(WRAPPERS)) + " END"
_inner = f"CASE WHEN regexp_matches(s.match, {re2(ARROW_CALL)}) THEN regexp_extract(s.match, {re2(ARROW_CALL)}, 1) ELSE regexp_extract(s.match, {re2(RETURN_CALL)}, 1) END"
_before = r"coalesce(regexp_matches(string_split(content, chr(10))[s.line - 1], " + re2(r"^\s*@") + "), false)"
WRAPPERS_SQL = _select_sql(
    "ai-slop", "ai-slop/thin-wrapper", "warning", f"'Function ''' || {_named} || ''' is a thin wrapper that only calls another function'", "AI Slop", "Call the inner function", _union_sql([(None, p) for p in WRAPPERS]),
    f"NOT regexp_matches({_named}, {re2(FRAMEWORK)}) AND NOT (s.line >= 2 AND {_before}) AND NOT regexp_matches({_inner}, {re2(HARD_CODED)}) AND NOT (regexp_matches(s.match, {re2(chr(92) + 'buse' + chr(92) + 'w+')}) AND regexp_matches(s.match, {re2('useContext' + chr(92) + 's*' + chr(92) + '(')}))",
)
