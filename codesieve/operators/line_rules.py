"""Detectors that look at one line and its successor.

A rule is a list of conditions on fields of a line. Lines with words that a rule needs
come from one Arrow pass; all rules are judged within a file's row, over the array of these, so the corpus is read once, only
findings become rows and nothing is shuffled. The same conditions give the SQL by which another engine checks the results.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import SPACES, Needs, has_all, java, lines, native, re2, trim
from codesieve.operators.schema import FOUND, exploded, finding, let
from codesieve.operators.spots import Find, in_files
from codesieve.sources.corpus import JS

TS = [".ts", ".tsx"]

# Word lists and patterns of the rules.
STEMS = (
    r"Import|Defin|Initializ|Setting|Set\s+up|Setup|Return|Check|Loop|Iterat|Creat|Updat|Delet|Remov|Handl|Get|Fetch|Increment|Decrement|Writ|Runn|Run|Pars|Execut|Extract|"
    r"Sav|Load|Build|Start|Stopp|Stop|Clean(?:up|\s+up)?|Configur|Validat|Process|Queue|Fire|Emit|Dispatch|Log|Print|Render"
)
JS_TRIVIAL = rf"\s*(?:This (?:function|method|class|variable|constant) |(?:{STEMS})(?:e|es|ing|s)?\b)"
PY_TRIVIAL = rf"\s*(?:This (?:function|method|class) |(?:{STEMS})(?:e|es|ing|s)?\b)"
EXPLAINS = r"(?i)\b(?:because|since|note|todo|fixme|hack|warn|warning|workaround|caveat|important|assumes?)\b"
DECLARED = r"(?:const|let|var|function|def|func|fn)\s+(\w+)"
GENERIC = r"(?i:(?:helper|util|handler|process|do|handle|execute|perform)_?\d+)|(?:data|temp|result|value|item|obj|arr|str|num|val)\d+"
LOGGER_FILE = r"(?i)(?:^|/)(?:logger|logging|log)\.[^/]+$"
SCRIPT_DIR = r"(?:^|/)(?:scripts|bin)/"
MARKERS = r"\b(?:TODO|FIXME|HACK|XXX)\b[:\s]|\b(?:TEMP|PLACEHOLDER|STUB)[:\s]"
UNREACHABLE_NEXT = r"^(?:\}|//|/\*|case |default:|if |if\(|else)"
CONSTANT = r"\bif\s*\(\s*(?:false|true|0|1)\s*\)"


@dataclass(frozen=True)
class Rule:
    """Conditions are (field, pattern, wanted); fields: t trimmed, n next trimmed, raw, path, body, name, code. ``needs`` are words without which no line can fulfil them."""

    name: str
    severity: str
    message: str
    conditions: tuple[tuple[str, str, bool], ...]
    extensions: tuple[str, ...] = ()
    shift: int = 0
    fixable: bool = False
    help: str = ""
    needs: Needs = ()


_COMMENT = ("t", r"^(?://|\*)", False)
_BUILDS_REGEX = (("t", r"\bRegExp\b|/.*\\b", False), ("t", r"""["'`].*\\b.*["'`]""", False))

RULES = [
    Rule(
        "trivial-comment", "warning", "Trivial comment that restates the code",
        (("t", r"^(?://|#(?:[^!]|$))", True), ("body", r"^.{61}", False), ("body", EXPLAINS, False), ("body", r"[({=;}\]>]", False), ("body", r"[─━═╌╍┄┅│┃]|^-{3,}", False),
         ("n", r"^$", False), ("t", rf"(?i)^//{JS_TRIVIAL}|^///+{JS_TRIVIAL}|^//.*//{JS_TRIVIAL}|^#{PY_TRIVIAL}", True)),
        fixable=True, help="Say why, or leave the comment out", needs=(("//", "#"),),
    ),
    Rule("generic-naming", "info", "'{name}' uses generic AI-style naming", (("name", GENERIC, True),), help="Name what the value is for", needs=(("const", "let", "var", "func", "def", "fn"), tuple("0123456789"))),
    Rule(
        "console-leftover", "warning", "console.log/debug/info statement left in production code",
        (_COMMENT, ("t", r"\bconsole\.(?:log|debug|info|trace|dir|table)\s*\(", True), ("t", r"console\.(?:error|warn)\s*\(", False), ("t", r"console\.log\(\s*JSON\.stringify\b", False),
         ("path", LOGGER_FILE, False), ("path", SCRIPT_DIR, False)),
        tuple(JS), fixable=True, help="Use a logger", needs=(("console.",),),
    ),
    Rule("todo-stub", "info", "Unresolved TODO/FIXME/HACK comment indicates incomplete code", (("t", r"^(?://|#|\*|/\*)", True), ("t", MARKERS, True)), help="Finish it or track it", needs=(("TODO", "FIXME", "HACK", "XXX", "TEMP", "PLACEHOLDER", "STUB"),)),
    Rule("unreachable-code", "warning", "Code after return/throw statement is unreachable", (("t", r"^(?:return|throw)\b", True), ("t", r";$", True), ("n", r".", True), ("n", UNREACHABLE_NEXT, False)), tuple(JS), 1, help="Remove it", needs=(("return", "throw"), (";",))),
    Rule("constant-condition", "warning", "Conditional with a constant value — likely debugging leftover", (("t", CONSTANT, True), _COMMENT, ("t", r"""["'`].*\bif\s*\(""", False), ("code", r"/.*\bif\s*\(", False)), help="Remove the condition", needs=(("(",), ("if",))),
    Rule("empty-function", "info", "Empty function body — possible stub or unfinished implementation", (("t", r"(?:function\s+\w+|=>\s*)\s*\{\s*\}\s*;?\s*$", True), ("t", r"^(?:interface|type )", False)), tuple(JS), help="Write it or say why it is empty", needs=(("{",), ("}",), ("function", "=>"))),
    Rule("ts-directive", "info", "@ts-ignore/@ts-expect-error suppresses type checking — review if still needed", (("t", r"(?://|/\*)\s*@ts-(?:ignore|expect-error)", True),), tuple(TS), help="Mend the types", needs=(("@ts-",),)),
    Rule("unsafe-type-assertion", "warning", "'as any' bypasses type safety", (_COMMENT, *_BUILDS_REGEX, ("t", r"\bas\s+any\b", True)), tuple(TS), help="Use a type that holds", needs=(("any",), ("as",))),
    Rule("double-type-assertion", "warning", "Double type assertion (as unknown as X) bypasses type checking", (_COMMENT, *_BUILDS_REGEX, ("t", r"\bas\s+unknown\s+as\s+", True), ("t", r"\.query[(<]|result\[0\]|rows\s", False)), tuple(TS), help="Use a type that holds", needs=(("unknown",), ("as",))),
]


#: Signs, one of which every rule but those of type assertions needs.
SIGNS = "[/#*0-9;({]"


ASKED = "array<struct<line:bigint,raw:string,t:string,n:string,may:int>>"
_ASKED = pa.list_(pa.struct([("line", pa.int64()), ("raw", pa.string()), ("t", pa.string()), ("n", pa.string()), ("may", pa.int32())]))


def _asked(rules: list[Rule]) -> Find:
    """A function of (content, ext) that gives the lines with words that a rule needs, trimmed as the next one is; ``may`` has a bit for each such rule."""
    rarest = lambda needs: sorted(needs, key=lambda words: -min(map(len, words)))
    signs, given = native(SIGNS), [(1 << k, frozenset(r.extensions), r.needs, rarest(r.needs)) for k, r in enumerate(rules)]

    def find(content: str, ext: str) -> list[tuple]:
        own = [(bit, needs) for bit, extensions, every, needs in given if (not extensions or ext in extensions) and has_all(content, every)]
        if not own:
            return []
        ls, may = content.split("\n"), {}
        starts = list(accumulate((len(x) + 1 for x in ls), initial=0))
        for bit, needs in own:
            if not needs:
                may.update((i, may.get(i, 0) | bit) for i in range(len(ls)))
                continue
            for word in needs[0]:
                at = content.find(word)
                while at >= 0:
                    i = bisect_right(starts, at) - 1
                    if has_all(ls[i], needs[1:]):
                        may[i] = may.get(i, 0) | bit
                    at = content.find(word, starts[i + 1])
        typed, out = ext in TS, []
        for i in sorted(may):
            raw = ls[i]
            if signs.search(raw) or (typed and "as" in raw):
                out.append((i + 1, raw, raw.strip(SPACES), ls[i + 1].strip(SPACES) if i + 1 < len(ls) else None, may[i]))
        return out

    return find


def _fires(rule: Rule, fields) -> Column:
    """Whether a line that has what the rule needs fulfils its conditions."""
    out = F.lit(True)
    for field, pattern, wanted in rule.conditions:
        hit = F.coalesce(fields(field).rlike(java(pattern).replace("$", r"\z")), F.lit(False))
        out = out & (hit if wanted else ~hit)
    return out


def _with_next(ls: Column) -> Column:
    """(line, raw, next) of each line."""
    return F.transform(ls, lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("raw"), F.get(ls, i + 1).alias("next")))


def source_lines(files: DataFrame) -> DataFrame:
    """(project, path, ext, line, raw, t, n): the lines of each file, with the next line beside each."""
    rows = files.select("project", "path", "ext", F.explode_outer(let(lines(F.col("content")), _with_next)).alias("x")).where("x IS NOT NULL")
    return rows.select("project", "path", "ext", "x.line", "x.raw", trim(F.col("x.raw")).alias("t"), trim(F.col("x.next")).alias("n"))


def found(names: list[str] | None = None) -> Column:
    """The line rules' findings of a file (path, ext, content), as an array; only lines with words that a rule needs are trimmed and judged."""
    rules = [r for r in RULES if names is None or r.name in names]

    def judged(y: Column) -> Column:
        made = {"body": trim(F.regexp_replace(y["t"], r"^(//|#)", "")), "code": F.regexp_replace(y["t"], r"//[^\n]*\z", ""), "path": F.col("path"), "name": F.regexp_extract(y["raw"], java(DECLARED), 1)}
        field = lambda name: made[name] if name in made else y[name]
        one = lambda r: finding("ai-slop", f"ai-slop/{r.name}", r.severity, F.replace(F.lit(r.message), F.lit("{name}"), made["name"]) if "{name}" in r.message else r.message, y["line"] + r.shift, "AI Slop", r.fixable, r.help)
        may = lambda k: y["may"].bitwiseAND(1 << k) != 0
        return F.filter(F.array(*[F.when(may(k) & _fires(r, field), one(r)) for k, r in enumerate(rules)]), lambda f: f.isNotNull())

    return F.flatten(F.transform(in_files(_asked(rules), ASKED, _ASKED), judged)).cast(FOUND)


def detect_lines(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Diagnostics of the line rules."""
    return exploded(files, found(names))


_LINES_SQL = r"""ls AS (SELECT project, path, ext, content, string_split(content, chr(10)) AS a FROM files),
numbered AS (SELECT project, path, ext, unnest(generate_series(1, len(a))) AS i, unnest(a) AS raw, unnest(list_append(a[2:], NULL)) AS nx FROM ls),
lines AS (SELECT project, path, ext, CAST(i AS BIGINT) AS line, raw, regexp_replace(raw, TRIM, '', 'g') AS t, regexp_replace(nx, TRIM, '', 'g') AS n FROM numbered),
fields AS (SELECT *, regexp_extract(raw, DECLARED, 1) AS name, regexp_replace(regexp_replace(t, '^(//|#)', ''), TRIM, '', 'g') AS body, regexp_replace(t, '//[^\n]*$', '') AS code FROM lines)"""
LINES_SQL = _LINES_SQL.replace("TRIM", re2(r"^\s+|\s+$")).replace("DECLARED", re2(DECLARED))


def rule_sql(rule: Rule) -> str:
    """A SELECT of the rule's diagnostics from ``fields``."""
    where = [f"ext IN ({', '.join(repr(x) for x in rule.extensions)})"] if rule.extensions else []
    for field, pattern, wanted in rule.conditions:
        where.append(f"{'' if wanted else 'NOT '}coalesce(regexp_matches({field}, {re2(pattern)}), false)")
    message = "replace('" + rule.message.replace("'", "''") + "', '{name}', name)"
    return (
        f"SELECT project, path AS \"filePath\", 'ai-slop' AS engine, 'ai-slop/{rule.name}' AS rule, '{rule.severity}' AS severity, {message} AS message, '{rule.help}' AS help, "
        f"line + {rule.shift} AS line, CAST(0 AS BIGINT) AS \"column\", 'AI Slop' AS category, {'true' if rule.fixable else 'false'} AS fixable FROM fields WHERE {' AND '.join(where)}"
    )
