"""Risky constructs, found in code whose strings and comments are masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import Needs, has_all, matches
from codesieve.operators.masking import mask
from codesieve.operators.schema import FOUND, exploded, finding
from codesieve.operators.spots import Find, Sought, in_files, seeker
from codesieve.sources.corpus import JS

# Receivers and methods of database handles, and the constructs with their extensions.
RECEIVER = "(?:db|database|knex|client|connection|conn|pool|sql|prisma|trx|tx|sequelize|mongoose|typeorm|postgres|pg|mysql|sqlite|model|orm|datasource)"
METHOD = r"(?:query|execute|exec|raw|\$queryRaw|\$queryRawUnsafe|\$executeRaw|\$executeRawUnsafe)"
RISKY = [
    ("eval", [*JS, ".py", ".rb", ".php"], r"\beval\s*\(", "Use of eval() is a security risk"),
    ("new-function", JS, r"new\s+Function\s*\(", "Use of new Function() is similar to eval and can be a security risk"),
    ("innerhtml", [".ts", ".tsx", ".js", ".jsx"], r"\.innerHTML\s*=", "Direct innerHTML assignment can lead to XSS"),
    ("dangerously-set-innerhtml", [".tsx", ".jsx"], r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML can lead to XSS if not sanitized"),
    ("pickle-load", [".py"], r"pickle\.loads?\s*\(", "pickle.load can execute arbitrary code — unsafe deserialization"),
    ("python-exec", [".py"], r"\bexec\s*\(", "Use of exec() can execute arbitrary code"),
    ("shell-injection", [*JS, ".py"], r"(?:child_process|subprocess|os\.system|exec|spawn)\s*\([^)]*\$\{", "Possible shell injection — user input in command execution"),
    ("sql-injection", JS, rf"\b{RECEIVER}(?:\.\w+)*\.{METHOD}\s*\(?\s*`[^`]*\$\{{", "Possible SQL injection — template literal in query"),
    ("sql-injection", JS, rf"\b{RECEIVER}(?:\.\w+)*\.{METHOD}\s*\(\s*[\"'][^\"']*[\"']\s*\+", "Possible SQL injection — string concatenation in query"),
]
_DATABASE = (".query", ".exec", ".raw", ".$")
#: What code needs to match these, in their order.
NEEDS: list[Needs] = [
    (("eval",),), (("Function",),), ((".innerHTML",),), (("dangerouslySetInnerHTML",),), (("pickle.",),), (("exec",),),
    (("${",), ("child_process", "subprocess", "os.system", "exec", "spawn")), (("`",), ("${",), _DATABASE), (("+",), _DATABASE),
]
#: By construct: a part of each match that is found faster, and the characters that a match can begin with.
HINTS = [
    (r"eval\s*\(", "e"), ("", ""), ("", ""), ("", ""), ("", ""), (r"exec\s*\(", "e"), (r"(?:process|system|exec|spawn)\s*\(", "cseo"),
    (rf"\.{METHOD}\s*[(`]", "dkcpstmo"), (rf"\.{METHOD}\s*\(\s*[\"']", "dkcpstmo"),
]
MIGRATIONS = r"(?:^|/)(?:migrations|seeders|seeds|migrate)/"
#: Assignments to a template element are safe: what may stand before ``.innerHTML``.
SAFE_TARGET = r"(?i:template|tmpl|tpl)\s*\z|createElement\s*\(\s*['\"]template['\"]\s*\)\s*\z"


def _seeker() -> Find:
    """The constructs in a file's masked code; it is masked only where the unmasked text has the words that some construct needs."""
    own, needs = [frozenset(e) for _, e, _, _ in RISKY], list(NEEDS)
    find = seeker([Sought(pattern, own[k], needs[k], *HINTS[k]) for k, (_, _, pattern, _) in enumerate(RISKY)])

    def run(content: str, ext: str) -> list[tuple]:
        some = any(ext in e and has_all(content, n) for e, n in zip(own, needs, strict=True))
        return find(mask(content, ext), ext) if some else []

    return run


def risky() -> Column:
    """All risky constructs of a file (path, ext, content), as an array of findings."""
    names = [r[0] for r in RISKY]
    pick = lambda values, s: F.element_at(F.array(*[F.lit(v) for v in values]), s["k"] + 1)
    one = lambda s: finding("security", F.concat(F.lit("security/"), pick(names, s)), "error", pick([r[3] for r in RISKY], s), s["line"], "Security", False, "Use a safe alternative")
    of = lambda s, name: s["k"].isin([k for k, n in enumerate(names) if n == name])
    keep = lambda s: ~(of(s, "sql-injection") & F.coalesce(matches(F.col("path"), MIGRATIONS), F.lit(True))) & ~(of(s, "innerhtml") & _safe(s["at"]))
    return F.transform(F.filter(in_files(_seeker()), keep), one).cast(FOUND)


def risky_constructs(files: DataFrame) -> DataFrame:
    """A diagnostic for every match, generated files included."""
    return exploded(files, risky())


def _safe(at: Column) -> Column:
    """Whether an assignment is to a template element, by the 200 unmasked characters before it."""
    return F.substring(F.col("content"), F.greatest(at - 199, F.lit(1)), F.least(at, F.lit(200))).rlike(SAFE_TARGET)
