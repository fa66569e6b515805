"""Removal of unused declarations and renaming of unused bindings in scripts.

What is unused is a relation: (project, path, line, column, name, kind). Declarations are removed where they stand at the
top level, with the comments right above them; a variable stays if its statement declares others too or if making its
value may do something. Bindings get an underscore in front, each shape in its own way; the occurrence meant is the
nearest one to the place given, by 1000 for each line and 1 for each column, among those at most one line away.

Files are read as tokens with a tree of brackets (``tokens``). If the edited text has a bracket, string or comment that
nothing closes, where the old one had none, the file stays as it was. Unlike a parser, this takes an assignment in markup
for one that does something (the declaration stays), and deletes what stands before a declaration on its line only if it is white space.

Edge cases: a null text is an empty one; targets of files that are not there get a reason, as do all others that are not
done; repeated targets count once; a file that nothing is left of is one line break.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.operators.edits import Edits, apply_edits
from codesieve.operators.tokens import ASSIGNMENTS, CONTEXTUAL, OPERATORS, Tokens

# The words that begin declarations and stand before them, and the reasons for leaving one alone.
VARIABLES = frozenset("const let var using".split())
NAMED = frozenset("function class type interface enum".split())
MODIFIERS = frozenset("export default declare async abstract".split())
PARAMETER_MODIFIERS = frozenset("public private protected readonly override".split())
CONTROL = frozenset("if for while switch with".split())
SEVERAL, EFFECTS, NOT_FOUND, NO_FILE, BREAKS = "multi-declaration variable statement", "initializer may have side effects", "declaration not found at top level", "file not found", "removal would break file syntax"
NO_TARGET, PREFIXED, PLAIN, PATTERN, OTHER = "target node not found", "already prefixed", "unused variable binding outside parameter/destructure", "binding element context not supported", "identifier context not supported"
KINDS = ("variable", "function", "class", "type", "interface", "enum")

#: Marks after which a statement goes on in the next line, and those that a line goes on with.
_MORE = frozenset("= => , . ?. + - * / % & | ^ < > ? : && || ?? ! ~ == != === !== <= >= << >> >>> ** ( [ { ${ ...".split()) | ASSIGNMENTS
_GOES_ON = frozenset(", . ?. ? : + - * / % & | ^ = => < > && || ?? == != === !== <= >= << ** ) ] }".split()) | ASSIGNMENTS | {"(", "[", "in", "instanceof", "extends", "implements"}

REASON = "array<struct<line:bigint,column:bigint,name:string,kind:string,reason:string>>"


class Declaration(NamedTuple):
    """A statement's tokens from ``first`` to before ``stop``; of a variable (name, first token, stop token, token after its ``=`` or -1) for each one declared."""

    first: int
    stop: int
    parts: list[tuple[str, int, int, int]]
    variable: bool


def _type_arguments(t: Tokens, i: int, stop: int) -> int:
    """The token after the type arguments or parameters that a ``<`` begins; ``i`` if it compares."""
    if not (i == 0 or t.text[i - 1] in ("=", "(", ",", ":", "=>", "|", "&", "<", "function", "extends") or t.kind[i - 1] == "name" and t.end[i - 1] == t.start[i]):
        return i
    if i in t.comparing:
        return i
    depth, k, seen = 0, i, []
    while k < stop:
        if t.text[k] == "<":
            depth += 1
            seen.append(k)
        elif t.text[k] == ">":
            depth -= 1
            if not depth:
                return k + 1
        elif t.kind[k] == "number" or t.text[k] in (";", "&&", "||", "++", "--", "+", "-", "*", "/", "==", "===") or t.pair[k] >= 0 and t.pair[k] < k:
            break
        k = t.after(k)
    t.comparing.update(seen)  # what closes none of these closes none of those within
    return i


def _end_of_value(t: Tokens, i: int, stop: int, commas: bool = True) -> int:
    """The token at which a value or type that begins at ``i`` is over: a semicolon, a comma, what closes, or a line that does not go on."""
    begun = i
    while i < stop:
        text = t.text[i]
        if text == ";" or commas and text == "," or t.pair[i] >= 0 and t.pair[i] < i:
            break
        if i > begun and t.new_line(i) and t.text[i - 1] not in _MORE and not (t.kind[i - 1] == "name" and t.text[i - 1] in OPERATORS) and text not in _GOES_ON and t.kind[i] != "template":
            break
        over = _type_arguments(t, i, stop) if text == "<" else i
        i = over if over > i else t.after(i)
    return i


def _body(t: Tokens, i: int, stop: int) -> int:
    """The first brace from ``i`` on that is no type's: the body of a function or class; ``stop`` if there is none in the statement."""
    while i < stop and t.text[i] != ";":
        if t.text[i] == "{" and t.text[i - 1] not in (":", "|", "&", "=>", "<", ",", "is"):
            return i
        i = t.after(i)
    return stop


def _names(t: Tokens, i: int, word: str) -> bool:
    """Whether token ``i`` is the name that follows the word of a declaration: between ``function`` and its parameters any word is one."""
    return i < len(t) and t.kind[i] == "name" and (t.text[i] not in OPERATORS or t.text[i] in CONTEXTUAL or word == "function" and t.text[i + 1 : i + 2] in (["("], ["<"]))


def declarations(t: Tokens) -> Iterator[Declaration]:
    """The declarations at the top level, in order."""
    n, i = len(t), 0
    while i < n:
        begins = i == 0 or t.new_line(i) or t.text[i - 1] in (";", "}")
        first = i
        if begins:
            while i < n and t.text[i].startswith("@") and len(t.text[i]) > 1:  # decorators
                i += 1
                while i < n and (t.text[i] in (".", "(") or t.text[i - 1] == "."):
                    i = t.after(i)
            while i < n and t.text[i] in MODIFIERS and i + 1 < n and t.kind[i + 1] in ("name", "mark"):
                i += 1
        word = t.text[i] if begins and i < n else ""
        named = i + 1
        if word == "const" and t.text[named : named + 1] == ["enum"]:
            word, named = "enum", named + 1
        if word == "function" and t.text[named : named + 1] == ["*"]:
            named += 1
        if word in VARIABLES and named < n and (t.kind[named] == "name" or t.text[named] in ("{", "[")):
            parts, at = [], named
            while True:
                value = at
                while value < n and t.text[value] not in ("=", ";", ",") and not (value > at and t.new_line(value) and t.text[value] not in _GOES_ON and t.text[value - 1] not in _MORE):
                    over = _type_arguments(t, value, n) if t.text[value] == "<" else value
                    value = over if over > value else t.after(value)
                has = value < n and t.text[value] == "="
                end = _end_of_value(t, value + 1, n) if has else value
                parts.append((t.text[at] if t.kind[at] == "name" else "", at, end, value + 1 if has else -1))
                if end < n and t.text[end] == "," and end + 1 < n and (t.kind[end + 1] == "name" or t.text[end + 1] in ("{", "[")):
                    at = end + 1
                    continue
                break
            stop = end + 1 if end < n and t.text[end] == ";" else end
            yield Declaration(first, stop, parts, True)
            i = max(stop, i + 1)
        elif word in NAMED and _names(t, named, word):
            stop = 0
            if word == "type" and named + 1 < n and t.text[named + 1] in ("=", "<"):
                stop = _end_of_value(t, named + 1, n)
                stop += stop < n and t.text[stop] == ";"
            elif word == "function":
                at = named + 1
                at = _type_arguments(t, at, n) if at < n and t.text[at] == "<" else at
                if at < n and t.text[at] == "(" and t.pair[at] > at:
                    closed = t.pair[at] + 1
                    over = _end_of_value(t, closed, n) if closed < n and t.text[closed] == ":" else closed
                    body = _body(t, closed, n) if closed < n and (t.text[closed] == "{" or t.text[closed] == ":") else n
                    stop = t.pair[body] + 1 if body < n and t.pair[body] > body else over + (over < n and t.text[over] == ";")
            elif word in ("class", "interface", "enum"):
                body = _body(t, named + 1, n)
                stop = t.pair[body] + 1 if body < n and t.pair[body] > body else 0
            if stop:
                yield Declaration(first, stop, [(t.text[named], first, stop, -1)], False)
            i = max(stop, i + 1)
        else:
            i = t.after(i) if i < n else n


def _after_function(t: Tokens, i: int, stop: int) -> int:
    """The token after a function, arrow or method that begins at ``i``; ``i`` if none does."""
    if t.text[i] == "function":
        body = _body(t, i + 1, stop)
        return t.pair[body] + 1 if body < stop and t.pair[body] > body else i
    at = i + 1 if t.text[i] == "async" and i + 1 < stop and not t.new_line(i + 1) else i
    if at < stop and t.text[at] == "<":
        at = _type_arguments(t, at, stop)
    arrow = at + 1 if at < stop and t.kind[at] == "name" else t.pair[at] + 1 if at < stop and t.text[at] == "(" and t.pair[at] > at else stop
    if arrow < stop and t.text[arrow] == ":" and t.text[arrow - 1] == ")":  # a type before the arrow
        k = arrow + 1
        while k < stop and t.text[k] not in ("=>", ";", ",", "=", "?") and not (t.pair[k] >= 0 and t.pair[k] < k):
            k = t.after(k)
        arrow = k
    if arrow < stop and t.text[arrow] == "=>":
        body = arrow + 1
        return t.pair[body] + 1 if body < stop and t.text[body] == "{" and t.pair[body] > body else _end_of_value(t, body, stop)
    inside = t.parent[i] >= 0 and t.text[t.parent[i]] == "{"
    if inside and t.kind[i] in ("name", "string") and i + 1 < stop and t.text[i + 1] == "(" and t.pair[i + 1] > 0:
        closed = t.pair[i + 1] + 1
        if closed < stop and t.text[closed] == "{" and t.pair[closed] > closed:
            return t.pair[closed] + 1
    return i


def has_effects(t: Tokens, i: int, stop: int) -> bool:
    """Whether making the value of tokens ``i`` to ``stop`` may do something: calls, new, awaiting, deleting, assigning, counting; not in bodies of functions."""
    while i < stop:
        over = _after_function(t, i, stop)
        if over > i:
            i = over
            continue
        text, kind = t.text[i], t.kind[i]
        if kind == "name" and text in ("new", "await", "yield", "delete") and t.text[i - 1] not in (".", "?."):
            return True
        if kind == "mark" and (text in ASSIGNMENTS or text in ("++", "--")):
            return True
        value = t.is_value(i - 1) and not t.new_line(i) or i and t.text[i - 1] in ("?.", "import", "super")
        if (text == "(" and (value or t.text[i - 1] == ">" or t.text[i - 1] == "!" and t.is_value(i - 2))) or kind == "template" and value and t.source[t.start[i]] == "`":
            return True
        i += 1
    return False


def _range(t: Tokens, d: Declaration) -> tuple[int, int]:
    """The characters of a statement, with the white space before it in its line, the comments right above it and the line break after it."""
    source, start, end = t.source, t.start[d.first], t.end[d.stop - 1]
    floor = t.end[d.first - 1] if d.first else 0
    line = source.rfind("\n", 0, start) + 1
    if line >= floor and not source[line:start].strip():
        start = line
        for a, b in reversed([c for c in t.comments if floor <= c[0] and c[1] <= start]):
            between, own = source[b:start], source.rfind("\n", 0, a) + 1
            if between.strip() or between.count("\n") > 1 or own < floor or source[own:a].strip():
                break
            start = own
    end += source[end : end + 1] == "\r"
    return start, end + (source[end : end + 1] == "\n")


def remove_declarations(content: str, targets: list[tuple[int, int, str, str]]) -> tuple[str, list[str]]:
    """The text without the declarations named (line, column, name, kind), and for each the reason why it stays, or an empty one."""
    t = Tokens(content)
    found, edits, reasons = list(declarations(t)), Edits(content), []
    for line, _, name, _ in targets:
        reason = NOT_FOUND
        for d in found:
            part = next((p for p in d.parts if p[0] == name and t.line(t.start[p[1]]) <= line <= t.line(t.end[p[2] - 1])), None)
            if part is None:
                continue
            reason = SEVERAL if len(d.parts) > 1 else EFFECTS if part[3] >= 0 and has_effects(t, part[3], part[2]) else ""
            if not reason:
                edits.delete(*_range(t, d))
            break
        reasons.append(reason)
    out = edits.apply()
    if edits.accepted and not t.broken and Tokens(out).broken:
        return content, [r or BREAKS for r in reasons]
    return out if out.strip() or not edits.accepted else "\n", reasons


def _begins_function(t: Tokens, i: int) -> bool:
    """Whether the word ``function``, with a generator's star or without one, stands right before token ``i``."""
    i -= i > 0 and t.text[i - 1] == "*"
    return i > 0 and t.text[i - 1] == "function" and t.text[i - 2 : i - 1] not in (["."], ["?."])


def _is_parameters(t: Tokens, i: int) -> bool:
    """Whether a parenthesis opens the parameters of a function, arrow or method; a star before a name multiplies unless a body follows."""
    closed, j = t.pair[i] + 1, i - 1
    if j >= 0 and t.text[j] == ">":  # type parameters
        depth = 0
        while j >= 0:
            depth += (t.text[j] == ">") - (t.text[j] == "<")
            j -= 1
            if not depth:
                break
    before = t.text[j] if j >= 0 else ""
    if _begins_function(t, j + 1) or j > 0 and t.kind[j] == "name" and _begins_function(t, j):
        return True
    starred = j > 0 and t.text[j - 1] == "*"
    if before in CONTROL and not starred or closed >= len(t):
        return False
    if t.text[closed] == "=>":
        return True
    names = j >= 0 and t.kind[j] in ("name", "string") and (before not in OPERATORS or starred)
    if t.text[closed] == "{":
        return names or before == "]"
    if t.text[closed] != ":":
        return False
    k, depth = closed + 1, 0  # a type, with commas in its type arguments only
    while k < len(t) and t.text[k] != ";" and (depth or t.text[k] not in ("=>", ",", "=", "?", "{")) and not (t.pair[k] >= 0 and t.pair[k] < k):
        depth += (t.text[k] == "<") - (depth > 0 and t.text[k] == ">")
        k = t.after(k)
    return k < len(t) and (t.text[k] == "=>" or t.text[k] == "{" and names and t.kind[j] == "name")


def _is_pattern(t: Tokens, i: int) -> bool:
    """Whether a brace or bracket opens a pattern that binds names."""
    before, up = t.text[i - 1] if i else "", t.parent[i]
    if before in VARIABLES:
        return True
    if up >= 0 and t.text[up] == "(" and (before in ("(", ",", "...") or before in PARAMETER_MODIFIERS):
        return _is_parameters(t, up) or up > 0 and t.text[up - 1] == "catch"
    if before == "," and (up < 0 or t.text[up] == "{") and t.text[t.pair[i] + 1 : t.pair[i] + 2] == ["="]:
        k = i - 1
        while k >= 0 and t.parent[k] == up and t.text[k] not in (";", "{", "}") or k >= 0 and t.parent[k] != up:
            if t.text[k] in VARIABLES and t.parent[k] == up:
                return True
            k -= 1
        return False
    return up >= 0 and t.text[up] in ("{", "[") and (before in (":", "...") or t.text[up] == "[" and before in ("[", ",")) and _is_pattern(t, up)


def shape(t: Tokens, i: int) -> str:
    """How a name binds: parameter, shorthand, alias, rest, catch or array; else the reason for not renaming it."""
    before, behind, up = t.text[i - 1] if i else "", t.text[i + 1] if i + 1 < len(t) else "", t.parent[i]
    if behind == "=>" and before not in (".", "?.", ":"):
        return "parameter"
    if before in VARIABLES:
        return PLAIN
    opened = t.text[up] if up >= 0 else ""
    if opened == "(" and up > 0 and t.text[up - 1] == "catch" and before == "(":
        return "catch"
    if opened == "(" and (before in ("(", ",", "...") or before in PARAMETER_MODIFIERS) and _is_parameters(t, up):
        return "parameter"
    if opened in ("{", "[") and _is_pattern(t, up):
        if before == "...":
            return "rest"
        if opened == "[" and before in ("[", ","):
            return "array"
        if opened == "{" and before in ("{", ",") and behind != ":":
            return "shorthand"
        if opened == "{" and before == ":" and behind in (",", "}", "="):
            return "alias"
        return PATTERN
    if before == "," and behind in ("=", ";", ",", ":"):
        k = i - 1
        while k >= 0 and (t.parent[k] != up or t.text[k] not in (";", "{", "}")):
            if t.parent[k] == up and t.text[k] in VARIABLES:
                return PLAIN
            k -= 1
    return OTHER


SHAPES = ("parameter", "shorthand", "alias", "rest", "catch", "array")


def occurrences(content: str, names: set[str], lines: set[int]) -> list[dict]:
    """Where names stand in a text at most one line away from ``lines``, and how they bind there."""
    t = Tokens(content)
    near = {n + k for n in lines for k in (-1, 0, 1)}
    return [{"name": t.text[i], "line": line, "column": t.column(t.start[i]), "start": t.start[i], "shape": shape(t, i)} for i in range(len(t)) if t.kind[i] == "name" and t.text[i] in names and (line := t.line(t.start[i])) in near]


def _with_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files with an array of their targets."""
    gathered = targets.groupBy("project", "path").agg(F.array_sort(F.collect_set(F.struct("line", "column", "name", "kind"))).alias("targets"))
    return files.select("project", "path", F.coalesce("content", F.lit("")).alias("content")).join(gathered, ["project", "path"])


def remove_unused_declarations(files: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files without the declarations in ``targets`` (project, path, line, column, name, kind), and (project, path, line, column, name, kind, reason), the reason empty for what was removed."""
    wanted = targets.select("project", "path", "line", "column", "name", "kind").distinct()

    @F.pandas_udf(f"content string, outcome {REASON}")
    def run(content: pd.Series, targets: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(content, targets, strict=True):
            asked = [(x["line"], x["column"], x["name"], x["kind"]) for x in found]
            out, reasons = remove_declarations(text, asked)
            rows.append((out, [dict(zip(("line", "column", "name", "kind", "reason"), (*a, r), strict=True)) for a, r in zip(asked, reasons, strict=True)]))
        return pd.DataFrame(rows, columns=["content", "outcome"])

    done = _with_targets(files, wanted).select("project", "path", run("content", "targets").alias("done"))
    new = done.select("project", "path", F.col("done.content").alias("_new"))
    outcome = done.select("project", "path", F.explode("done.outcome").alias("o")).select("project", "path", "o.*")
    missing = wanted.join(files.select("project", "path"), ["project", "path"], "left_anti").withColumn("reason", F.lit(NO_FILE))
    edited = files.join(new, ["project", "path"], "left").withColumn("content", F.coalesce("_new", "content")).select(files.columns)
    return edited, outcome.unionByName(missing)


def nearest_occurrences(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (project, path, line, column, name, kind) with ``start`` and ``shape`` of the nearest occurrence of its name, nulls if none is near."""
    wanted = targets.select("project", "path", "line", "column", "name", "kind").distinct()

    @F.pandas_udf("array<struct<name:string,line:bigint,column:bigint,start:int,shape:string>>")
    def run(content: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([occurrences(c, {x["name"] for x in t}, {x["line"] for x in t}) for c, t in zip(content, targets, strict=True)], dtype=object)

    index = _with_targets(files, wanted).select("project", "path", F.explode(run("content", "targets")).alias("at"))
    index = index.select("project", "path", F.col("at.name").alias("name"), F.col("at.line").alias("at_line"), F.col("at.column").alias("at_column"), F.col("at.start").alias("start"), F.col("at.shape").alias("shape"))
    distance = F.abs(F.col("at_line") - F.col("line")) * 1000 + F.abs(F.col("at_column") - F.col("column"))
    found = wanted.join(index, ["project", "path", "name"], "left").withColumn("near", F.abs(F.col("at_line") - F.col("line")) <= 1)
    place = F.struct((~F.coalesce("near", F.lit(False))).alias("far"), distance.alias("distance"), "start")
    key = ["project", "path", "line", "column", "name", "kind"]
    best = found.groupBy(*key).agg(F.min_by(F.struct("near", "start", "shape"), place).alias("best"))
    near = F.coalesce(F.col("best.near"), F.lit(False))
    return best.select(*key, F.when(near, F.col("best.start")).alias("start"), F.when(near, F.col("best.shape")).alias("shape"))


def rename_unused(files: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files with an underscore before the unused names in ``targets`` (project, path, line, column, name, kind), and (project, path, line, column, name, kind, reason), the reason empty for what was renamed."""
    placed = nearest_occurrences(files, targets).join(files.select("project", "path", F.lit(True).alias("there")).distinct(), ["project", "path"], "left")
    binds = F.col("shape").isin(list(SHAPES))
    reason = F.when(F.col("there").isNull(), NO_FILE).when(F.col("shape").isNull(), NO_TARGET).when(~binds, F.col("shape")).when(F.col("name").startswith("_"), PREFIXED).otherwise("")
    judged = placed.withColumn("reason", reason)
    new = F.when(F.col("shape") == "shorthand", F.concat("name", F.lit(": _"), "name")).otherwise(F.concat(F.lit("_"), "name"))
    edits = judged.where("reason = ''").select("project", "path", "start", (F.col("start") + F.length("name")).alias("end"), new.alias("new"))
    return apply_edits(files, edits), judged.select("project", "path", "line", "column", "name", "kind", "reason")


def targets_of(unused: DataFrame) -> DataFrame:
    """Rows of ``adapters.unused_declarations`` as targets: what other tools call exports are variables here; imports are not declarations."""
    return unused.where("kind <> 'import'").withColumn("kind", F.when(F.col("kind").isin(*KINDS, "parameter"), F.col("kind")).otherwise("variable"))
