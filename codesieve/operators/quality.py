"""Size, shape and repetition of code.

File sizes, repeated chains and duplicate blocks are column expressions over the array of a file's lines, and
nothing is shuffled; function boundaries walk a file's lines in order, in Arrow batches inside tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.text import WHITE, compiled, java, lines, trim
from codesieve.operators.schema import FOUND, exploded, finding, let, none
from codesieve.operators.walks import Walker, walk
from codesieve.sources.corpus import JS

# Limits and their tolerances, window sizes, and how functions begin.
MAX_FUNCTION, MAX_FILE, MAX_NESTING, MAX_PARAMS = 80, 400, 5, 6
FUNCTION_SLACK, MARKUP_FACTOR, DATA_SHARE = 1.1, 1.5, 0.8
WINDOW, LEAST_DISTINCT, CHAIN = 10, 7, 5
#: Characters of a line that are compared before the line itself.
FIRST = 6
FUNCTIONS = [
    (JS, r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"),
    (JS, r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*(?:=>|:\s*\w)"),
    ([".py"], r"^\s*def\s+(\w+)\s*\(([^)]*)\)"),
    ([".go"], r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(([^)]*)\)"),
    ([".rs"], r"^\s*fn\s+(\w+)\s*\(([^)]*)\)"),
    ([".java", ".php"], r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)(\w+)\s*\(([^)]*)\)"),
]
CHAINED = r"^\s*\.([A-Za-z_$][\w$]*)\s*\("
LITERALS = r"\"[^\"]*\"|'[^']*'|`[^`]*`"


def large(limit: int = MAX_FILE) -> Column:
    """Whether a file (ext, content) has too many lines, as an array of findings; markup may be longer, and files of data have no limit."""
    most = F.when(F.lower("ext").isin(".jsx", ".tsx"), math.ceil(limit * MARKUP_FACTOR)).otherwise(limit)

    def judged(ls: Column) -> Column:
        full = F.filter(ls, lambda x: trim(x) != "")
        data = F.filter(full, lambda x: x.rlike(java(r"^\s*[{}\[\]\"']")))
        one = finding("code-quality", "complexity/file-too-large", "warning", F.format_string("File has %d lines (max: %d)", F.size(ls), most), F.lit(0), "Complexity", False, "Split the file")
        few = let(full, lambda x: (F.size(x) == 0) | (F.size(data) / F.greatest(F.size(x), F.lit(1)) <= DATA_SHARE))
        return F.when((F.size(ls) > most) & few, F.array(one)).otherwise(none()).cast(FOUND)

    return let(lines(F.col("content")), judged)


def large_files(files: DataFrame, limit: int = MAX_FILE) -> DataFrame:
    return exploded(files, large(limit))


def chains() -> Column:
    """Runs of calls of one method that differ in literals only, as an array of findings: one walk over a file's lines."""
    message = lambda s: F.format_string("%d consecutive `.%s()` calls that differ only in string literals. Extract a data table + loop.", s["n"], s["method"])
    state = lambda method, shape, line, n, out: F.struct(method.alias("method"), shape.alias("shape"), line.cast("long").alias("line"), n.cast("int").alias("n"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        method = F.when(F.contains(x["raw"], F.lit(".")), F.regexp_extract(x["raw"], java(CHAINED), 1)).otherwise("")
        shape = F.when(method != "", F.regexp_replace(trim(F.regexp_replace(x["raw"], LITERALS, '"L"')), java(r";\s*$").replace("$", r"\z"), "")).otherwise("")

        def moved(y: Column) -> Column:
            one = finding("code-quality", "code-quality/repeated-chained-call", "warning", message(s), s["line"], "Complexity", False, "Loop over a table")
            closed = F.when((y["method"] != s["method"]) & (s["method"] != "") & (s["n"] >= CHAIN), F.array_append(s["out"], one)).otherwise(s["out"])
            same = (y["method"] == s["method"]) & (y["shape"] == s["shape"])
            return state(y["method"], y["shape"], F.when(same, s["line"]).otherwise(x["line"]), F.when(same, s["n"] + 1).otherwise(1), closed.cast(FOUND))

        return let(F.struct(method.alias("method"), shape.alias("shape")), moved)

    def walk(ls: Column) -> Column:
        numbered = F.transform(F.array_append(ls, ""), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("raw")))
        return F.aggregate(numbered, state(F.lit(""), F.lit(""), F.lit(0), F.lit(0), none()), step, lambda s: s["out"])

    some = F.lower("ext").isin(JS) & F.col("content").rlike(java("(?m)" + CHAINED))
    return F.when(some, let(lines(F.col("content")), walk)).otherwise(none())


def repeated_chains(files: DataFrame) -> DataFrame:
    return exploded(files, chains())


def _normal(text: Column) -> Column:
    """The normalised lines of a text, by passes over the whole of it: literals and numbers alike, runs of white space one space."""
    literals = LITERALS.replace('[^"]', '[^"\n]').replace("[^']", "[^'\n]").replace("[^`]", "[^`\n]")
    blank = WHITE.replace(r"\n", "")
    text = F.regexp_replace(F.regexp_replace(text, f"(?=[\"'`])(?:{literals})", '"L"'), java(r"\b\d+(?:\.\d+)?\b", "0-9"), "0")
    return F.transform(lines(F.regexp_replace(text, f" [{blank}]+|[{blank.replace(' ', '')}][{blank}]*", " ")), lambda x: F.trim(x))


def _trivial(n: Column) -> Column:
    return (n == "") | n.isin("{", "}", "});", "},") | n.startswith("//") | n.startswith("/*") | n.startswith("*")


def _hidden(ls: Column, directive: str) -> Column:
    """For each line whether it stands in a block that follows a directive: up to where its braces close."""
    active = "array<struct<depth:int,begun:boolean>>"
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        moved = F.transform(s["active"], lambda a: F.struct((a["depth"] + count(x, "{") - count(x, "}")).alias("depth"), (a["begun"] | F.contains(x, F.lit("{"))).alias("begun")))
        open_ = F.filter(moved, lambda a: ~(a["begun"] & (a["depth"] <= 0)))
        new = F.array(F.struct(F.lit(0).alias("depth"), F.lit(False).alias("begun")))
        return F.struct(F.when(x.rlike(directive), F.concat(open_, new)).otherwise(open_).cast(active).alias("active"), F.array_append(s["out"], F.size(s["active"]) > 0).alias("out"))

    return F.aggregate(ls, F.struct(F.array().cast(active).alias("active"), F.array().cast("array<boolean>").alias("out")), step, lambda s: s["out"])


def _keys(x: Column) -> Column:
    """A hash of the window that begins at each place of an array."""
    return F.transform(F.sequence(F.lit(1), F.size(x) - WINDOW + 1), lambda k: F.xxhash64(F.slice(x, k, WINDOW)))


def _few(x: Column) -> Column:
    """Whether lines repeat often enough for a window that stands in a file twice."""
    return (F.size(x) >= 2 * WINDOW) & (F.size(x) - F.size(F.array_distinct(x)) >= WINDOW)


def _repeats(begins: Column) -> Column:
    """Whether a window of these beginnings of a file's lines stands there twice."""
    fewer = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    return let(begins, lambda x: _few(x) & let(F.transform(x, lambda one: F.xxhash64(one)), lambda h: let(_keys(h), fewer)))


def _first_words() -> Column:
    """The beginnings of a file's lines: up to the first white space, quote or digit, ``FIRST`` characters at most; lines that are equal when normalised have equal ones."""
    blank = WHITE.replace(r"\n", "")
    return F.regexp_extract_all("content", F.lit(rf"(?:\A|\n)[{blank}]*+([^\"'`0-9{WHITE}]{{0,{FIRST}}})"), F.lit(1))


def _may_repeat() -> Column:
    """Whether a window of a file repeats another if each line counts by its first word: windows that are equal when normalised do."""
    return _repeats(_first_words())


def window_pairs(tool: str = "codesieve") -> Column:
    """(line, prior) of a file's windows of ten lines that a window at least ten lines before has too, by line.

    ``prior`` is the first place of the window's normalised text in the file. A file with a note
    ``<tool>-ignore-file duplicate-block`` has none, and the block after ``<tool>-ignore-next-block`` or
    ``<tool>-ignore`` begins none. Windows are sorted by their hashes within the file's row.
    """
    pair = "array<struct<line:bigint,prior:bigint>>"
    directive = java(rf"{tool}[- ]ignore(?:-next-block|-file)?\b.*\bduplicate-block\b")
    hidden = F.when(F.col("content").rlike(directive), _hidden(lines(F.col("content")), directive)).otherwise(F.array().cast("array<boolean>"))
    mark = lambda n: F.struct(F.xxhash64(n).alias("h"), (n == "").alias("blank"), _trivial(n).alias("trivial"), n.isin("{", "}").alias("brace"))

    def pairs(y: Column, h: Column) -> Column:
        ls = y["ls"]
        starts = F.filter(F.sequence(F.lit(1), F.size(ls) - WINDOW + 1), lambda k: ~F.get(ls, k - 1)["blank"] & ~F.get(ls, k + WINDOW - 2)["blank"] & ~F.coalesce(F.get(y["hidden"], k - 1), F.lit(False)))
        full = lambda w: (F.size(F.array_distinct(w["h"])) >= LEAST_DISTINCT) & ~F.exists(w, lambda x: x["blank"]) & ~F.forall(w, lambda x: x["trivial"]) & (F.size(F.filter(w, lambda x: ~x["brace"])) >= WINDOW - 1)

        def step(s: Column, x: Column) -> Column:
            again, at, first = x["key"] == s["key"], x["line"].cast("int"), s["first"].cast("int")
            found = again & (at - first >= WINDOW) & (F.slice(h, at, WINDOW) == F.slice(h, first, WINDOW)) & full(F.slice(ls, at, WINDOW))
            return F.struct(x["key"].alias("key"), F.when(again, s["first"]).otherwise(x["line"]).alias("first"), F.when(found, F.array_append(s["out"], F.struct(x["line"].alias("line"), s["first"].alias("prior")))).otherwise(s["out"]).cast(pair).alias("out"))

        start = F.struct(F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("first"), F.array().cast(pair).alias("out"))
        sorted_ = lambda keys: F.array_sort(F.transform(starts, lambda k: F.struct(F.get(keys, k - 1).alias("key"), k.cast("long").alias("line"))))
        walk = lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.array_sort(F.aggregate(sorted_(keys), start, step, lambda s: s["out"])))
        return F.when(_few(h), let(_keys(h), walk))

    some = F.lower("ext").isin(JS) & (F.size(lines(F.col("content"))) >= 2 * WINDOW) & _may_repeat() & ~F.col("content").rlike(java(rf"{tool}[- ]ignore-file\b[^\n]*\bduplicate-block\b"))
    marked = F.transform(_normal(F.col("content")), mark)
    return F.coalesce(F.when(some, let(F.struct(marked.alias("ls"), hidden.alias("hidden")), lambda y: let(y["ls"]["h"], lambda h: pairs(y, h)))), F.array().cast(pair))


def duplicate_windows(files: DataFrame, tool: str = "codesieve") -> DataFrame:
    """(project, path, line, prior) of all repeated windows."""
    rows = files.select("project", "path", F.explode_outer(window_pairs(tool)).alias("x")).where("x IS NOT NULL")
    return rows.select("project", "path", "x.line", "x.prior")


def merged(pairs: Column) -> Column:
    """(line, prior, span) of the blocks that repeated windows make, in the order of their lines.

    A window joins the block at hand while it begins within ten lines of its beginning, here and at its first
    place; a first place that a block was reported for is not reported again.
    """
    block = "array<struct<line:bigint,prior:bigint,span:bigint>>"

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s["out"], -1)
        near = (F.size(s["out"]) > 0) & (x["line"] - last["line"] < WINDOW) & (x["prior"] - last["prior"] < WINDOW)
        longer = F.struct(last["line"].alias("line"), last["prior"].alias("prior"), F.greatest(last["span"], x["line"] + WINDOW - last["line"]).alias("span"))
        new = F.struct(x["line"].alias("line"), x["prior"].alias("prior"), F.lit(WINDOW).cast("long").alias("span"))
        known = F.exists(s["out"], lambda b: b["prior"] == x["prior"])
        out = F.when(known, s["out"]).when(near, F.array_append(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), longer)).otherwise(F.array_append(s["out"], new))
        return F.struct(out.cast(block).alias("out"))

    return F.aggregate(pairs, F.struct(F.array().cast(block).alias("out")), step, lambda s: s["out"])


def duplicates(tool: str = "codesieve") -> Column:
    """The duplicate blocks of a file, as an array of findings."""
    message = lambda b: F.format_string("%d-line block at line %d duplicates a block starting at line %d. Extract a shared helper.", b["span"], b["line"], b["prior"])
    one = lambda b: finding("code-quality", "code-quality/duplicate-block", "warning", message(b), b["line"], "Complexity", False, "Share one function")
    return F.transform(merged(window_pairs(tool)), one).cast(FOUND)


def duplicate_blocks(files: DataFrame, tool: str = "codesieve") -> DataFrame:
    return exploded(files, duplicates(tool))


@dataclass
class Function:
    name: str
    line: int
    lines: int
    nesting: int
    params: int
    template_lines: int


_functions = [(frozenset(e), compiled(p)) for e, p in FUNCTIONS]
#: Words without which a line begins no function, by the place of its pattern.
FUNCTION_WORDS = ["function", "const", "def", "func", "fn", "("]
#: Characters before a brace that tell control flow: the longest keyword and what stands before it.
KEYWORD = 8
_CONTROL = compiled(r"(?:\)|=>|\b(?:else|try|finally|do))$")
_BRACE = re.compile(r"[{}]")
_PY_CONTROL = compiled(r"\s*(?:if|for|while|with|try|except|else|elif|finally|def|class)\b")
_STATEMENT = compiled(r"(?:export\s+)?(?:const|let|var|function|class)\s")


def _rise(values: list[int]) -> Callable[[int, int], int]:
    """The greatest ``values[j] - values[i]``, i <= j, of the places from a to b: a tree of (least, most, rise) of ranges."""
    n, nothing = len(values), (math.inf, -math.inf, 0)
    tree = [nothing] * n + [(v, v, 0) for v in values]
    join = lambda a, b: (min(a[0], b[0]), max(a[1], b[1]), max(a[2], b[2], b[1] - a[0]))
    for k in range(n - 1, 0, -1):
        tree[k] = join(tree[2 * k], tree[2 * k + 1])

    def query(a: int, b: int) -> int:
        left, right, a, b = nothing, nothing, a + n, b + n + 1
        while a < b:
            if a % 2:
                left, a = join(left, tree[a]), a + 1
            if b % 2:
                b -= 1
                right = join(tree[b], right)
            a, b = a // 2, b // 2
        return int(join(left, right)[2])

    return query


def _next_below(values: list[float], wanted: list[tuple[int, float]]) -> list[int]:
    """For each (start, value) the first place from the start on that is below the value; their number if there is none."""
    n = len(values)
    asked: dict[int, list[int]] = {}
    for k, (start, _) in enumerate(wanted):
        asked.setdefault(start, []).append(k)
    out, places, least = [n] * len(wanted), [], []  # of the places from j on those with none lower or equal before them, furthest first
    for j in range(n - 1, -1, -1):
        while least and least[-1] >= values[j]:
            places.pop()
            least.pop()
        places.append(j)
        least.append(values[j])
        for k in asked.get(j, ()):
            lower = bisect_left(least, wanted[k][1])
            out[k] = places[lower - 1] if lower else n
    return out


def _braces(ls: list[str], starts: list[int]) -> list[tuple[int, int]]:
    """Last line and deepest control flow of the functions in braces that begin at these lines: one walk over the braces."""
    line_of: list[int] = []
    depth_after: list[int] = []
    control: list[int] = []  # blocks of control flow that are open after each brace
    opening: list[int] = []
    before, ends = [], []  # braces before each line, depth at its end
    stack: list[bool] = []
    depth = held = 0
    for j, text in enumerate(ls):
        before.append(len(line_of))
        for m in _BRACE.finditer(text) if "{" in text or "}" in text else ():
            if m[0] == "}":
                depth -= 1
                held -= stack.pop() if stack else 0
            else:
                p = m.start()
                while p and text[p - 1].isspace():
                    p -= 1
                depth += 1
                stack.append(bool(_CONTROL.search(text[max(0, p - KEYWORD) : p])))
                held += stack[-1]
                opening.append(len(line_of))
            line_of.append(j)
            depth_after.append(depth)
            control.append(held)
        ends.append(depth)
    before.append(len(line_of))
    first = [bisect_left(opening, before[at]) for at in starts]
    begun = [opening[k] if k < len(opening) else None for k in first]
    last = iter(_next_below(ends, [(max(at + 1, line_of[e]), depth_after[e]) for at, e in zip(starts, begun, strict=True) if e is not None]))
    rise, out = _rise(control), []
    for at, e in zip(starts, begun, strict=True):
        end = at if e is None else min(next(last), len(ls) - 1)
        out.append((end, 0 if e is None else rise(e, before[end + 1] - 1)))
    return out


def _indents(ls: list[str], starts: list[int]) -> list[tuple[int, int]]:
    """Last line and deepest control flow of the functions by indentation that begin at these lines."""
    own = [len(x) - len(x.lstrip()) if x.strip() else math.inf for x in ls]
    control: list[int] = []
    stack: list[float] = []
    for x, indent in zip(ls, own, strict=True):
        if x.strip():
            while stack and indent <= stack[-1]:
                stack.pop()
            if _PY_CONTROL.match(x):
                stack.append(indent)
        control.append(len(stack))
    rise = _rise(control)
    ends = [end - 1 for end in _next_below(own, [(at + 1, own[at] + 1) for at in starts])]
    return [(end, rise(at, end)) for at, end in zip(starts, ends, strict=True)]


def _opens_block(ls: list[str], at: int) -> bool:
    if re.search(r"=>\s*\{", ls[at]):
        return True
    if re.search(r"=>\s*$", ls[at]) and at + 1 < len(ls) and re.match(r"\s*\{", ls[at + 1]):
        return True
    for x in ls[at + 1 : at + 3]:
        if not x.strip() or _STATEMENT.match(x.strip()):
            return False
        if re.search(r"=>\s*\{", x) or re.match(r"\s*\{", x):
            return True
    return False


def _template_lines(ls: list[str]) -> Callable[[int, int], int]:
    """How many of the lines from a to before b stand in a template that begins among them."""
    odd = [0]  # parity of the quotes before each line
    for x in ls:
        odd.append(odd[-1] ^ re.sub(r"\\.?", "", x).count("`") % 2 if "`" in x else odd[-1])
    ones = [0, *accumulate(odd)]

    def count(a: int, b: int) -> int:
        if b <= a:
            return 0
        n = ones[b] - ones[a]
        return b - a - n if odd[a] else n

    return count


def functions(content: str, ext: str) -> list[Function]:
    """The functions of a file, by the way in which their first lines are written.

    All ends and depths come from one walk over the file's braces or indents, so functions that are never closed
    don't read the rest of the file again each.
    """
    own = [(k, word, pattern) for k, ((extensions, pattern), word) in enumerate(zip(_functions, FUNCTION_WORDS, strict=True)) if ext in extensions and word in content]
    if not own:
        return []
    ls, found = content.split("\n"), []
    for i, text in enumerate(ls):
        for k, word, pattern in own:
            m = word in text and pattern.match(text)
            if not m:
                continue
            if k != 1 or _opens_block(ls, i):
                found.append((i, m[1], len(m[2].split(",")) if m[2].strip() else 0))
            break
    if not found:
        return []
    indented = ext in _functions[2][0]
    inside = (lambda a, b: 0) if indented else _template_lines(ls)
    bodies = (_indents if indented else _braces)(ls, [i for i, *_ in found])
    return [Function(name, i + 1, end - i + 1, deepest, params, inside(i + 1, end)) for (i, name, params), (end, deepest) in zip(found, bodies, strict=True)]


def function_rows(files: DataFrame) -> DataFrame:
    """(project, path, name, line, lines, nesting, params, template_lines) of every function."""

    @F.pandas_udf("array<struct<name:string,line:long,lines:long,nesting:long,params:long,template_lines:long>>")
    def found(content: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([[vars(f) for f in functions(c, e)] for c, e in zip(content, ext, strict=True)], dtype=object)

    rows = files.select("project", "path", F.explode(found(F.coalesce("content", F.lit("")), F.lower(F.coalesce("ext", F.lit(""))))).alias("f"))
    return rows.select("project", "path", "f.*")


def register_functions(spark: SparkSession, name: str = "detect_functions") -> None:
    """Make a table function of SQL: ``SELECT f.* FROM files, LATERAL detect_functions(content, ext) f``."""

    @F.udtf(returnType="name string, line bigint, lines bigint, nesting bigint, params bigint, template_lines bigint", useArrow=True)
    class Detect:
        def eval(self, content: str | None, ext: str | None) -> Iterator[tuple]:
            for f in functions(content or "", (ext or "").lower()):
                yield astuple(f)

    spark.udtf.register(name, Detect)


def walker(most_lines: int = MAX_FUNCTION, most_nesting: int = MAX_NESTING, most_params: int = MAX_PARAMS) -> Walker:
    """Functions that are too long, too deep or have too many parameters."""

    def find(content: str, ext: str) -> list[tuple[str, str, int]]:
        out = []
        for f in functions(content, ext.lower()):
            if f.lines - f.template_lines > math.ceil(most_lines * FUNCTION_SLACK):
                out.append(("complexity/function-too-long", f"Function '{f.name}' has {f.lines} lines (max: {most_lines})", f.line))
            if f.nesting > most_nesting:
                out.append(("complexity/deep-nesting", f"Function '{f.name}' has nesting depth {f.nesting} (max: {most_nesting})", f.line))
            if f.params > most_params:
                out.append(("complexity/too-many-params", f"Function '{f.name}' has {f.params} parameters (max: {most_params})", f.line))
        return out

    return Walker(find, "code-quality", "Complexity", False, "Split the function")


def complex_functions(files: DataFrame, most_lines: int = MAX_FUNCTION, most_nesting: int = MAX_NESTING, most_params: int = MAX_PARAMS) -> DataFrame:
    return walk(files, [walker(most_lines, most_nesting, most_params)])
