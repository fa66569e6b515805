"""Masking of strings and comments, so that patterns only meet code.

The mask has the length of the text and all its line breaks. It is a small state machine over a file's
text, run in Arrow batches inside tasks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.sources.corpus import JS

# What begins a string or comment, by family of languages.
FAMILIES = {**dict.fromkeys(JS, "js"), ".py": "py", ".rb": "rb", ".php": "php"}
_STARTS = {
    "js": re.compile(r"[\"'`{}]|//|/\*"),
    "py": re.compile(r"\"\"\"|'''|[\"'#]"),
    "rb": re.compile(r"[\"'#]"),
    "php": re.compile(r"[\"'#]|//|/\*"),
}
_OUTSIDE = re.compile(r"[\"'`]|//|/\*")  # braces count inside an interpolation only
_QUOTED = {q: re.compile(rf"(?:\\[\s\S]|[^\\{q}\n])*\\?({q}|\n|\Z)") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^\\`])*\\?(`|\$\{|\Z)")


def mask(content: str, ext: str) -> str:
    """The text with the insides of strings and all comments blanked; template interpolations stay."""
    family = FAMILIES.get(ext)
    if family is None:
        return content
    starts = _STARTS[family]
    out: list[str] = []
    depths: list[int] = []  # open braces in each template interpolation that is open
    at = kept = 0

    def blank(lo: int, hi: int) -> None:
        nonlocal kept
        if hi > lo:
            out.append(content[kept:lo])
            out.append(re.sub(r"[^\n]", " ", content[lo:hi]))
            kept = hi

    def template(lo: int) -> int:
        m = _TEMPLATE.match(content, lo)
        blank(lo, m.start(1))
        if m[1] == "${":
            depths.append(0)
        return m.end()

    while m := (starts if depths or family != "js" else _OUTSIDE).search(content, at):
        token, at = m[0], m.end()
        if token in ("{", "}"):
            if not depths:
                continue
            if token == "{":
                depths[-1] += 1
            elif depths[-1]:
                depths[-1] -= 1
            else:
                depths.pop()
                at = template(at)
        elif token == "`":
            at = template(at)
        elif token in ('"""', "'''"):
            end = content.find(token, at)
            blank(at, len(content) - 3 if end < 0 else end)
            at = len(content) if end < 0 else end + 3
        elif token in "\"'":
            q = _QUOTED[token].match(content, at)
            # a string that its line leaves open loses its last character's mask, as the closing quote would
            stop = q.start(1) if q[1] == token else q.start(1) - 1
            blank(at, stop)
            at = q.end() if q[1] == token else q.start(1)
        elif token == "/*":
            end = content.find("*/", at)
            end = max(at, len(content) - 1) if end < 0 else end + 2
            blank(m.start(), end)
            at = end
        else:
            end = content.find("\n", at)
            end = len(content) if end < 0 else end
            blank(m.start(), end)
            at = end
    return "".join(out) + content[kept:]


def masked(content: Column | str = "content", ext: Column | str = "ext") -> Column:
    @F.pandas_udf("string")
    def run(content: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([mask(c, e) for c, e in zip(content, ext, strict=True)], dtype=object)

    return run(F.coalesce(content, F.lit("")), F.coalesce(ext, F.lit("")))
