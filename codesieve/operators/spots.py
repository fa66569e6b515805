"""Where patterns match in whole files: all matches of many patterns, each with its line.

A small function of one file, run in Arrow batches inside tasks, beside the walkers in the same pass; the words
that a pattern needs are asked for first. What is made of the matches are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.functions.text import Needs, has_all, native

SPOTS = "array<struct<k:int,line:bigint,at:int,match:string>>"
_SPOTS = pa.list_(pa.struct([("k", pa.int32()), ("line", pa.int64()), ("at", pa.int32()), ("match", pa.string())]))
Find = Callable[[str, str], list[tuple]]


@dataclass(frozen=True)
class Sought:
    """A pattern with the extensions of its files (all if None), the words that it needs (in lower case for a pattern that takes
    either), a part of each match that is found faster and the characters that a match can begin with."""

    pattern: str
    extensions: Sequence[str] | None = None
    needs: Needs = ()
    hint: str = ""
    first: str = ""


def seeker(sought: Sequence[Sought]) -> Find:
    """A function of (content, ext) that gives all matches as (k, line, at, match), by pattern and in reading order; ``at`` counts the characters before."""
    made = [(k, s, s.pattern.startswith("(?i)"), native(s.hint), native(s.pattern, s.first)) for k, s in enumerate(sought)]

    def find(content: str, ext: str) -> list[tuple]:
        out, folded = [], None
        for k, s, either, hint, pattern in made:
            if s.extensions is not None and ext not in s.extensions:
                continue
            if either and folded is None:
                folded = content.lower()
            if not has_all(folded if either else content, s.needs) or (s.hint and not hint.search(content)):
                continue
            line, at = 1, 0
            for m in pattern.finditer(content):
                line += content.count("\n", at, m.start())
                at = m.start()
                out.append((k, line, at, m[0]))
        return out

    return find


def in_files(find: Find, kind: str = SPOTS, arrow: pa.DataType = _SPOTS) -> Column:
    """What a function of (content, ext) finds in each file, as an array."""

    @F.arrow_udf(kind)
    def run(content: pa.Array, ext: pa.Array) -> pa.Array:
        return pa.array([find(c, e) for c, e in zip(content.to_pylist(), ext.to_pylist(), strict=True)], type=arrow)

    return run(F.coalesce("content", F.lit("")), F.coalesce("ext", F.lit("")))
