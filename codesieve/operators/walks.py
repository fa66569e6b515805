"""Detectors that walk a file's lines in order.

A walker is a small function of one file. All walkers asked for run in one Arrow pass over the files, so the
corpus crosses to Python once however many there are; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators.schema import FOUND, exploded
from codesieve.operators.spots import in_files


WALKED = "array<struct<k:int,rule:string,message:string,line:bigint>>"
_WALKED = pa.list_(pa.struct([("k", pa.int32()), ("rule", pa.string()), ("message", pa.string()), ("line", pa.int64())]))


@dataclass(frozen=True)
class Walker:
    """``find(content, ext)`` gives (rule, message, line); all findings are warnings."""

    find: Callable[[str, str], list[tuple[str, str, int]]]
    engine: str
    category: str
    fixable: bool
    help: str = ""


def found(walkers: Sequence[Walker]) -> Column:
    """The findings of all walkers in a file (ext, content), as an array."""

    def walked(content: str, ext: str) -> list[tuple]:
        return [(k, *x) for k, w in enumerate(walkers) for x in w.find(content, ext)]

    pick = lambda x, name: F.element_at(F.array(*[F.lit(getattr(w, name)) for w in walkers]), x["k"] + 1)
    one = lambda x: F.struct(*[v.alias(n) for n, v in (("engine", pick(x, "engine")), ("rule", x["rule"]), ("severity", F.lit("warning")), ("message", x["message"]), ("help", pick(x, "help")), ("line", x["line"]), ("category", pick(x, "category")), ("fixable", pick(x, "fixable")))])
    return F.transform(in_files(walked, WALKED, _WALKED), one).cast(FOUND)


def walk(files: DataFrame, walkers: Sequence[Walker]) -> DataFrame:
    """Diagnostics of all walkers."""
    return exploded(files, found(walkers))
