"""Edits of a text: ranges that are replaced, kept in order and apart from each other, applied all at once.

Every fixer collects its edits here. Ranges are positions of characters with exclusive ends. Equal edits are one,
deletions that meet or overlap become one, and an edit that overlaps an accepted one otherwise is refused; what is
accepted is applied from the back, so that positions stay those of the text before any edit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _overlap(edit: tuple[int, int, str], start: int, end: int) -> bool:
    """Whether an edit has a character in common with a range, or is an insertion inside it, or the other way round, or two are at one place."""
    if edit[0] == edit[1] or start == end:
        return edit[0] < start == end < edit[1] or start < edit[0] == edit[1] < end or edit[0] == edit[1] == start == end
    return edit[0] < end and start < edit[1]


class Edits:
    """The edits of one text."""

    def __init__(self, text: str):
        self.text = text
        self.accepted: list[tuple[int, int, str]] = []  # by start, none overlapping another
        self.gone: set[int] = set()
        self.line_starts = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]

    def replace(self, start: int, end: int, new: str) -> bool:
        """Put ``new`` in the place of a range; False if that was refused."""
        if not 0 <= start <= end <= len(self.text):
            return False
        lo = bisect_left(self.accepted, start, key=lambda e: e[1])  # the first that ends here or later
        hi = bisect_right(self.accepted, end, key=lambda e: e[0])  # those from here on begin later
        near = self.accepted[lo:hi]
        if (start, end, new) in near:
            return True
        merged = [e for e in near if not e[2] and not new and start < end]
        if any(_overlap(e, start, end) for e in near if e not in merged):
            return False
        start, end = min([start, *(e[0] for e in merged)]), max([end, *(e[1] for e in merged)])
        self.accepted[lo:hi] = sorted([*(e for e in near if e not in merged), (start, end, new)])
        return True

    def delete(self, start: int, end: int) -> bool:
        return start == end or self.replace(start, end, "")

    def delete_lines(self, first: int, last: int) -> None:
        """Delete whole lines, numbered from 0, with their breaks; a text that loses its last lines loses the break before them."""
        self.gone.update(range(first, last + 1))

    def _delete_gone(self) -> None:
        count, first = len(self.line_starts) - 1, None
        for i in [*sorted(self.gone), count + 1]:
            if first is not None and i != last + 1:
                start, end = self.line_starts[first], self.line_starts[last + 1]
                self.delete(start, end) if last + 1 < count else self.delete(max(0, start - 1), len(self.text))
                first = None
            first, last = i if first is None else first, i
        self.gone.clear()

    def apply(self) -> str:
        self._delete_gone()
        pieces, at = [], len(self.text)
        for start, end, new in reversed(self.accepted):
            pieces += [self.text[end:at], new]
            at = start
        return self.text[:at] + "".join(reversed(pieces))


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``files`` (project, path, content ...) with the ``edits`` (project, path, start, end, new) of each, the earliest first where two overlap.

    A file's edits are gathered with it, as many as its places; files without edits are as they were.
    """
    gathered = edits.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_edits"))

    @F.pandas_udf("string")
    def run(content: pd.Series, edits: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(content, edits, strict=True):
            if found is None or not len(found):
                out.append(text)
                continue
            own = Edits(text or "")
            for e in found:
                own.replace(e["start"], e["end"], e["new"])
            out.append(own.apply())
        return pd.Series(out, dtype=object)

    return files.join(gathered, ["project", "path"], "left").withColumn("content", run("content", "_edits")).select(files.columns)
