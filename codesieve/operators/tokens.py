"""Tokens of a script, none lost, with the tree of its brackets.

Between tokens there is white space only. Strings end with their line, templates hold the tokens of their
interpolations, and a slash begins a regular expression where no value stands before it. Brackets pair with the
nearest open one of their kind; those without a partner are no brackets (so prose and broken code do no harm),
and ``broken`` says that there were some, or a comment, string or template that nothing closes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

_SPACE = re.compile(r"[\s﻿]+")
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)"
    r"|(?P<number>(?:\d|\.\d)[\w.]*)"
    r"|(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)"
    r"|(?P<mark>=>|\.\.\.|\?\.(?!\d)|\+\+|--|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|[-+*/%&|^]=|===|!==|==|!=|<=|&&|\|\||\?\?|\*\*|<<|[^\s])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|\Z)")

# Words of the language after which no value stands, so that a slash or parenthesis begins something.
OPERATORS = frozenset("return typeof instanceof in of new delete void throw case do else await yield as satisfies keyof extends if while for switch with catch default".split())
CONTEXTUAL = frozenset("of await yield as satisfies keyof".split())  # those that may be names as well
ASSIGNMENTS = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, frozenset(")]}")


class Tokens:
    """Lists of equal length: ``kind``, ``text``, ``start``, ``end`` and ``pair`` (the partner of a bracket, else -1); comments stand apart."""

    def __init__(self, source: str):
        self.source = source
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.comments: list[tuple[int, int]] = []
        self.broken = False
        self.comparing: set[int] = set()  # marks known to begin no type arguments
        self._lines = [0, *accumulate(len(x) + 1 for x in source.split("\n"))]
        self._read()
        self._tree()

    def __len__(self) -> int:
        return len(self.kind)

    def line(self, at: int) -> int:
        """The line of a position, from 1."""
        return bisect_right(self._lines, at)

    def column(self, at: int) -> int:
        """The column of a position, from 1."""
        return at - self._lines[self.line(at) - 1] + 1

    def is_value(self, i: int) -> bool:
        """Whether token ``i`` ends a value."""
        return i >= 0 and (self.kind[i] in ("string", "number", "regex", "template") or self.text[i] in (")", "]", "}") or self.kind[i] == "name" and self.text[i] not in OPERATORS)

    def new_line(self, i: int) -> bool:
        """Whether token ``i`` is the first of its line."""
        return i == 0 or self.line(self.start[i]) != self.line(self.end[i - 1])

    def _add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.text.append(self.source[start:end])
        self.start.append(start)
        self.end.append(end)

    def _read(self) -> None:
        source, at = self.source, 0
        depths: list[int] = []  # open braces in each interpolation that is open
        while True:
            if m := _SPACE.match(source, at):
                at = m.end()
            if at >= len(source):
                break
            c = source[at]
            if c == "`":
                at = self._template(at, at + 1, depths)
                continue
            if c == "}" and depths and not depths[-1]:
                depths.pop()
                self._add("mark", at, at + 1)
                at = self._template(at + 1, at + 1, depths)
                continue
            if c == "/" and source[at + 1 : at + 2] not in ("/", "*") and not self.is_value(len(self) - 1) and (m := _REGEX.match(source, at)):
                self._add("regex", at, m.end())
                at = m.end()
                continue
            m = _TOKEN.match(source, at)
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append((at, m.end()))
                self.broken |= c == "/" and m[0].startswith("/*") and (len(m[0]) < 4 or not m[0].endswith("*/"))
            else:
                self._add(kind, at, m.end())
                if kind == "string":
                    self.broken |= len(m[0]) < 2 or m[0][-1] != c
                if depths and c in "{}":
                    depths[-1] += 1 if c == "{" else -1
            at = m.end()
        self.broken |= bool(depths)

    def _template(self, start: int, at: int, depths: list[int]) -> int:
        m = _TEMPLATE.match(self.source, at)
        if m[1] == "${":
            self._add("template", start, m.start(1))
            self._add("mark", m.start(1), m.end())
            depths.append(0)
        else:
            self._add("template", start, m.end())
            self.broken |= not m[1]
        return m.end()

    def _tree(self) -> None:
        n = len(self)
        self.pair, self.parent = [-1] * n, [-1] * n
        opened: list[int] = []
        waiting = {")": 0, "]": 0, "}": 0}  # open brackets by what closes them
        for i in range(n):
            mark = self.text[i] if self.kind[i] == "mark" else ""
            if mark in _OPEN:
                opened.append(i)
                waiting[_OPEN[mark]] += 1
            elif mark in _CLOSE and waiting[mark]:
                while _OPEN[self.text[opened[-1]]] != mark:
                    waiting[_OPEN[self.text[opened.pop()]]] -= 1
                    self.broken = True
                waiting[mark] -= 1
                self.pair[i] = opened.pop()
                self.pair[self.pair[i]] = i
            elif mark in _CLOSE:
                self.broken = True
        self.broken |= bool(opened)
        around: list[int] = []
        for i in range(n):
            if self.pair[i] >= 0 and self.pair[i] < i:
                around.pop()
            self.parent[i] = around[-1] if around else -1
            if self.pair[i] > i:
                around.append(i)

    def after(self, i: int) -> int:
        """The token after ``i``, or after its partner if it opens a bracket."""
        return max(i, self.pair[i]) + 1
