"""String functions with the semantics of the detectors' patterns, as Spark columns and as SQL text.

Patterns are written once in the usual dialect. ``java`` and ``re2`` spell out what the engines read
differently: white space includes no-break spaces, and word boundaries are ASCII.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the detectors' patterns take it.
WHITE = r"\t\n\x0b\f\r \x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Sets of words: a text needs one of each.
Needs = tuple[tuple[str, ...], ...]
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _spell(pattern: str, boundary: str) -> str:
    out, inside = [], False
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif token == r"\S":
            out.append(f"[^{WHITE}]")
        elif token == r"\w":
            out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
        elif token == r"\b" and not inside:
            out.append(boundary)
        elif token == "." and not inside:
            out.append(r"[^\n]")
        else:
            inside = token == "[" or (inside and token != "]")
            out.append(token)
    return "".join(out)


def java(pattern: str, first: str = "") -> str:
    """The pattern for Spark. ``first`` are the characters that a match can begin with: what is asked at most places costs little then."""
    flags, rest = re.match(r"(\(\?[a-z]+\))?(.*)", _spell(pattern, _BOUNDARY).replace("(?m)", "(?md)"), re.S).groups()
    return (flags or "") + (f"(?=[{first}])" if first else "") + rest


def re2(pattern: str) -> str:
    """The pattern as a quoted SQL string for an engine with RE2."""
    return "'" + _spell(pattern, r"\b").replace("'", "''") + "'"


def compiled(pattern: str) -> re.Pattern:
    """The pattern for Python, for what walks a file's lines."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), _spell(pattern, _BOUNDARY).replace(r"\w", "[A-Za-z0-9_]")))


def native(pattern: str, first: str = "") -> re.Pattern:
    """The pattern for Python in its own ASCII classes, for whole files; ``first`` as for Spark."""
    flags, rest = re.match(r"(\(\?[a-z]+\))?(.*)", re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), _spell(pattern, r"\b")), re.S).groups()
    return re.compile((flags or "") + (f"(?=[{first}])" if first else "") + rest, re.ASCII)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


#: The characters of ``WHITE``, one by one.
SPACES = "\t\n\x0b\f\r \xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


#: Letters from the commonest on; all other characters count as rarer.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"


def _has(text: Column, word: str) -> Column:
    """Whether a text has a word. Spark compares it wherever its first character stands, so the part from its rarest one on is asked for first."""
    rare = max(range(max(1, len(word) - 1)), key=lambda k: LETTERS.find(word[k]) if word[k] in LETTERS else len(LETTERS))
    return F.contains(text, F.lit(word[rare:])) & F.contains(text, F.lit(word)) if rare else F.contains(text, F.lit(word))


def holds(text: Column, needs: Needs) -> Column:
    """Whether a text has one of each of these sets of words: what costs little and must be so before a pattern is worth a try."""
    return reduce(Column.__and__, (reduce(Column.__or__, (_has(text, word) for word in words)) for words in needs), F.lit(True))


def has_all(text: str, needs: Needs) -> bool:
    """The same inside a task."""
    for words in needs:
        for word in words:
            if word in text:
                break
        else:
            return False
    return True


def lines(content: Column) -> Column:
    """Lines of a text; a last empty line counts."""
    return F.split(content, "\n", -1)


def breaks(text: Column) -> Column:
    """How many line breaks a text has; Spark's replace, which compares at every byte, takes several times as long as its split."""
    return F.size(lines(text)) - 1


def extension(path: Column) -> Column:
    """The extension with its dot; names that begin with their only dot have none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def match_lines_sql(text: str, pattern: str) -> str:
    """All matches with their lines for the other engine: a list of structs."""
    p = re2(pattern)
    return (
        f"list_transform(range(1, len(regexp_extract_all({text}, {p})) + 1), lambda k: {{'line': CAST(1 + length(regexp_replace("
        f"array_to_string(string_split_regex({text}, {p})[1:k], '') || array_to_string(regexp_extract_all({text}, {p})[1:k-1], ''), '[^\\n]', '', 'g')) AS BIGINT), "
        f"'match': regexp_extract_all({text}, {p})[k]}})"
    )
