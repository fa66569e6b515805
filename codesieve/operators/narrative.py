"""Narrative comments: blocks of comments that tell what code does, or decorate it.

A walk over a file's lines gathers blocks; an ordered list of reasons judges each one. It runs in Arrow
batches inside tasks, each file on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import compiled
from codesieve.operators.walks import Walker, walk
from codesieve.sources.corpus import EXTENSIONS, JS

# Comment marks by extension, phrases, and how declarations begin.
MARKS = {**dict.fromkeys([*JS, ".go", ".rs", ".java"], ("//",)), ".py": ("#",), ".rb": ("#",), ".php": ("//", "#")}
SEPARATOR = compiled(r"[-=─━~_*#]{6,}$|[-=─━~_*#]{3,}.+?[-=─━~_*#]{3,}$")
SECTION = compiled(r"(?i)(?:Phase|Step|Section|Part)\s+\d+[:.-]")
REFERENCES = compiled(
    r"(?i)\b(?:will then be|used by|called from|called later|see (?:above|below|later|earlier)|replaces the|matches the one|we moved|we used to|refactor(?:ed)? from)\b|\bcombined with\b.*\bthis\b"
)
JUSTIFIES = compiled(r"(?i)The idea here|The trick is|This was needed|Originally,?")
EXPLAINS = compiled(r"(?:Matches|Detects|Represents|Holds|Stores|Tracks|Handles|Manages|Controls|Contains|Captures|Encapsulates|Wraps|Describes)\s+[A-Za-z`'\"]")
WHY = compiled(
    r"(?i)\b(?:because|since|otherwise|workaround|caveat|warning|important|assumes?|note:|bug|issue|see\s+(?:issue|above|below)|in\s+prod|in\s+production|breaks?\s+when|fails?\s+when|"
    r"must\s+run|must\s+be|has\s+to\s+be|hack\s+for|fix\s+for|reason:)\b"
)
TAGS = frozenset(
    "deprecated see example type returns return param throws typedef callback override template internal public private protected experimental alpha beta since todo link license preserve swagger "
    "openapi route group summary description operationid response responses request requestbody security tag tags path body query queryparam header headers produces accept middleware api apiname "
    "apidefine apigroup apiparam apiquery apibody apiheader apisuccess apierror apiexample apiversion apidescription apipermission apiuse apiignore apiprivate namespace category".split()
)
DIRECTIVE = compiled(r"\b(?:biome-ignore|eslint-disable|ts-ignore|ts-expect-error|@ts-\w+|noqa|pylint:\s*disable|rubocop:disable|noinspection|phpcs:disable)\b")
DECLARES = compiled(r"\s*(?:export\s+)?(?:async\s+)?(?:const|let|var|function|class|type|interface|enum|abstract\s+class)\s+|\s*export\s+default\b")
DECLARES_BY = {
    **dict.fromkeys(JS, compiled(r"\s*(?:(?:readonly|static|public|private|protected|abstract|override)\s+)*[\w$]+\??\s*:")),
    ".py": compiled(r"\s*(?:async\s+def|def|class)\s+"),
    ".go": compiled(r"\s*(?:func|type|var|const)\s+"),
    ".rs": compiled(r"\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|const|static|type|mod)\s+"),
    ".rb": compiled(r"\s*(?:class|module|def)\s+"),
    ".java": compiled(r"\s*(?:public|private|protected|static|final|abstract|sealed|non-sealed|\s)+(?:class|interface|enum|record|@interface|\w[^(){};=]*\s+\w+\s*\()|\s*(?:class|interface|enum|record|@interface)\s+"),
    ".php": compiled(r"\s*(?:public|private|protected|static|final|abstract|readonly\s+)*(?:function|class|interface|trait|enum|const)\s+"),
}
LABEL = compiled(r"[A-Z][A-Za-z0-9 ]{1,28}$")
DATA = compiled(r"\s*(?:[{\[\"'`]|case\s|\w+:\s|\d\w*\s*:)")


@dataclass
class Block:
    doc: bool
    line: int
    raw: list[str]
    prose: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    after: str | None = None


def _doc_text(text: str) -> str:
    text = re.sub(r"\s*\*+/\s*$", "", re.sub(r"^\s*/\*\*+\s?", "", text))
    return re.sub(r"^\s*\*\s?", "", text).strip()


def _kinds(ls: list[str], marks: tuple[str, ...]) -> Iterator[tuple[bool, int] | None]:
    """For each line whether it is of a doc comment, and of which one; none for code."""
    number, inside = 0, False
    for x in ls:
        text = x.strip()
        opens = not inside and text.startswith("/**")
        if not inside and text.startswith(marks) and not text.startswith("#!"):
            yield (False, 0)
        elif inside or opens:
            number += opens
            inside = not text.endswith("*/")
            yield (True, number)
        else:
            yield None


def blocks(ls: list[str], ext: str) -> list[Block]:
    """The comment blocks of a file, in order: islands of lines of one kind."""
    islands, kind, first = [], None, 0
    for i, own in enumerate((*_kinds(ls, MARKS.get(ext, ())), None)):
        if own != kind:
            if kind is not None:
                islands.append((kind, first, i))
            kind, first = own, i
    out = []
    for kind, first, end in islands:
        raw = ls[first:end]
        text = [_doc_text(x) for x in raw] if kind[0] else [re.sub(r"^\s*(?://|#)\s?", "", x) for x in raw]
        prose = [x for x in text if x and not x.startswith("@")] if kind[0] else text
        tags = [m[1].lower() for x in text if (m := re.match(r"@(\w+)", x))] if kind[0] else []
        out.append(Block(kind[0], first + 1, raw, prose, tags, next((ls[k] for k in range(end, len(ls)) if ls[k].strip()), None)))
    return out


def _before_declaration(block: Block, ext: str) -> bool:
    return block.after is not None and bool(DECLARES.match(block.after) or (ext in DECLARES_BY and DECLARES_BY[ext].match(block.after)))


def reason(block: Block, ext: str) -> str | None:
    """Why a block is narrative, by the first reason that holds."""
    prose, full = block.prose, sum(bool(x) for x in block.prose)
    head = " ".join(block.raw).lower()
    if block.line == 1 and ("copyright" in head or "license" in head):
        return None
    if any(DIRECTIVE.search(x) for x in block.raw) or (block.doc and TAGS.intersection(block.tags)):
        return None
    if not block.doc and any(SEPARATOR.match(x) for x in prose):
        return "decorative separator"
    if not block.doc and any(SECTION.match(x) for x in prose):
        return "phase/section header"
    if not block.doc and len(prose) == 1 and LABEL.match(prose[0]) and len(prose[0].split()) <= 3 and not (block.after is not None and DATA.match(block.after)):
        return "bare section label"
    if len(prose) >= 3 and _before_declaration(block, ext):
        return "JSDoc preamble before declaration" if block.doc else "multi-line preamble before declaration"
    if REFERENCES.search(" ".join(prose)):
        return "cross-reference commentary"
    if not block.doc and any(JUSTIFIES.match(x) for x in prose):
        return "justification prose"
    if not block.doc and len(block.raw) == 1 and EXPLAINS.match(prose[0]) and _before_declaration(block, ext):
        return "explanatory preamble"
    if full >= 5:
        return "long narrative block"
    if full >= 3 and not block.doc and not WHY.search(" ".join(prose)):
        return "multi-line narrative prose"
    return None


def narrative_blocks(content: str, ext: str) -> list[tuple[int, int, str]]:
    """(first line, last line, reason) of the narrative blocks."""
    if not any(x in content for x in ("/**", *MARKS.get(ext, ()))):
        return []
    return [(b.line, b.line + len(b.raw) - 1, why) for b in blocks(content.split("\n"), ext) if (why := reason(b, ext))]


def find(content: str, ext: str) -> list[tuple[str, str, int]]:
    return [("ai-slop/narrative-comment", f"Narrative comment block ({why})", line) for line, _, why in narrative_blocks(content, ext)] if ext in EXTENSIONS else []


WALKER = Walker(find, "ai-slop", "Comments", True, "Remove the comment")


def narrative_comments(files: DataFrame) -> DataFrame:
    return walk(files.where(F.col("ext").isin(EXTENSIONS)), [WALKER])
