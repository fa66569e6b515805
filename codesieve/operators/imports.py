"""Unused imports: symbols whose name stands on no line other than those of imports.

Statements are read by a small walk over a file's lines, in Arrow batches inside tasks; each file is judged
within its own row, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import compiled
from codesieve.operators.walks import Walker, walk
from codesieve.sources.corpus import JS

# How imports are written.
NAMESPACE, DEFAULT = compiled(r"import\s+\*\s+as\s+(\w+)\s+from"), compiled(r"import\s+(\w+)\s*(?:,\s*\{[^}]*\})?\s+from")
NAMED, NO_NAMES = compiled(r"\{([^}]+)\}"), compiled(r"import\s+(?:[\"']|type\s)")
PY_FROM, PY_IMPORT = compiled(r"from\s+[\w.]+\s+import\s+(.+)"), compiled(r"import\s+([\w.]+)(?:\s+as\s+(\w+))?")


def _local(item: str) -> str:
    """The name that an item of an import list has in the file."""
    parts = [re.sub(r"^type\s+", "", x.strip()) for x in re.split(r"\s+as\s+", item.strip())]
    return parts[1] if len(parts) > 1 else parts[0]


def js_imports(ls: list[str]) -> tuple[list[tuple[str, int]], set[int]]:
    names: list[tuple[str, int]] = []
    taken: set[int] = set()
    for i, text in enumerate(x.strip() for x in ls):
        if not text.startswith("import "):
            continue
        taken.add(i)
        if NO_NAMES.match(text):
            continue
        whole, end = text, i
        while "from" not in whole and end < len(ls) - 1:
            end += 1
            whole += " " + ls[end].strip()
            taken.add(end)
        if m := NAMESPACE.search(whole):
            names.append((m[1], i + 1))
            continue
        if (m := DEFAULT.search(whole)) and m[1] != "type":
            names.append((m[1], i + 1))
        if m := NAMED.search(whole):
            names += [(_local(x), i + 1) for x in m[1].split(",") if x.strip()]
    return names, taken


def py_imports(ls: list[str]) -> tuple[list[tuple[str, int]], set[int]]:
    names: list[tuple[str, int]] = []
    taken: set[int] = set()
    for i, text in enumerate(x.strip() for x in ls):
        if m := PY_FROM.match(text):
            taken.add(i)
            listed = re.sub(r"#.*$", "", m[1]).strip()
            if listed != "*":
                names += [(_local(x), i + 1) for x in re.sub(r"[()]", "", listed).split(",")]
        elif m := PY_IMPORT.match(text):
            taken.add(i)
            names.append(((m[2] or m[1]).split(".")[0], i + 1))
    return names, taken


def unused(content: str, ext: str) -> list[tuple[str, int]]:
    """(name, line) of the imports that no other line holds."""
    if "import" not in content:
        return []
    ls = content.split("\n")
    names, taken = js_imports(ls) if ext in JS else py_imports(ls) if ext == ".py" else ([], set())
    rest = "\n".join(x for i, x in enumerate(ls) if i not in taken)
    return [(name, line) for name, line in names if re.fullmatch(r"\w+", name, re.ASCII) and name not in rest]


def find(content: str, ext: str) -> list[tuple[str, str, int]]:
    return [("ai-slop/unused-import", f"Imported symbol '{name}' is never used", line) for name, line in unused(content, ext)]


WALKER = Walker(find, "ai-slop", "AI Slop", True, "Remove the import")


def unused_imports(files: DataFrame) -> DataFrame:
    return walk(files.where(F.col("ext").isin([*JS, ".py"])), [WALKER])
