"""The scan: all detectors over one corpus, as one relation of diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.operators import adapters, architecture, file_rules, imports, line_rules, narrative, quality, schema, security, walks
from codesieve.sources.corpus import is_generated, stored

#: Detectors by engine, in order: each gives a file's findings as an array. Those of security also look at generated files.
DETECTORS: dict[str, list[Callable[[], Column]]] = {
    "code-quality": [quality.large, quality.chains, quality.duplicates],
    "ai-slop": [line_rules.found, file_rules.wrappers, file_rules.swallowed],
    "security": [file_rules.secrets, security.risky],
}

#: Walkers by engine; those of all chosen engines share one pass over the files.
WALKERS = {"code-quality": [quality.walker()], "ai-slop": [imports.WALKER, narrative.WALKER]}


def scan(files: DataFrame, engines: list[str] | None = None, rules: DataFrame | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """Diagnostics of the chosen engines (all if None): all detectors in one pass over the files, without a shuffle.

    ``rules`` are architecture rules, without which that engine is skipped; ``outputs`` (project, tool, output)
    are captured outputs of other tools, whose findings are added.
    """
    on = lambda e: engines is None or e in engines
    written = [detect() for e, detectors in DETECTORS.items() if on(e) and e != "security" for detect in detectors]
    walkers = [w for e, ws in WALKERS.items() if on(e) for w in ws]
    if walkers:
        written.append(walks.found(walkers))
    every = [detect() for detect in DETECTORS["security"]] if on("security") else []
    parts = []
    if written or every:
        own = [F.when(~is_generated(), F.concat(*written)).otherwise(schema.none())] if written else []
        parts.append(schema.exploded(files, F.concat(*own, *every)))
    if rules is not None and on("architecture"):
        parts.append(architecture.check_rules(files, rules))
    if outputs is not None:
        parts.append(adapters.findings(outputs, engines))
    return reduce(DataFrame.unionByName, parts) if parts else schema.empty(files.sparkSession)


def isolated(files: DataFrame, engines: list[str] | None = None, rules: DataFrame | None = None, outputs: DataFrame | None = None, run: Callable[..., DataFrame] = scan) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Written diagnostics, and (engine, reason) of engines that failed: those are skipped, the others count.

    All engines run in one pass; only if that fails, each runs by itself.
    """
    names = [e for e, _ in schema.ENGINES if engines is None or e in engines]
    try:
        return stored(run(files, names, rules, outputs)), []
    except Exception:  # noqa: BLE001  whatever an engine raises is its reason
        parts, failed = [schema.empty(files.sparkSession)], []
        for name in names:
            try:
                parts.append(stored(run(files, [name], rules, outputs)))
            except Exception as error:  # noqa: BLE001
                failed.append((name, str(error).strip().split("\n")[0][:200]))
        return reduce(DataFrame.unionByName, parts), failed


def skipped(engines: dict[str, bool], has_rules: bool) -> list[tuple[str, str]]:
    """(engine, reason) of engines that a scan leaves out."""
    out = [(e, "disabled") for e, on in engines.items() if not on]
    if engines.get("architecture", False) and not has_rules:
        out.append(("architecture", "No architecture rules"))
    return out


def file_counts(files: DataFrame) -> DataFrame:
    """(project, files): the number of source files of each project."""
    return files.groupBy("project").agg(F.count("*").alias("files"))
