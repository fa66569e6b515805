"""Configuration: YAML files that extend each other, merged and checked against defaults."""

from __future__ import annotations

import copy
from pathlib import Path

from codesieve.operators.schema import ENGINES
from codesieve.plans.score import GOOD, OK, SMOOTHING

MAX_DEPTH = 5

# The defaults.
DEFAULTS = {
    "version": 1,
    "exclude": ["node_modules", ".git", "dist", "build", "coverage"],
    "engines": {name: name != "architecture" for name, _ in ENGINES},
    "quality": {"maxFunctionLoc": 80, "maxFileLoc": 400, "maxNesting": 5, "maxParams": 6},
    "security": {"audit": True, "auditTimeout": 25000},
    "scoring": {"weights": dict(ENGINES), "thresholds": {"good": GOOD, "ok": OK}, "smoothing": SMOOTHING},
    "ci": {"failBelow": 0, "format": "json"},
    "telemetry": {"enabled": False},
}
_POSITIVE = {"maxFunctionLoc", "maxFileLoc", "maxNesting", "maxParams", "auditTimeout"}


def merge(*sources: dict) -> dict:
    """Mappings are merged in depth, anything else is replaced; later sources win."""
    out: dict = {}
    for source in sources:
        for key, value in source.items():
            out[key] = merge(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def load_chain(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """A file over all that it extends. Cycles, deep chains, missing files and remote references are errors."""
    import yaml

    path = Path(path).resolve()
    if len(seen) > MAX_DEPTH:
        raise ValueError(f"extends depth exceeded {MAX_DEPTH}: {path}")
    if path in seen:
        raise ValueError(f"circular extends detected: {path}")
    if not path.exists():
        raise ValueError(f"extends target not found: {path}")
    own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    listed = own.pop("extends", None) or []
    listed = [listed] if isinstance(listed, str) else listed
    if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
        raise ValueError("`extends` must be a string or a list of strings")
    for x in listed:
        if not x.startswith(("./", "../", "/")):
            raise ValueError(f"only paths can be extended: {x}")
    return merge(*(load_chain(path.parent / x, (*seen, path)) for x in listed), own)


def _valid(given, default, key: str = "") -> bool:
    if isinstance(default, dict):
        return isinstance(given, dict) and all(_valid(given[k], default.get(k, 1.0) if key == "weights" else default[k], k) for k in given if k in default or key == "weights")
    if isinstance(default, bool) or isinstance(default, str):
        return type(given) is type(default) and (key != "format" or given == "json")
    if isinstance(default, list):
        return isinstance(given, list) and all(isinstance(x, str) for x in given)
    number = isinstance(given, (int, float)) and not isinstance(given, bool)
    return number and (key not in _POSITIVE or given > 0) and (key != "smoothing" or given >= 0)


def parse(raw) -> dict:
    """The configuration with defaults filled in; an invalid one is the defaults. Weights extend the default ones."""
    if not isinstance(raw, dict) or not _valid(raw, DEFAULTS):
        return copy.deepcopy(DEFAULTS)
    return merge(copy.deepcopy(DEFAULTS), {k: v for k, v in raw.items() if k in DEFAULTS})


def load(root: str | Path, folder: str = ".codesieve", name: str = "config.yml") -> dict:
    """The configuration of the nearest folder upwards, or the defaults."""
    import yaml

    for place in (Path(root).resolve(), *Path(root).resolve().parents):
        if (place / folder / name).exists():
            try:
                return parse(load_chain(place / folder / name))
            except (ValueError, OSError, yaml.YAMLError, AttributeError):
                break
    return copy.deepcopy(DEFAULTS)
