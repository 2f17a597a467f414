"""Configuration: typed sections read from TOML, with strict keys, types and domains."""

from __future__ import annotations

import dataclasses
import difflib
import math
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Paths left out by default, and metrics of the treemap.
DEFAULT_EXCLUDES = (
    "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/target/**",
    "**/.git/**", "**/.cartolith/**", "**/vendor/**", "**/.*/**", "**/*.min.js",
)
METRICS = ("loc", "complexity", "doc_coverage", "fan_in", "fan_out")
FILE, TABLE = "cartolith.toml", "cartolith"


class ConfigError(ValueError):
    """An unknown key, a wrong type or a value out of its domain."""


# The sections, their keys and what is usual.


@dataclass(frozen=True)
class Project:
    title: str = ""
    language: str = "en"


@dataclass(frozen=True)
class Analysis:
    include_private: bool = False
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class Graphs:
    call_depth: int = 3
    focus_depth: int = 1


@dataclass(frozen=True)
class Metrics:
    complexity_warn: int = 10
    complexity_critical: int = 20
    doc_coverage_warn: int = 60


@dataclass(frozen=True)
class Site:
    enabled: bool = True
    out: str = "cartolith-docs"
    extra_nav: tuple[str, ...] = ()
    svg_export: bool = False


@dataclass(frozen=True)
class Check:
    max_package_cycles: int = -1
    min_doc_coverage: int = -1
    max_critical_symbols: int = -1
    fail_on_new_cycles: bool = False
    fail_on_new_violations: bool = False
    fail_on_new_inferred: bool = False
    fail_on_removed_public_api: bool = False
    max_doc_coverage_drop: int = -1


@dataclass(frozen=True)
class Export:
    budget: int = 24000


@dataclass(frozen=True)
class Monorepo:
    detect: bool = True
    roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Explorer:
    enabled: bool = True
    include_source: bool = True
    default_metric: str = "complexity"


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    analysis: Analysis = field(default_factory=Analysis)
    graphs: Graphs = field(default_factory=Graphs)
    metrics: Metrics = field(default_factory=Metrics)
    site: Site = field(default_factory=Site)
    check: Check = field(default_factory=Check)
    export: Export = field(default_factory=Export)
    monorepo: Monorepo = field(default_factory=Monorepo)
    explorer: Explorer = field(default_factory=Explorer)


def _unknown(name: str, known: Iterable[str], where: str) -> ConfigError:
    near = difflib.get_close_matches(name, list(known), 1)
    return ConfigError(f"unknown {where} {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))


def _from(low: int, high: float = math.inf) -> Callable[[Any], bool]:
    return lambda x: low <= x <= high


#: The domains of settings, and how they are said.
DOMAINS: dict[str, tuple[Callable[[Any], bool], str]] = {
    "project.language": (("en", "fr").__contains__, "en or fr"),
    "graphs.call_depth": (_from(1), "1 at least"),
    "graphs.focus_depth": (_from(1), "1 at least"),
    "metrics.doc_coverage_warn": (_from(0, 100), "a per cent"),
    "check.min_doc_coverage": (_from(-1, 100), "a per cent, or -1"),
    "check.max_doc_coverage_drop": (_from(-1, 100), "points from 0 to 100, or -1"),
    "export.budget": (_from(2000), "2000 at least"),
    "explorer.default_metric": (METRICS.__contains__, f"one of {', '.join(METRICS)}"),
}


def _setting(name: str, value: Any, usual: Any) -> Any:
    """A setting's value, of the type of what is usual and within its domain; lists become tuples."""
    found = tuple(value) if isinstance(usual, tuple) and isinstance(value, list) and all(isinstance(x, str) for x in value) else value
    if type(found) is not type(usual):
        raise ConfigError(f"{name} must be {'a list of strings' if isinstance(usual, tuple) else f'of type {type(usual).__name__}'}")
    fits, domain = DOMAINS.get(name, (lambda x: True, ""))
    if not fits(found):
        raise ConfigError(f"{name} must be {domain}")
    return found


def parse(data: dict[str, Any]) -> Config:
    """The configuration of a table of sections; what it leaves out is as usual, and its excludes are added to the usual ones."""
    usual = {s: dataclasses.asdict(part) for s, part in vars(Config()).items()}
    given = []
    for section, table in data.items():
        if section not in usual:
            raise _unknown(section, usual, "section")
        if not isinstance(table, dict):
            raise ConfigError(f"{section} must be a table")
        given += [(section, key, value) for key, value in table.items()]
    for section, key, value in given:
        if key not in usual[section]:
            raise _unknown(key, usual[section], f"key of {section}")
        usual[section][key] = _setting(f"{section}.{key}", value, usual[section][key])
    usual["analysis"]["exclude"] = tuple(dict.fromkeys(DEFAULT_EXCLUDES + usual["analysis"]["exclude"]))
    return Config(**{f.name: f.default_factory(**usual[f.name]) for f in dataclasses.fields(Config)})


def load(root: str | Path, explicit: str | Path | None = None) -> Config:
    """From an explicit file, the tool's file, its table in pyproject.toml, or defaults; in this order."""
    root = Path(root)

    def read(path: Path) -> dict[str, Any]:
        try:
            return tomllib.loads(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path.name}: {e}") from e

    if explicit is not None:
        return parse(read(Path(explicit)))
    if (root / FILE).is_file():
        return parse(read(root / FILE))
    if (root / "pyproject.toml").is_file():
        return parse(read(root / "pyproject.toml").get("tool", {}).get(TABLE, {}))
    return Config()
