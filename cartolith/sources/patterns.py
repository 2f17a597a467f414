"""Shell patterns of paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s:{out})$"


def excluder(patterns: Iterable[str]) -> Callable[[str], bool]:
    """A pattern fits the path; ``**/x/**`` also a folder x at any depth, other ones also the file's name."""
    whole, folders, files = [], [], []
    for p in patterns:
        inner = p.removeprefix("**/")
        whole.append(glob_regex(p))
        (folders.append(glob_regex(inner.removesuffix("/**"))) if inner.endswith("/**") else files.append(glob_regex(inner)))
    fits = [re.compile("|".join(x)) if x else None for x in (whole, folders, files)]

    def excluded(path: str) -> bool:
        *above, name = path.split("/")
        return bool(
            fits[0] and fits[0].match(path) or fits[1] and any(fits[1].match(x) for x in above) or fits[2] and fits[2].match(name)
        )

    return excluded
