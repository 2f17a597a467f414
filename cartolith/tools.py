"""Tools for assistants: eight questions about one graph, answered as JSON, a line each over standard streams."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, TextIO

from cartolith.operators import deadcode, flow, lookup, render
from cartolith.plans.graph import Graph

CALLABLE = ("function", "method", "class", "module")


class Tools:
    """The questions; ``read`` makes the graph anew for ``reload``."""

    def __init__(self, read: Callable[[], Graph]) -> None:
        self.read = read
        self.graph = read()

    def _one(self, symbol: str, kinds: tuple[str, ...] = lookup.SYMBOLS) -> tuple[str | None, dict | None]:
        found = [r["id"] for r in lookup.candidates(self.graph, symbol, kinds).select("id").orderBy("id").collect()]
        if len(found) == 1:
            return found[0], None
        return None, {"error": f"symbole {'ambigu' if found else 'introuvable'} : {symbol}", "candidates": found}

    def overview(self) -> dict:
        return render.overview(self.graph)

    def search_symbol(self, query: str, limit: int = lookup.TOOL_LIMIT) -> dict:
        rows = lookup.search_symbol(self.graph, query, limit).collect()
        names = ("id", "kind", "file", "line", "signature", "doc")
        return {"matches": [{n: r[n] for n in names} for r in rows], "truncated": bool(rows and rows[0]["truncated"])}

    def module_api(self, module: str) -> dict:
        found, error = self._one(module, ("module",))
        if error:
            return error
        rows = lookup.module_api(self.graph, found).collect()
        item = lambda r: {"id": r["id"], "kind": r["kind"], "signature": r["signature"], "doc": r["doc"]}
        types = [r for r in rows if r["class_id"] == r["id"]]
        return {
            "module": found.split("/", 1)[-1],
            "classes": [item(t) | {"methods": [item(r) for r in rows if r["class_id"] == t["id"] and r["kind"] == "method"]} for t in types],
            "functions": [item(r) for r in rows if r["class_id"] is None],
        }

    def _links(self, side: str, symbol: str, depth: int) -> dict:
        found, error = self._one(symbol, CALLABLE)
        if error:
            return error
        links = getattr(flow, side)(self.graph, flow.as_start(self.graph, found), depth).orderBy("depth", "id").collect()
        return {"symbol": found, side: [{"id": r["id"], "certainty": r["certainty"], "depth": r["depth"]} for r in links]}

    def callers(self, symbol: str, depth: int = 1) -> dict:
        return self._links("callers", symbol, depth)

    def callees(self, symbol: str, depth: int = 1) -> dict:
        return self._links("callees", symbol, depth)

    def impact(self, target: str, depth: int = 3) -> dict:
        found, error = self._one(target)
        if error:
            return error
        rows = flow.impact(self.graph, flow.as_start(self.graph, found), depth).orderBy("depth", "id").collect()
        by_depth: dict[int, list[dict]] = {}
        for r in rows:
            by_depth.setdefault(r["depth"], []).append({"id": r["id"], "via": r["via"], "certainty": r["certainty"]})
        return {
            "target": found,
            "levels": [{"depth": d, "entries": e} for d, e in sorted(by_depth.items())],
            "entrypoints_reached": sorted(r["id"] for r in rows if r["is_entrypoint"]),
        }

    def dead_code(self) -> dict:
        rows = deadcode.dead_code(self.graph).orderBy("node_id").collect()
        return {"candidates": [{"id": r["node_id"], "confidence": r["confidence"], "reason": r["reason"]} for r in rows]}

    def reload(self) -> dict:
        self.graph = self.read()
        return {"symbols": self.graph.nodes.count()}


NAMES = ("overview", "search_symbol", "module_api", "callers", "callees", "impact", "dead_code", "reload")


def answer(tools: Tools, request: dict[str, Any]) -> dict[str, Any]:
    """The answer to ``{"tool": …, "arguments": {…}}``; a wrong request is answered with an error."""
    name, arguments = request.get("tool"), request.get("arguments") or {}
    if name not in NAMES:
        return {"error": f"unknown tool: {name}", "tools": list(NAMES)}
    try:
        return getattr(tools, name)(**arguments)
    except TypeError as e:
        return {"error": str(e)}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    """A JSON request a line in, a JSON answer a line out."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except ValueError as e:
            reply = {"error": f"not JSON: {e}"}
        out.write(json.dumps(reply, ensure_ascii=False, sort_keys=True) + "\n")
        out.flush()
