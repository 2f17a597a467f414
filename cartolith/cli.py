"""Command line: build, check, export, impact, diagram, baseline, diff, serve-once and tools."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from cartolith import tools
from cartolith.operators import baseline, entrypoints, flow, lookup, render
from cartolith.plans.graph import GraphError
from cartolith.sources import config as C
from cartolith.sources import repository, sinks

OK, FATAL, USAGE, FAILED = 0, 1, 2, 3


def session() -> SparkSession:
    spark = SparkSession.builder.appName("cartolith").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartolith")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--config")
        for flags, kwargs in options:
            c.add_argument(flags, **kwargs)

    number = {"type": int}
    command("build", ("--out", {}))
    command(
        "check", ("--max-package-cycles", number), ("--min-doc-coverage", number), ("--max-critical-symbols", number),
        ("--against-baseline", {"action": "store_true"}), ("--baseline", {}),
    )
    command("export", ("--budget", number))
    command("impact", ("--focus", {"required": True}), ("--depth", number | {"default": 3}))
    command("diagram", ("--kind", {"choices": ("deps", "architecture", "calls", "class", "services"), "default": "deps"}), ("--focus", {}), ("--depth", number))
    command("baseline", ("--out", {}), ("--label", {}))
    command("diff", ("--baseline", {}), ("--format", {"choices": ("text", "markdown", "json"), "default": "text"}))
    command("graph")
    command("tools")
    command("query", ("--tool", {"choices": ("overview", "search", "module-api", "callers", "callees", "impact", "dead-code", "entrypoints"), "required": True}), ("--symbol", {}), ("--depth", number | {"default": 1}))
    return p


def run(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    say = lambda text: print(text, file=out, end="" if text.endswith("\n") else "\n")
    try:
        config = C.load(a.path, a.config)
        spark = spark or session()
        root = Path(a.path).resolve()
        graph = repository.analyse(spark, str(root), config)
        if a.command == "build":
            target = Path(a.out or root / config.site.out)
            say("\n".join(sinks.build_site(graph, target, config.explorer.default_metric, config.project.language, root, config.metrics, config.explorer.enabled)))
        elif a.command == "export":
            say(render.repomap(graph, config.export.budget if a.budget is None else a.budget))
        elif a.command == "graph":
            say(sinks.graph_json(graph))
        elif a.command == "tools":
            tools.serve(tools.Tools(lambda: repository.analyse(spark, str(root), config)), sys.stdin, out)
        elif a.command == "baseline":
            text = sinks.baseline_json(graph)
            say(str(sinks.archive(text, root, a.label) if a.label else sinks.write_text(Path(a.out) if a.out else sinks.default_baseline(root), text)))
        elif a.command == "diff":
            say(_diff(spark, graph, Path(a.baseline) if a.baseline else sinks.default_baseline(root), a.format))
        elif a.command == "check":
            return _check(spark, graph, config, a, root, say)
        elif a.command == "impact":
            targets = flow.impact_targets(graph, a.focus)
            if targets.isEmpty():
                raise lookup.FocusError(f"symbole introuvable : {a.focus}")
            for r in flow.impact(graph, targets, a.depth).orderBy("depth", "id").collect():
                say(f"{r['depth']}\t{r['id']}\t{r['via']}\t{r['certainty']}" + ("\tentrypoint" if r["is_entrypoint"] else ""))
        elif a.command == "diagram":
            say(_diagram(graph, config, a))
        else:
            say(sinks.canonical_json(_tool(graph, a)))
    except (C.ConfigError, sinks.BaselineError, lookup.FocusError) as e:
        print(e, file=sys.stderr)
        return USAGE
    except (repository.NothingToAnalyse, GraphError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return FATAL
    return OK


def _diff(spark: SparkSession, graph, path: Path, form: str) -> str:
    old, old_metrics = sinks.load_baseline(spark, path)
    delta, metrics = baseline.compare(old, baseline.state(graph)), baseline.compare_metrics(old_metrics, baseline.metrics(graph))
    if form == "json":
        return json.dumps(render.delta_payload(delta, metrics), ensure_ascii=False, indent=2, sort_keys=True)
    return render.delta_markdown(delta, metrics) if form == "markdown" else render.delta_text(delta, metrics)


def _check(spark: SparkSession, graph, config: C.Config, a, root: Path, say) -> int:
    pick = lambda given, usual: usual if given is None else given
    c = config.check
    found = baseline.gate_checks(
        graph, pick(a.max_package_cycles, c.max_package_cycles), pick(a.min_doc_coverage, c.min_doc_coverage), pick(a.max_critical_symbols, c.max_critical_symbols),
        config.metrics.complexity_critical,
    ).collect()
    if a.against_baseline:
        path = Path(a.baseline) if a.baseline else sinks.default_baseline(root)
        if not path.is_file():
            sinks.write_text(path, sinks.baseline_json(graph))
            say(f"baseline créée : {path}")
        else:
            old, old_metrics = sinks.load_baseline(spark, path)
            delta, metrics = baseline.compare(old, baseline.state(graph)), baseline.compare_metrics(old_metrics, baseline.metrics(graph))
            rules = tuple(r for r in baseline.REGRESSIONS if getattr(c, r.replace("-", "_")))
            found += baseline.regression_checks(delta, metrics, rules, c.max_doc_coverage_drop).collect()
    for r in found:
        say(f"{'ok' if r['passed'] else 'FAIL'}\t{r['name']}\t{r['actual']}\t{r['threshold']}")
    return OK if all(r["passed"] for r in found) else FAILED


def _diagram(graph, config: C.Config, a) -> str:
    if a.kind == "deps":
        return render.package_diagram(graph)
    if a.kind == "architecture":
        return render.architecture_diagram(graph)
    if a.kind == "services":
        return render.services_diagram(graph)
    if not a.focus:
        raise lookup.FocusError("--focus is missing")
    if a.kind == "calls":
        return render.call_flow_diagram(graph, lookup.resolve_focus(graph, a.focus, ("function", "method")), a.depth or config.graphs.call_depth)
    focus = lookup.resolve_focus(graph, a.focus, ("class", "interface", "enum"))
    return render.neighbourhood_diagram(graph, focus, a.depth or config.graphs.focus_depth, config.analysis.include_private)


def _tool(graph, a) -> dict:
    if a.tool == "entrypoints":
        return {"entrypoints": [r.asDict() for r in entrypoints.entry_points(graph).orderBy("kind", "node_id", "framework", "label").collect()]}
    asked = tools.Tools(lambda: graph)
    if a.tool == "overview":
        return asked.overview()
    if a.tool == "dead-code":
        return asked.dead_code()
    if not a.symbol:
        raise lookup.FocusError("--symbol is missing")
    if a.tool == "search":
        return asked.search_symbol(a.symbol)
    return asked.module_api(a.symbol) if a.tool == "module-api" else getattr(asked, a.tool)(a.symbol, a.depth)


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
