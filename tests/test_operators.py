import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cartolith import queries as Q
from cartolith.operators import baseline, explorer, flow, health, kernels, layers, lookup, packages, reading, render, rounds
from cartolith.plans import graph as G
from cartolith.plans import lineage, projection
from cartolith.plans.lineage import cut


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def cycles(spark, edges):
    out = {}
    for r in kernels.strong_components(frame(spark, edges)).collect():
        out.setdefault(r["cycle"], []).append(r["node"])
    return sorted(sorted(c) for c in out.values())


def test_cycles(spark, monkeypatch):
    cases = [([("a", "b"), ("b", "c")], []), ([("a", "b"), ("b", "a"), ("b", "c")], [["a", "b"]]), ([("a", "a")], [["a"]]), ([("a", "a"), ("a", "b"), ("b", "a")], [["a", "b"]])]
    for edges, want in cases:
        assert cycles(spark, edges) == want and cycles(spark, edges[::-1]) == want
    r = random.Random(2)
    edges = sorted({(f"n{r.randint(0, 14):02}", f"n{r.randint(0, 14):02}") for _ in range(22)})
    local = cycles(spark, edges)
    monkeypatch.setattr(kernels, "LOCAL_EDGES", 0)
    assert cycles(spark, edges) == local and local


def test_closure_levels_and_ranks(spark):
    edges = frame(spark, [("main", "svc"), ("svc", "db"), ("x", "y")])
    start = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    reach = lambda *ids: sorted(r["id"] for r in kernels.closure(edges, start(*ids)).collect())
    assert reach("main") == ["db", "main", "svc"] and reach("unknown") == ["unknown"]
    steps = spark.createDataFrame([("a", "b", "v", "certain"), ("a", "c", "v", "inferred"), ("b", "d", "w", "inferred"), ("c", "d", "v", "certain"), ("d", "a", "v", "certain")], "near string, far string, via string, certainty string")
    found = [tuple(r) for r in kernels.levels(steps, start("a"), 5).orderBy("depth", "id").collect()]
    assert found == [(1, "b", "v", "certain"), (1, "c", "v", "inferred"), (2, "d", "w", "inferred")]
    assert kernels.levels(steps, start("a"), 0).count() == 0
    assert kernels.ranks_of("abcde", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0}


def test_layout_and_treemap():
    assert explorer.positions_of("ab", [("a", "b")]) == {"a": (0, 0), "b": (240, 0)}
    place = explorer.positions_of("abcd", [("a", "b"), ("b", "a"), ("a", "c"), ("a", "d")])
    assert place["a"][0] == place["b"][0] == 0 and {place["c"][1], place["d"][1]} == {-48, 48}
    assert explorer.positions_of([], []) == {}
    cells = explorer.treemap_cells([(f"m{i}", float(i)) for i in range(12)])
    assert len(cells) == 11 and abs(sum(w * h for _, _, _, w, h, _ in cells) - 1000 * 560) < 2500
    covered = {(x, y) for _, x0, y0, w, h, _ in cells for x in range(x0, x0 + w, 40) for y in range(y0, y0 + h, 40)}
    assert len(covered) == sum(len(range(0, w, 40)) * len(range(0, h, 40)) for _, _, _, w, h, _ in cells)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [
        {"id": "s/app.api.m", "kind": "module", "file": "m.py", "loc": 10, "doc": ("D.", "D.", "docstring")},
        {"id": "s/app.api.m.C", "kind": "class", "file": "m.py"}, {"id": "s/app.api.m.C.f", "kind": "method", "file": "m.py", "complexity": 12, "signature": "(x: int) -> D", "doc": ("x", "x", "docstring")},
        {"id": "s/app.db.n", "kind": "module", "file": "n.py", "loc": 20}, {"id": "s/app.db.n.D", "kind": "interface", "file": "n.py"},
        {"id": "s/app.db.n.D._g", "kind": "method", "file": "n.py", "complexity": 25, "visibility": "private"}, {"id": "s/app.db.n.main", "kind": "function", "file": "n.py", "modifiers": ["decorator:x.command()"]},
    ]
    edges = [("s/app.api.m", "s/app.db.n", "imports"), ("s/app.db.n", "s/app.api.m", "imports", "inferred"), ("s/app.api.m.C.f", "s/app.db.n.D._g", "calls", "inferred"), ("s/app.db.n.main", "s/app.api.m.C.f", "calls"), ("s/app.api.m.C", "s/app.db.n.D", "composes"), ("s/app.api.m.C", "s/app.db.n.D", "associates")]
    return G.check(G.from_rows(spark, nodes, edges, [("s", "python", ".")], [("bad.py", "why")]))


def test_rules(spark, small):
    bad = G.from_rows(spark, [{"id": "s/a", "kind": "module"}, {"id": "s/a", "kind": "module"}, {"id": "t/b", "kind": "module"}], [("s/a", "s/none", "calls")], [("s", "python", ".")])
    assert {r["rule"] for r in G.problems(bad).collect()} == {"duplicate node", "unknown subproject", "unknown end"}
    with pytest.raises(G.GraphError):
        G.check(bad)
    twice = spark.createDataFrame([("a", "b", "calls", "certain", ("f", 9)), ("a", "b", "calls", "certain", ("f", 2))], G.EDGES)
    assert [r["location"]["line"] for r in G.first_edges(twice).collect()] == [2]


def test_small_graph(small):
    rows = {r["module_id"]: r for r in health.module_health(small).collect()}
    assert (rows["s/app.api.m"]["status"], rows["s/app.api.m"]["doc_coverage"], rows["s/app.db.n"]["status"]) == ("warn", 50, "critical")
    assert [(r["node_id"], r["status"]) for r in health.worst_symbols(small).collect()] == [("s/app.db.n.D._g", "critical"), ("s/app.api.m.C.f", "warn")]
    assert [tuple(r) for r in packages.layer_violations(small).collect()] == [("app.db", "app.api", ["app.db.n → app.api.m"])]
    assert [r["module"] for r in reading.reading_tour(small).collect()] == ["app.db.n", "app.api.m"]
    assert lookup.resolve_focus(small, "C.f") == "s/app.api.m.C.f"
    for bad in ("nothing", "s/app"):
        with pytest.raises(lookup.FocusError):
            lookup.resolve_focus(small, bad)
    found = lookup.search_symbol(small, "m", limit=1).collect()
    assert [(r["id"], r["truncated"]) for r in found] == [("s/app.api.m", True)]
    assert [r["kind"] for r in flow.strongest_relations(small).collect()] == ["composes"]


def test_diagrams(small):
    assert render.package_diagram(small).splitlines()[-2:] == ["    class p0,p1 cycle", "    linkStyle 0,1 stroke:#d33,stroke-width:2px"]
    assert render.architecture_diagram(small).splitlines()[-1] == "    linkStyle 1 stroke:#d33,stroke-width:2px"
    assert render.call_flow_diagram(small, "s/app.api.m.C.f").splitlines()[-2:] == ["    n0 -.-> n1", "    n2 --> n0"]
    assert render.class_diagram(small, "s/app.api.m") == "classDiagram\n    class C {\n        +f(x) D\n    }\n    C *-- D\n"
    around = render.neighbourhood_diagram(small, "s/app.api.m.C")
    assert "<<interface>>" in around and "_g" not in around
    text = render.repomap(small)
    assert "### app.api.m\nD.\n- **C**\n  - `f(x: int) -> D` — x\n" in text and text == render.repomap(small)
    with pytest.raises(ValueError):
        render.repomap(small, 100)


def test_differences(spark, small):
    old, metrics = baseline.state(small), baseline.metrics(small)
    assert baseline.compare(old, old).count() == 0 and render.delta_text(baseline.compare(old, old), baseline.compare_metrics(metrics, metrics)) == render.NO_CHANGE + "\n"
    changed = old.where("key <> 's/app.db.n.main'").replace({"(x: int) -> D": "()"}, subset=["detail"])
    delta = baseline.compare(old, changed)
    assert {(r["category"], r["change"], r["key"]) for r in delta.collect()} == {("public_api", "modified", "s/app.api.m.C.f"), ("public_api", "disappeared", "s/app.db.n.main")}
    later = spark.createDataFrame([("doc_coverage", 10), ("nodes", 7)], "name string, value long")
    moved = baseline.compare_metrics(metrics.where("name in ('doc_coverage', 'nodes')"), later)
    text = render.delta_markdown(delta, moved)
    assert text.startswith(render.MARKER) and "🔴 API publiques" in text and "doc_coverage : " in text
    checks = {r["name"]: r["passed"] for r in baseline.regression_checks(delta, moved, max_doc_coverage_drop=5).collect()}
    assert checks == {"fail-on-new-cycles": True, "fail-on-new-violations": True, "fail-on-new-inferred": True, "fail-on-removed-public-api": False, "max-doc-coverage-drop": False}
    assert baseline.gate_checks(small).count() == 0
    assert {r["name"]: r["passed"] for r in baseline.gate_checks(small, 1, 90, 0).collect()} == {"max-package-cycles": True, "min-doc-coverage": False, "max-critical-symbols": False}


def test_budget_and_tables(spark):
    blocks = spark.createDataFrame([(1, "a", 50), (2, "b", 80), (3, "c", 40)], "position int, id string, size long")
    assert [r["included"] for r in reading.within_budget(blocks, 100).orderBy("position").collect()] == [True, False, True]
    table = spark.createDataFrame([(0, "10"), (1, "9"), (2, ""), (3, "x9")], "p int, v string")
    order = lambda t, d=False: [r["p"] for r in explorer.table_sort(t, "v", "p", d).collect()]
    assert order(table.where("p < 3")) == [2, 1, 0] and order(table) == [2, 0, 1, 3] and order(table.where("p < 3"), True) == [0, 1, 2]
    assert [r["p"] for r in explorer.table_filter(table, "X").collect()] == [3] and explorer.table_filter(table.limit(3), "X").count() == 3
    files = spark.createDataFrame([("f", ["a", "b", "c"])], "path string, lines array<string>")
    nodes = spark.createDataFrame([("n", "f", 2, 9), ("z", "f", 9, 1), ("q", "none", 1, 1)], "id string, file string, line int, loc int")
    assert [(r["id"], r["code"], r["end_line"], r["truncated"]) for r in lookup.excerpts(nodes, files).collect()] == [("n", "b\nc", 3, False)]
    assert [(r["code"], r["truncated"]) for r in lookup.excerpts(nodes, files, 1).collect()] == [("b", True)]


@pytest.mark.parametrize("range_rows", [1, 7, 40, 10**6])
def test_budget_in_ranges_equals_one_fold(spark, range_rows):
    r = random.Random(range_rows)
    for top in (3, 60, 400):
        sizes = [r.randint(1, top) for _ in range(120)]
        used, want = 5, []
        for k, size in enumerate(sizes):
            want.append((k, f"b{k}", size, used + size <= 500))
            used += size if want[-1][3] else 0
        blocks = spark.createDataFrame([w[:3] for w in want], "position int, id string, size long").repartition(5)
        got = reading.within_budget(blocks, 500, 5, range_rows)
        assert sorted(tuple(x) for x in got.collect()) == want and got.columns == ["position", "id", "size", "included"]
    assert reading.within_budget(blocks.limit(0), 500).collect() == []


def test_layout_by_joins_equals_the_one_on_arrays(spark, monkeypatch):
    r = random.Random(4)
    names = [f"n{i}" for i in range(18)]
    links = {(r.choice(names[:14]), r.choice(names[:14])) for _ in range(12)} | {("n1", "n2"), ("n2", "n1"), ("n3", "n3")}
    nodes = [{"id": f"s/{n}", "kind": "module", "name": n, "subproject": "s", "file": f"{n}.py"} for n in names]
    g = G.from_rows(spark, nodes, [(f"s/{a}", f"s/{b}", "imports") for a, b in sorted(links)], [("s", "python", ".")])
    small = {r["id"]: (r["x"], r["y"]) for r in explorer.layout(g).collect()}
    assert small == explorer.positions_of([n["id"] for n in nodes], [(f"s/{a}", f"s/{b}") for a, b in links])
    ranks = kernels.ranks_of(list(small), [(f"s/{a}", f"s/{b}") for a, b in links])
    pairs = g.edges.select("source", "target")
    assert {x["id"]: x["rank"] for x in layers.longest_path_ranks(g.modules.select("id"), pairs).collect()} == ranks and max(ranks.values()) > 1
    monkeypatch.setattr(kernels, "LOCAL_EDGES", 5)
    assert {x["id"]: (x["x"], x["y"]) for x in explorer.layout(g).collect()} == small


@pytest.mark.parametrize("categories", [("public_api",), ("inferred_calls", "skipped", "subprojects", "service_deps"), ("public_api", "inferred_calls")])
def test_states_compute_only_what_is_asked(spark, small, monkeypatch, categories):
    whole = sorted(map(str, baseline.state(small).where(F.col("category").isin(*categories)).collect()))
    monkeypatch.setattr(baseline, "package_cycles", lambda g: pytest.fail("cycles are not asked for"))
    assert sorted(map(str, baseline.state(small, categories).collect())) == whole and whole
    graph = G.Graph(small.subprojects, small.nodes.withColumn("complexity", F.coalesce("complexity", F.lit(0))), small.edges, small.skipped)
    monkeypatch.setattr(Q, "graph", lambda spark, sf_dir: graph)
    for name in ("api_diff", "category_delta", "regression_checks"):
        assert Q.QUERIES[name](spark, "").columns


def test_only_places_need_the_layout(spark, small, monkeypatch):
    columns = [c for c in explorer.view_nodes(small).columns if c not in ("x", "y")]
    whole = sorted(map(str, explorer.view_nodes(small).select(*columns).collect()))
    monkeypatch.setattr(explorer, "layout", lambda g: pytest.fail("places are not asked for"))
    monkeypatch.setattr(Q, "graph", lambda spark, sf_dir: small)
    assert sorted(map(str, explorer.view_nodes(small, placed=False).select(*columns).collect())) == whole
    for name in ("dashboard_rows", "facet_values", "faceted_filter", "treemap_cells"):
        assert Q.QUERIES[name](spark, "").columns


@pytest.mark.parametrize("task_rows", [3, 10**6])
def test_places_in_ranges_are_those_of_one_sort(spark, monkeypatch, task_rows):
    monkeypatch.setattr(rounds, "TASK_ROWS", task_rows)
    r = random.Random(task_rows)
    rows = [(float(r.randint(0, 4)), f"n{i}") for i in range(20)]
    got = rounds.placed(spark.createDataFrame(rows, "mean double, id string").repartition(5), 20, "mean", "id").collect()
    assert [x["id"] for x in sorted(got, key=lambda x: x["row"])] == [i for _, i in sorted(rows)] and {x["row"] for x in got} == set(range(20))


def test_estimates_do_not_grow_with_rounds(spark):
    """A table that joins itself each round: the driver's estimate of its size stays that of its files."""
    table, pairs = spark.range(4).withColumn("row", F.lit(1)), spark.createDataFrame([(i, (i + 1) % 4) for i in range(4)], "id long, there long")
    for _ in range(5):
        beside = pairs.join(table.select(F.col("id").alias("there"), F.col("row").alias("r")), "there").groupBy("id").agg(F.sum("r").alias("r"))
        table = cut(table.join(beside, "id").select("id", F.col("r").alias("row")))
    assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20 and table.count() == 4


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 50)
    plan = lambda n: cut(spark.range(n).withColumn("x", F.lit("x"))).select("id").join(spark.range(10**7), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(50) and "Broadcast" not in plan(51)


def test_queries_on_nodes_make_no_edges(spark):
    """And every edge, with its place, is that of the SQL."""
    made = projection.project(spark, "/root/testdata/sf0.001")
    assert made.nodes.count() and not made._made
    assert made.edges_of("imports").columns and set(made._made) == {"module"}
    con = duckdb.connect()
    for name in projection.TABLES:
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    want = con.execute(f"{projection.oracle_ctes()} select source, target, kind, certainty, file, line from g_edge").fetchall()
    got = made.edges.select("source", "target", "kind", "certainty", "location.file", "location.line").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) > 1000
