import pytest

from cartolith.operators import deadcode, entrypoints, flow, patterns
from cartolith.plans import graph as G
from cartolith.sources import braces, config, python_facts, repository

from .corpus import JAVA, PYTHON, SCRIPT, pyproject, write


def edges(g, *kinds):
    return {(r["source"].split("/", 1)[1], r["target"].split("/", 1)[1], r["certainty"]) for r in g.edges_of(*kinds).collect()}


@pytest.fixture(scope="module")
def python_graph(spark, tmp_path_factory):
    g = repository.analyse(spark, str(write(tmp_path_factory.mktemp("py"), ("", PYTHON))))
    return G.check(g)


def test_python_nodes(python_graph):
    rows = {r["id"]: r for r in python_graph.nodes.collect()}
    assert {r["id"] for r in rows.values() if r["kind"] == "module"} == {f"main/{m}" for m in ("shop", "shop.cli", "shop.services", "shop.services.cart", "shop.storage", "shop.storage.repo")}
    cart = "main/shop.services.cart."
    assert rows[cart + "Port"]["kind"] == "interface" and rows[cart + "Cart"]["kind"] == "class"
    assert rows[cart + "Cart.__init__"]["signature"] == "(repo: Repo | None = None, *, limit: int = 3, **kw)"
    assert rows[cart + "Cart.get_instance"]["signature"] == "(a, /, b, *c) -> 'Cart'"
    assert set(rows[cart + "Cart.get_instance"]["modifiers"]) == {"classmethod", "decorator:classmethod"}
    assert rows[cart + "Cart.add"]["complexity"] == 6 and rows[cart + "Cart.clear"]["complexity"] == 1
    assert rows[cart + "Cart.items"]["signature"] == "list[Repo]" and rows[cart + "Cart._instance"]["visibility"] == "private"
    assert rows["main/shop"]["doc"]["summary"] == "A shop." and "package" in rows["main/shop"]["modifiers"]
    assert "main_guard" in rows["main/shop.cli"]["modifiers"]
    assert {(r["path"], r["reason"].split(" (")[0]) for r in python_graph.skipped.collect()} == {("shop/broken.py", "SyntaxError: invalid syntax"), ("shop/latin.py", repository.NOT_UTF8)}


def test_python_edges(python_graph):
    cart, repo = "shop.services.cart", "shop.storage.repo"
    assert edges(python_graph, "imports") == {("shop.cli", cart, "certain"), ("shop.cli", repo, "certain"), (cart, repo, "certain"), (repo, "shop.cli", "certain")}
    assert edges(python_graph, "inherits") == {(f"{repo}.Repo", f"{repo}.Base", "certain")}
    assert edges(python_graph, "composes") == {(f"{cart}.Cart", f"{repo}.Repo", "certain")}
    assert edges(python_graph, "aggregates") == edges(python_graph, "associates") == {(f"{cart}.Cart", f"{repo}.Repo", "certain")}
    main, c = "shop.cli.main", f"{cart}.Cart"
    assert edges(python_graph, "calls") == {
        (main, f"{c}.__init__", "certain"), (main, f"{c}.add", "certain"), (main, f"{c}.clear", "certain"), (main, f"{cart}.total", "certain"),
        (main, f"{c}.refresh", "inferred"), (main, f"{repo}.Repo.save", "certain"), (f"{c}.add", f"{repo}.Repo.save", "certain"),
        (f"{c}.refresh", f"{repo}.Repo.load", "certain"), (f"{c}.clear", f"{c}._gone", "certain"), (f"{c}.clear", f"{c}.add", "certain"), (f"{repo}.Repo.load", f"{repo}.Repo.save", "certain"),
    }


def test_python_insights(python_graph):
    found = {(r["node_id"].split("/")[1], r["framework"], r["label"]) for r in entrypoints.entry_points(python_graph).collect()}
    assert found == {("shop.cli", "python", "python -m shop.cli"), ("shop.cli.main", "click", "shop.cli.main"), ("shop.cli.items", "web", "GET /items")}
    dead = {r["node_id"].rsplit(".", 1)[1]: r["confidence"] for r in deadcode.dead_code(python_graph).collect()}
    assert dead == {"pay": "medium", "get_instance": "medium", "_unused": "high"}
    assert {r["node_id"] for r in deadcode.dead_code_by_closure(python_graph).collect()} == {r["node_id"] for r in deadcode.dead_code(python_graph).collect()}
    assert [(r["pattern"], r["class_id"].rsplit(".", 1)[1]) for r in patterns.patterns(python_graph).collect()] == [("singleton", "Cart")]
    hit = flow.impact(python_graph, flow.as_start(python_graph, "main/shop.storage.repo.Repo.save"), 2)
    assert {(r["depth"], r["id"].rsplit(".", 1)[1], r["is_entrypoint"]) for r in hit.collect()} == {(1, "main", True), (1, "add", False), (1, "load", False), (2, "refresh", False), (2, "clear", False)}


def test_script_and_java(spark, tmp_path):
    g = G.check(repository.analyse(spark, str(write(tmp_path, ("web", SCRIPT), ("bill", JAVA), ("core", pyproject("shop", "billing>=1")), ("core", PYTHON)))))
    subs = {r["id"]: r for r in g.subprojects.collect()}
    assert {i: (s["language"], s["name"], s["declared_deps"]) for i, s in subs.items()} == {
        "web": ("javascript", "web", ["core"]), "bill": ("java", "billing", []), "core": ("python", "shop", ["bill"])
    }
    assert {(r["source"], r["target"]) for r in g.edges_of("service_dep").collect()} == {("web", "core"), ("core", "bill")}
    rows = {r["id"]: r for r in g.nodes.collect()}
    assert rows["web/src.model.Thing.show"]["signature"] == '(x: string = "}") -> string | undefined' and rows["web/src.model.Thing.show"]["complexity"] == 5
    assert rows["web/src.model.Thing.id"]["visibility"] == "private" and rows["web/src.model.Thing.#hide"]["visibility"] == "private"
    assert {rows[f"web/src.model.{n}"]["kind"] for n in ("Named", "Level", "Base")} == {"interface", "enum", "class"}
    assert rows["web/src.model.Thing"]["doc"]["summary"] == "A thing." and rows["web/src.model"]["doc"]["summary"] == "The model."
    assert set(rows["web/src.server"]["modifiers"]) == {"ext-import:express", "route:GET /things"} and rows["web/src.server.make"]["modifiers"] == ["async"]
    web = {e for e in edges(g, "calls") if e[0].startswith("src.")}
    assert web == {("src.server.local", "src.server.make", "certain"), ("src.server.local", "src.server.helper", "certain"), ("src.server.helper", "src.server.local", "certain"), ("src.server.helper", "src.model.Thing.constructor", "certain"), ("src.model.Thing.show", "src.model.Thing.#hide", "certain")}
    links = edges(g, "inherits", "implements")
    assert {("src.model.Thing", "src.model.Base", "certain"), ("src.model.Thing", "src.model.Named", "certain"), ("a.Bill.Bill", "a.Base.Base", "certain"), ("a.Bill.Bill", "b.Rule.Rule", "certain")} <= links
    java = {e[:2] for e in edges(g, "calls") if e[0].startswith("a.")}
    run, base = "a.Bill.Bill.run", "a.Base.Base"
    assert java == {(run, f"{base}.Base"), (run, "b.Rule.Rule.apply"), (run, f"{base}.twice")}
    assert rows["bill/a.Base.Base.twice"]["complexity"] == 3 and rows["bill/a.Bill.Bill.names"]["kind"] == rows["bill/a.Bill.Bill.others"]["kind"] == "attribute"
    found = {(r["framework"], r["label"]) for r in entrypoints.entry_points(g).collect()}
    assert {("spring", "GET /bill"), ("java", "b.Main.Main.main"), ("web", "GET /things")} <= found
    assert {r["path"] for r in g.skipped.collect()} == {"web/src/bad.js", "bill/src/b/Broken.java", "core/shop/broken.py", "core/shop/latin.py"}
    assert rows["core/shop.cli"]["location"]["file"] == "core/shop/cli.py"


def test_scanner_finds_broken_files():
    for text in ("class A {", "function f( { }", "let s = 'open", "const x = `open"):
        assert [r["fact"] for r in braces.extract("s", "x.ts", text)] == ["skip"]
    assert [r["fact"] for r in braces.extract("s", "X.java", "class A { String s = \"; }")] == ["skip"]
    assert braces.extract("s", "x.js", "")[0]["fact"] == "module"
    assert python_facts.extract("s", "x.py", "x = (")[0]["fact"] == "skip"
    assert python_facts.imported_module("a.b.c", False, __import__("ast").parse("from ...... import x").body[0]) is None


def test_excludes_and_units(spark, tmp_path):
    out = repository.excluder(config.DEFAULT_EXCLUDES)
    assert all(map(out, ("node_modules/a.js", "x/build/y.py", ".git/z.py", "lib/a.min.js", "a/.hidden/b.py")))
    assert not any(map(out, ("src/builder.py", "a/min.js", "venv.py")))
    write(tmp_path, ("", {"a.py": "x = 1\n", "b.js": "function f() {}\n", "go/go.mod": "module g\n"}))
    g = repository.analyse(spark, str(tmp_path))
    assert {(r["id"], r["language"]) for r in g.subprojects.collect()} == {("main", "javascript"), ("main-python", "python")}
    assert repository.subprojects_of([("pyproject.toml", "bad ["), ("package.json", '{"name": "n"}')])[0][1:5] == ("python", ".", "pyproject.toml", "")
    with pytest.raises(repository.NothingToAnalyse):
        (tmp_path / "empty").mkdir()
        repository.analyse(spark, str(tmp_path / "empty"))


def test_configuration(tmp_path):
    assert config.load(tmp_path) == config.Config()
    (tmp_path / "pyproject.toml").write_text("[tool.cartolith.export]\nbudget = 3000\n")
    assert config.load(tmp_path).export.budget == 3000
    (tmp_path / config.FILE).write_text('[analysis]\nexclude = ["gen/**"]\n')
    loaded = config.load(tmp_path)
    assert loaded.export.budget == 24000 and loaded.analysis.exclude == config.DEFAULT_EXCLUDES + ("gen/**",)
    for bad in ({"exprt": {}}, {"export": {"budgt": 1}}, {"export": {"budget": "x"}}, {"export": {"budget": 10}}, {"site": {"enabled": 1}}, {"explorer": {"default_metric": "x"}}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    with pytest.raises(config.ConfigError, match="did you mean 'export'"):
        config.parse({"exprt": {}})


def test_domains_of_settings():
    assert config.parse({"metrics": {"complexity_critical": 5}}).metrics == config.Metrics(complexity_critical=5)
    assert config.parse({"analysis": {"exclude": ["gen/**", "gen/**", "**/dist/**"], "languages": ["java"]}}).analysis.exclude == (*config.DEFAULT_EXCLUDES, "gen/**")
    for bad in ({"check": {"max_doc_coverage_drop": 101}}, {"check": {"max_doc_coverage_drop": -2}}, {"graphs": {"focus_depth": 0}}, {"analysis": {"exclude": [1]}}, {"project": {"language": "xx"}}, {"export": {"budget": True}}, {"site": 3}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert config.parse({"check": {"max_doc_coverage_drop": -1, "min_doc_coverage": 0}}).check.min_doc_coverage == 0
