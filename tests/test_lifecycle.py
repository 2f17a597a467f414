import io
import json

import pytest

from cartolith import cli, tools
from cartolith.plans import graph as G
from cartolith.sources import repository, sinks
from cartolith.streaming import incremental as I

from .corpus import JAVA, PYTHON, SCRIPT, pyproject, write


def content(g):
    return sinks.graph_json(g)


@pytest.fixture
def mono(tmp_path):
    return write(tmp_path / "repo", ("core", pyproject("shop")), ("core", PYTHON), ("web", SCRIPT), ("bill", JAVA))


def test_incremental_equals_cold(spark, mono):
    g = repository.analyse(spark, str(mono))
    assert I.affected(g, {"core/shop/cli.py", "web/readme.md"}) == ["core"] and I.affected(g, {"x.txt"}) == []
    assert I.update(g, str(mono), {"readme.md"}, spark) is g
    (mono / "core/shop/services/cart.py").write_text("class Cart:\n    def add(self): pass\n")
    (mono / "web/src/bad.js").write_text("export function ok() { return 1; }\n")
    (mono / "bill/src/b/Main.java").unlink()
    paths = {"core/shop/services/cart.py", "web/src/bad.js", "bill/src/b/Main.java"}
    for part in ({p} for p in sorted(paths)):
        g = I.update(g, str(mono), part, spark)
    assert content(g) == content(repository.analyse(spark, str(mono)))
    assert I.is_structural("a/pom.xml") and not I.is_structural("a/x.java")


def test_stream_of_changes(spark, mono, tmp_path):
    events = []
    shop = I.Workshop(spark, str(mono), str(tmp_path / "store"), listen=lambda e, v: events.append(e))
    (tmp_path / "store").mkdir()
    assert shop.build() and shop.token == 1
    (mono / "core/shop/new.py").write_text("def fresh(): pass\n")
    spark.createDataFrame([("core/shop/new.py",), ("core/shop/new.py",), (".git/x.py",), ("a.py~",)], "path string").write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "feed"))
    query = I.follow(stream, shop, str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(120)
    assert shop.token == 2 and events.count("reload") == 1 and events.count("warning") == 4
    assert "core/shop.new.fresh" in {r["id"] for r in shop.current().nodes.collect()}
    for f in mono.rglob("*.*"):
        f.unlink()
    assert not shop.build({"core/pyproject.toml"}) and shop.token == 2 and events[-1] == "error"


def run(spark, *args):
    out = io.StringIO()
    return cli.run([str(a) for a in args], spark, out), out.getvalue()


def test_command_line(spark, tmp_path):
    root = write(tmp_path / "r", ("", PYTHON))
    assert run(spark, "check", root)[0] == cli.OK
    code, text = run(spark, "check", root, "--max-critical-symbols", 0, "--min-doc-coverage", 99)
    assert code == cli.FAILED and "FAIL\tmin-doc-coverage" in text
    assert run(spark, "baseline", root)[0] == cli.OK and run(spark, "diff", root)[1].strip() == "✅ Aucun changement architectural"
    saved = (root / ".cartolith/baseline.json").read_text()
    state, metrics = sinks.read_baseline(spark, saved)
    assert metrics.where("name = 'files_analyzed'").first()["value"] == 6 and state.count() > 5
    run(spark, "baseline", root, "--label", "v2")
    (root / "shop/storage/repo.py").write_text("class Repo: pass\n")
    code, text = run(spark, "diff", root, "--format", "json")
    assert not json.loads(text)["is_empty"]
    run(spark, "baseline", root, "--label", "v10")
    assert [a for a, _ in sinks.archives(root)] == ["v2", "v10"] and "## v2 → v10" in sinks.changelog(spark, root)
    assert run(spark, "impact", root, "--focus", "total")[1].startswith("1\tmain/shop.cli.main\tcalls\tcertain")
    assert run(spark, "impact", root, "--focus", "nowhere")[0] == cli.USAGE
    assert run(spark, "diagram", root, "--kind", "calls", "--focus", "cli.main")[1].startswith("flowchart TD")
    assert json.loads(run(spark, "query", root, "--tool", "search", "--symbol", "Cart")[1])["matches"][0]["id"] == "main/shop.services.cart.Cart"
    assert json.loads(run(spark, "query", root, "--tool", "callers", "--symbol", "total")[1])["callers"][0]["depth"] == 1
    code, text = run(spark, "build", root, "--out", tmp_path / "site")
    assert code == cli.OK and {"health.md", "changelog.md", "entrypoints.md", "tour.md", "index.md", "assets/data/view-graph.js", "modules/shop.cli.md"} <= set(text.split())
    assert (tmp_path / "site/assets/data/view-graph.js").read_text().endswith(";\n")
    kept = write(tmp_path / "mine", ("", {"notes.txt": "kept"}))
    assert run(spark, "build", root, "--out", kept)[0] == cli.FATAL and (kept / "notes.txt").read_text() == "kept"
    assert run(spark, "nonsense")[0] == cli.USAGE and run(spark, "check", tmp_path / "none")[0] == cli.FATAL


def test_tools(spark, tmp_path):
    root = write(tmp_path / "r", ("", PYTHON))
    made = tools.Tools(lambda: repository.analyse(spark, str(root)))
    asked = ["", "{", json.dumps({"tool": "nope"}), json.dumps({"tool": "callers", "arguments": {"nope": 1}})]
    asked += [json.dumps({"tool": n, "arguments": x}) for n, x in (
        ("module_api", {"module": "shop.services.cart"}), ("impact", {"target": "Repo.save", "depth": 1}), ("callees", {"symbol": "Cart.clear"}), ("search_symbol", {"query": "repo"}), ("callers", {"symbol": "add"}), ("module_api", {"module": "none"}),
    )]
    out = io.StringIO()
    tools.serve(made, io.StringIO("\n".join(asked)), out)
    bad_json, unknown, wrong, api, hit, callees, found, callers, none = map(json.loads, out.getvalue().splitlines())
    assert all("error" in x for x in (bad_json, unknown, wrong, none))
    assert [c["id"].rsplit(".", 1)[1] for c in api["classes"]] == ["Cart", "Port"] and [f["signature"] for f in api["functions"]] == ["(xs)"]
    assert "main/shop.cli.main" in hit["entrypoints_reached"] and [c["id"].rsplit(".", 1)[1] for c in callees["callees"]] == ["_gone", "add"]
    assert found["matches"][0]["id"] == "main/shop.storage.repo" and callers["callers"]
    (root / "shop/more.py").write_text("def f(): pass\n")
    before = made.graph.nodes.count()
    assert made.reload()["symbols"] == before + 2


def test_polling_watcher(spark, tmp_path):
    root = write(tmp_path / "r", ("", PYTHON))
    old = I.snapshot(spark, str(root))
    (root / "shop/cli.py").write_text("x = 1\n")
    (root / "shop/storage/repo.py").unlink()
    (root / "shop/new.py").write_text("")
    assert sorted(r["path"] for r in I.changes_between(old, I.snapshot(spark, str(root))).collect()) == ["shop/cli.py", "shop/new.py", "shop/storage/repo.py"]


def test_baselines_are_checked(spark):
    for text in ("{", "{}", json.dumps({"baseline_version": 9, "ir_version": 1})):
        with pytest.raises(sinks.BaselineError):
            sinks.read_baseline(spark, text)
    with pytest.raises(sinks.BaselineError):
        sinks.archive("", None, "../x")
    with pytest.raises(ValueError):
        sinks.canonical_json({"x": float("nan")})


def test_save_and_load(spark, tmp_path):
    g = repository.analyse(spark, str(write(tmp_path / "r", ("", PYTHON))))
    G.save(g, f"file://{tmp_path}/g")
    again = G.load(spark, f"file://{tmp_path}/g")
    assert again.nodes.count() == g.nodes.count() and {tuple(r) for r in again.edges.collect()} == {tuple(r) for r in g.edges.collect()}
