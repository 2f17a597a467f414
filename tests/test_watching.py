import json
import time

import pytest

from cartolith.sources import config, listing, repository, sinks
from cartolith.streaming import incremental as I
from cartolith.streaming import store as S
from cartolith.streaming.store import GraphStore

from .corpus import JAVA, PYTHON, SCRIPT, pyproject, write


@pytest.fixture
def mono(tmp_path):
    return write(tmp_path / "repo", ("core", pyproject("shop")), ("core", PYTHON), ("web", SCRIPT), ("bill", JAVA))


def fragments(store):
    fs, base = store._fs()
    return {i.base_name for i in fs.get_file_info(listing.pafs.FileSelector(f"{base}/data", allow_not_found=True))}


# listing


def deep(root):
    tree = {f"{'/'.join('abcdefg'[:d])}/m{d}.py".lstrip("/"): "" for d in range(8)}
    tree |= {f"wide/w{i}/x{j}/f.py": "" for i in range(9) for j in range(3)} | {"node_modules/x/y.py": "", "a/b/build/z.py": "", "_private/__init__.py": "", "notes.txt": "", "a/pom.xml": ""}
    return write(root, ("", tree)), sorted(p for p in tree if "node_modules" not in p and "build/" not in p and not p.endswith(".txt"))


@pytest.mark.parametrize(("frontier", "most"), [(64, 4096), (1, 4096), (2, 1), (5, 2)])
def test_listing_is_the_same_whoever_walks(spark, tmp_path, frontier, most):
    root, want = deep(tmp_path)
    wanted = repository.wanted_files(config.DEFAULT_EXCLUDES)
    assert sorted(r["path"] for r in listing.list_tree(spark, str(root), wanted, frontier=frontier, most=most).collect()) == want
    below = [p for p in want if p.startswith("a/b/")]
    assert sorted(r["path"] for r in listing.list_tree(spark, str(root), wanted, ["a/b"], frontier, most).collect()) == below


def test_excluded_folders_are_never_entered(spark, tmp_path):
    root, want = deep(tmp_path)
    (root / "node_modules").chmod(0)
    seen = []
    fs, base = listing.open_folder(str(root))

    class Watched:
        def get_file_info(self, selector):
            seen.append(selector.base_dir[len(base) :])
            return fs.get_file_info(selector)

    enters, lists = repository.wanted_files(config.DEFAULT_EXCLUDES).tests()
    todo = [""]
    while todo:
        todo += listing._level(Watched(), base, todo.pop(), enters, lists)[1]
    (root / "node_modules").chmod(0o755)
    assert len(seen) == 8 + 1 + 9 + 27 + 1 and not any("node_modules" in s or "build" in s for s in seen)


# watching


def changes(spark, root, state, checkpoint, **options):
    """What one trigger sees."""
    rows = []
    stream = listing.watch(spark, str(root), str(state), listing.Wanted(left_out=I.NOISE_FOLDERS, left_endings=I.NOISE_ENDINGS), **options)
    query = stream.writeStream.foreachBatch(lambda df, k: rows.extend(df.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted((r["path"], r["change"]) for r in rows)


def test_watch_reports_relative_paths_and_goes_on_from_its_checkpoint(spark, tmp_path):
    root = write(tmp_path / "repo", ("", {"a.py": "1", "old/b.py": "2", "x/y/z/c.py": "3", "x/y/z/same.py": "4"}))
    where = (tmp_path / "state", tmp_path / "checkpoint")
    assert changes(spark, root, *where) == []
    write(root, ("", {"pkg/mod.py": "x = 1\n", "a.py": "other", ".git/index": "x", "notes.py.swp": "x", "x/y/z/new.txt": ""}))
    (root / "old/b.py").unlink()
    assert changes(spark, root, *where) == [("a.py", "modified"), ("old/b.py", "deleted"), ("pkg/mod.py", "created"), ("x/y/z/new.txt", "created")]
    assert changes(spark, root, *where) == []
    (root / "x/y/z/c.py").unlink()
    (root / "x/y/z/c.py").mkdir()
    assert changes(spark, root, *where) == [("x/y/z/c.py", "deleted")]
    assert all(len(list(d.iterdir())) <= 2 for d in (tmp_path / "state").iterdir())  # old listings go
    every = changes(spark, root, tmp_path / "s2", tmp_path / "c2", initial="all", slices=1)
    assert [p for p, _ in every] == ["a.py", "pkg/mod.py", "x/y/z/new.txt", "x/y/z/same.py"]


def test_a_batch_that_runs_again_gives_the_same_rows(tmp_path):
    root = write(tmp_path / "repo", ("", {"a.py": "1"}))
    reader = listing.WatchReader({"root": str(root), "state": str(tmp_path / "state"), "slices": "2"})
    read = lambda a, b: [r for p in reader.partitions({"at": a}, {"at": b}) for r in reader.read(p)]
    assert reader.initialOffset() == {"at": 0} and read(0, 5) == []
    (root / "b.py").write_text("")
    assert read(5, 9) == [("b.py", "created", 9)]
    (root / "b.py").unlink()
    (root / "c.py").write_text("")
    assert read(5, 9) == [("b.py", "created", 9)] and sorted(r[:2] for r in read(9, 12)) == [("b.py", "deleted"), ("c.py", "created")]
    reader.commit({"at": 9})
    assert sorted(r[:2] for r in read(9, 12)) == [("b.py", "deleted"), ("c.py", "created")]
    assert reader.latestOffset()["at"] > 10**12


def test_a_running_watch_sees_a_file_within_its_triggers(spark, tmp_path):
    root, seen = write(tmp_path / "repo", ("", {"a.py": ""})), []
    stream = I.watch(spark, str(root), str(tmp_path / "state"))
    query = stream.writeStream.foreachBatch(lambda df, k: seen.append([r["path"] for r in df.collect()])).trigger(processingTime=I.DEBOUNCE).start()
    try:
        until = time.time() + 90
        while not seen and time.time() < until:
            time.sleep(0.1)
        write(root, ("", {"pkg/mod.py": "x = 1\n", "pkg/mod.py.swp": "", "build/gen.py": ""}))
        while not any(seen) and time.time() < until:
            time.sleep(0.1)
    finally:
        query.stop()
    assert [p for batch in seen for p in batch] == ["pkg/mod.py"]


def test_a_watch_keeps_a_workshop_up_to_date(spark, tmp_path):
    root, events = write(tmp_path / "repo", ("", {"a.py": "def f(): pass\n"})), []
    shop = I.Workshop(spark, str(root), str(tmp_path / "store"), listen=lambda e, v: events.append(e))
    turn = lambda: I.follow(I.watch(spark, str(root), str(tmp_path / "state")), shop, str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    assert turn() and shop.build() and shop.token == 1
    (root / "b.py").write_text("from a import f\ndef fresh(): f()\n")
    assert turn() and shop.token == 2 and events == ["build", "reload"]
    assert {r["id"] for r in shop.current().nodes.collect()} >= {"main/b.fresh", "main/a.f"}
    assert I.Workshop(spark, str(root), str(tmp_path / "store")).token == 2


# store


def same(store, spark, root):
    return sinks.graph_json(store.load()) == sinks.graph_json(repository.analyse(spark, str(root)))


def test_updates_read_what_changed_and_share_the_rest(spark, mono, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "store"))
    assert store.update(str(mono), None) == 1 and same(store, spark, mono)
    first, files = store.manifest(), []
    read = repository.read_files
    monkeypatch.setattr(S.repository, "read_files", lambda paths, root: files.append(sorted(r["path"] for r in paths.collect())) or read(paths, root))
    before = fragments(store)
    (mono / "core/shop/services/cart.py").write_text("class Cart:\n    def add(self): pass\n")
    (mono / "core/shop/latin.py").unlink()
    assert store.update(str(mono), {"core/shop/services/cart.py", "core/shop/latin.py", "web/readme.md"}) == 2
    assert files == [["core/shop/services/cart.py"]]
    second = store.manifest()
    for a, b in zip(first["units"], second["units"], strict=True):
        assert (a == b) == (a["id"] != "core")
    assert len(fragments(store) - before) == 6 and before <= fragments(store)  # facts, four tables of one unit, links
    assert store.update(str(mono), {"notes.md", "build/x.py"}) == 2
    monkeypatch.setattr(S.repository, "read_files", read)
    assert same(store, spark, mono)
    old = sinks.graph_json(store.load(1))
    assert "latin.py" in old and "latin.py" not in sinks.graph_json(store.load())
    assert store.vacuum(keep=1) == 5 and same(store, spark, mono) and store.versions() == [2]


def test_many_updates_equal_a_cold_run(spark, mono, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_PARTS", 2)
    store = GraphStore(spark, str(tmp_path / "store"))
    store.update(str(mono), None)
    steps = [
        {"core/shop/new.py": "from shop.services.cart import Cart\ndef f(c: Cart): c.add(1)\n"}, {"core/shop/new.py": "def g(): pass\n", "core/shop/bad.py": "x = ("},
        {"core/shop/new.py": None, "web/src/bad.js": "export function ok() { return 1; }\n"}, {"bill/src/b/Main.java": None},
    ]
    for step in steps:
        for path, text in step.items():
            (mono / path).unlink() if text is None else (mono / path).write_text(text)
        store.update(str(mono), set(step))
    assert max(len(u["facts"]) for u in store.manifest()["units"]) <= 2 and same(store, spark, mono)
    (mono / "web/package.json").write_text(json.dumps({"name": "web", "dependencies": {"shop": "1"}}))
    store.update(str(mono), {"web/package.json"})
    assert same(store, spark, mono)


def test_units_of_a_single_project_come_and_go(spark, tmp_path):
    root = write(tmp_path / "repo", ("", {"a.py": "def f(): pass\n"}))
    store = GraphStore(spark, str(tmp_path / "store"))
    store.update(str(root), None)
    (root / "b.js").write_text("export function g() {}\n")
    store.update(str(root), {"b.js"})
    assert len(store.manifest()["units"]) == 2 and same(store, spark, root)
    (root / "b.js").unlink()
    store.update(str(root), {"b.js"})
    assert len(store.manifest()["units"]) == 1 and same(store, spark, root)
    (root / "a.py").unlink()
    with pytest.raises(repository.NothingToAnalyse):
        store.update(str(root), {"a.py"})
    assert store.versions()[-1] == 3 and GraphStore(spark, f"file://{tmp_path}/none").manifest() is None
    with pytest.raises(FileNotFoundError):
        GraphStore(spark, str(tmp_path / "none")).load()
