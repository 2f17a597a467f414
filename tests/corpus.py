"""A small repository to analyse, written to a folder."""

from pathlib import Path

PYTHON = {
    "shop/__init__.py": '"""A shop."""\n',
    "shop/cli.py": '''"""Commands."""
import click

from shop.services.cart import Cart, total
from .storage import repo as store

cart = Cart()


@click.command()
def main(n: int = 1) -> None:
    """Run."""
    c = Cart()
    c.add("x")
    cart.clear()
    total([1])
    getattr(c, "refresh")()
    c.repo.save(None)


@app.get("/items")
def items():
    return store.Repo().load()


if __name__ == "__main__":
    main()
''',
    "shop/services/__init__.py": "",
    "shop/services/cart.py": '''from __future__ import annotations

from abc import ABC
from shop.storage.repo import Repo


class Port(ABC):
    def pay(self) -> bool: ...


class Cart:
    items: list[Repo]

    def __init__(self, repo: Repo | None = None, *, limit: int = 3, **kw):
        self.repo: Repo = repo
        self.made = Repo()
        self.given = repo
        self._instance = None

    def add(self, name):
        if name and len(name) > 2 or name is None:
            for _ in range(3):
                self.repo.save(name)
        return [x for x in name if x]

    async def refresh(self): return self.made.load()

    @classmethod
    def get_instance(cls, a, /, b, *c) -> "Cart":
        """One."""

    def clear(self):
        def inner():
            self.add("walked: it stands right in the body")
        self._gone()

    def _gone(self): pass

    def _unused(self): pass


def total(xs): return sum(xs)
''',
    "shop/storage/__init__.py": "",
    "shop/storage/repo.py": '''import shop.cli


class Base: pass


class Repo(Base):
    def save(self, x): ...
    def load(self): return self.save(1)
''',
    "shop/broken.py": "def oops(:\n",
    "shop/latin.py": b"# \xe9\n",
    "node_modules/x.py": "x = 1\n",
}
SCRIPT = {
    "package.json": '{"name": "web", "dependencies": {"shop": "1"}}',
    "src/model.ts": '''/** The model. */

/** A thing. */
export abstract class Thing extends Base implements Named {
  private id: number;
  label = "a;b";

  constructor(id: number) { this.id = id; }

  /** Shown. */
  show(x: string = "}"): string | undefined {
    if (x && this.id ? true : false) { return this.#hide(x); }
    return /[/"]/.test(x) ? x : undefined;
  }

  #hide(x: string): string { return x; }
}

export interface Named { name(): string; }
export enum Level { Low, High }
class Base {}
''',
    "src/server.ts": '''import express from "express";
import { Thing as T, Level } from "./model";
const app = express();
app.get("/things", (req, res) => { res.json([]); });
export const make = async (n: number): Promise<T> => new T(n);
function local() { return make(1) ?? helper(`${1}`); }
export function helper(s: string) { local(); return new T(2); }
''',
    "src/bad.js": "export class {{{ broken\n",
}
JAVA = {
    "pom.xml": "<project><artifactId>billing</artifactId></project>",
    "src/a/Base.java": "package a;\n\n/** Base. */\npublic class Base {\n  protected int n;\n  public Base(int n) { this.n = n; }\n  public int twice() { return n > 1 && n < 9 ? n * 2 : 0; }\n}\n",
    "src/a/Bill.java": '''package a;

import b.Rule;
import java.util.List;

@Service
public class Bill extends Base implements Rule {
  private Rule rule;
  private List<String> names, others;

  public Bill(Rule rule) { super(1); this.rule = rule; }

  @GetMapping("/bill")
  public int run(Bill other, String s) {
    Base made = new Base(2);
    this.rule.apply(s);
    other.twice();
    twice();
    return made.twice() + super.twice();
  }

  public void apply(String s) { }
}
''',
    "src/b/Rule.java": "package b;\npublic interface Rule {\n  void apply(String s);\n}\n",
    "src/b/Main.java": "package b;\nclass Main {\n  public static void main(String[] args) { new Main(); }\n}\n",
    "src/b/Broken.java": "package b;\npublic class Broken { void oops( { } }\n",
}


def write(root: Path, *parts: tuple[str, dict]) -> Path:
    for folder, files in parts:
        for name, text in files.items():
            path = root / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


def pyproject(name: str, *deps: str) -> dict:
    return {"pyproject.toml": f'[project]\nname = "{name}"\ndependencies = [{", ".join(repr(d) for d in deps)}]\n'}
