"""Raw facts of JavaScript, TypeScript and Java sources, by a scanner of our own.

A tokenizer and bracket matching find declarations, members and calls; bodies
are not parsed as grammar. A file whose brackets or literals do not close, or
whose declarations lack a name or a body, counts as broken and is skipped
whole. The rows are those of :mod:`python_facts`.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

BROKEN = "erreurs de syntaxe (arbre partiel)"
TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*|#[^\W\d]\w*)|(?P<sign>=>|\?\.|\?\?|&&|\|\||\.\.\.|::|[{}()\[\];,.:?=<>@!+\-*/%&|^~])|(?P<bad>\S)",
    re.DOTALL,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Decisions, route objects and verbs, and words that are no names of calls.
DECISIONS = frozenset({"if", "for", "while", "catch", "case"})
OPERATORS = frozenset({"&&", "||", "??"})
ROUTE_OBJECTS, ROUTE_VERBS = frozenset({"app", "router", "server", "api"}), frozenset({"get", "post", "put", "delete", "patch"})
KEYWORDS = frozenset(
    "if for while switch catch return function class new typeof instanceof in of await yield else do try finally throw delete void case default super this import export const let var "
    "extends implements synchronized assert break continue package interface enum static public private protected final abstract".split()
)
MODIFIERS = frozenset("public private protected static readonly async abstract override get set declare accessor final synchronized native transient volatile default strictfp sealed".split())


@dataclass
class Tok:
    kind: str
    text: str
    at: int
    line: int
    mate: int = -1  # of a bracket, the index of its partner


class Broken(ValueError):
    pass


def tokens(text: str, regexes: bool) -> list[Tok]:
    out: list[Tok] = []
    stack: list[int] = []
    at, line, n = 0, 1, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            break
        line += text.count("\n", at, m.start())
        kind = m.lastgroup
        if kind == "sign" and m[0] == "/" and regexes:
            last = next((t for t in reversed(out) if t.kind != "comment"), None)
            if (last is None or last.kind == "sign" and last.text not in ")]}" or last.text in ("return", "typeof", "case")) and (r := REGEX.match(text, m.start())):
                out.append(Tok("string", r[0], r.start(), line))
                at = r.end()
                continue
        if kind == "bad" or kind == "sign" and text.startswith("/*", m.start()):
            raise Broken(m[0])
        tok = Tok(kind, m[0], m.start(), line)
        if kind == "sign" and m[0] in "([{":
            stack.append(len(out))
        elif kind == "sign" and m[0] in PAIRS:
            if not stack or out[stack[-1]].text != PAIRS[m[0]]:
                raise Broken(m[0])
            tok.mate = stack.pop()
            out[tok.mate].mate = len(out)
        out.append(tok)
        line += m[0].count("\n")
        at = m.end()
    if stack:
        raise Broken("not closed")
    return out


def doc_of(comment: str) -> str:
    """The text of a ``/** */`` comment, without stars and blank lines."""
    inner = comment.removeprefix("/**").removesuffix("*/")
    return "\n".join(x for x in (line.strip().lstrip("*").strip() for line in inner.splitlines()) if x)


class Scanner:
    """Common walking over the tokens of one file."""

    doc_format = ""

    def __init__(self, sub: str, path: str, text: str, regexes: bool) -> None:
        self.sub, self.path, self.text = sub, path, text
        every = tokens(text, regexes)
        self.docs: dict[int, str] = {}
        self.toks: list[Tok] = []
        moved: dict[int, int] = {}
        doc = None
        for i, t in enumerate(every):
            if t.kind == "comment":
                doc = doc_of(t.text) if t.text.startswith("/**") and len(t.text) > 4 else None
                continue
            moved[i] = len(self.toks)
            if doc:
                self.docs[len(self.toks)] = doc
            doc = None
            self.toks.append(t)
        for t in self.toks:
            t.mate = moved.get(t.mate, -1)
        self.first_doc = doc_of(every[0].text) if every and every[0].text.startswith("/**") else None
        self.module = ""
        self.rows: list[dict] = []

    def add(self, fact: str, **values) -> None:
        self.rows.append({"fact": fact, "sub": self.sub, "path": self.path, "module": self.module, "doc_format": self.doc_format, **values})

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind != "string" and self.toks[i].text in texts

    def name(self, i: int) -> str:
        if i >= len(self.toks) or self.toks[i].kind != "name":
            raise Broken("a name is missing")
        return self.toks[i].text

    def source(self, a: int, b: int) -> str:
        """Source text from token a to before token b."""
        end = self.toks[b].at if b < len(self.toks) else len(self.text)
        return self.text[self.toks[a].at : end].strip() if a < b else ""

    def find(self, i: int, end: int, *texts: str) -> int:
        """The next of some signs at this level, or ``end``."""
        while i < end and not self.is_(i, *texts):
            i = self.toks[i].mate + 1 if self.is_(i, "(", "[", "{") else i + 1
        return min(i, end)

    def end_line(self, i: int) -> int:
        return self.toks[min(i, len(self.toks) - 1)].line

    def decisions(self, a: int, b: int) -> int:
        total = 1
        for i in range(a, b):
            t = self.toks[i]
            total += t.kind == "name" and t.text in DECISIONS or t.kind == "sign" and (t.text in OPERATORS or t.text == "?" and not self.is_(i + 1, ":", ")", ",", ";", "=", ".", ">"))
        return total

    def nested(self, i: int) -> int:
        """Where a class or function that begins here ends; i if none does."""
        if self.is_(i, "class", "function") and not self.is_(i - 1, "."):
            body = self.find(i + 1, len(self.toks), "{", ";", ")", ",")
            if self.is_(body, "{"):
                return self.toks[body].mate
        return i


class Script(Scanner):
    """JavaScript and TypeScript."""

    doc_format = "jsdoc"

    def run(self) -> list[dict]:
        stem = self.path.rsplit(".", 1)[0]
        self.module = stem.replace("/", ".")
        marks = set(self._routes())
        i = 0
        decl_doc = None
        while i < len(self.toks):
            start = i
            decl_doc = self.docs.get(i)
            while self.is_(i, "export", "default", "declare", "abstract", "async") and not self.is_(i + 1, "("):
                i += 1
            if self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                i = self._import(i, marks)
            elif self.is_(i, "class"):
                i = self._type(i, "class", decl_doc)
            elif self.is_(i, "interface", "enum") and i + 1 < len(self.toks) and self.toks[i + 1].kind == "name":
                i = self._type(i, self.toks[i].text, decl_doc)
            elif self.is_(i, "function"):
                at = i + 1 + self.is_(i + 1, "*")
                i = self._function(at, i, self.module, False, self.is_(i - 1, "async"), decl_doc)
            elif self.is_(i, "const", "let"):
                i = self._arrow(i, decl_doc)
            else:
                i = self.toks[i].mate + 1 if i < len(self.toks) and self.is_(i, "(", "[", "{") else max(i, start) + 1
        self.add("module", name=self.module.rsplit(".", 1)[-1], line=1, doc=self.first_doc, modifiers=sorted(marks), loc=len(self.text.splitlines()), text=stem)
        return self.rows

    def _routes(self):
        for i in range(len(self.toks) - 4):
            t = self.toks
            if t[i].text in ROUTE_OBJECTS and not self.is_(i - 1, ".") and self.is_(i + 1, ".") and t[i + 2].text in ROUTE_VERBS and self.is_(i + 3, "(") and t[i + 4].kind == "string" and t[i + 4].text[0] != "`":
                yield f"route:{t[i + 2].text.upper()} {t[i + 4].text[1:-1]}"

    def _import(self, i: int, marks: set[str]) -> int:
        j, pairs = i + 1, []
        while j < len(self.toks) and self.toks[j].kind != "string" and not self.is_(j, ";"):
            if self.is_(j, "{"):
                k = j + 1
                while k < self.toks[j].mate:
                    k += self.is_(k, "type") and self.toks[k + 1].kind == "name" and not self.is_(k + 1, "as")
                    if self.toks[k].kind == "name":
                        shown = self.toks[k].text
                        alias = self.toks[k + 2].text if self.is_(k + 1, "as") else shown
                        pairs.append((shown, alias))
                        k += 2 if self.is_(k + 1, "as") else 0
                    k += 1
                j = self.toks[j].mate
            j += 1
        if j >= len(self.toks) or self.toks[j].kind != "string":
            return j + 1
        spec = self.toks[j].text[1:-1]
        if spec.startswith("."):
            target = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), spec))
            self.add("import", token=target, line=1, ord=i)
            for k, (shown, alias) in enumerate(pairs):
                self.add("import", token=target, name=shown, text=alias, line=1, ord=i + k)
        else:
            parts = spec.split("/")
            marks.add("ext-import:" + ("/".join(parts[:2]) if spec.startswith("@") else parts[0]))
        return j + 1

    def _type(self, i: int, kind: str, doc: str | None) -> int:
        name = self.name(i + 1)
        cls = f"{self.module}.{name}"
        body = self.find(i + 2, len(self.toks), "{", ";")
        if not self.is_(body, "{"):
            raise Broken(name)
        end = self.toks[body].mate
        self.add("class", owner=self.module, name=name, line=self.toks[i].line, loc=self.end_line(end) - self.toks[i].line + 1, text=kind, doc=doc)
        how = "inherits"
        for j in range(i + 2, body):
            if self.is_(j, "extends", "implements"):
                how = "implements" if self.toks[j].text == "implements" else "inherits"
            elif self.toks[j].kind == "name":
                self.add("link", owner=cls, token=f"N:{self.toks[j].text}", line=self.toks[j].line, text=how)
        j = body + 1
        while kind == "class" and j < end:
            j = self._member(j, end, cls)
        return end + 1

    def _member(self, j: int, end: int, cls: str) -> int:
        start, marks, doc = j, set(), self.docs.get(j)
        while self.is_(j, "@"):
            j += 2
            j = self.toks[j].mate + 1 if self.is_(j, "(") else j
        while j < end and (self.toks[j].text in MODIFIERS or self.is_(j, "*")) and not self.is_(j + 1, "(", "=", ":", ";", "?"):
            marks.add(self.toks[j].text)
            j += 1
        if j >= end or self.toks[j].kind not in ("name", "string") and not self.is_(j, "["):
            return max(j, start) + 1
        if self.is_(j, "[", "{"):
            return self.find(self.toks[j].mate + 1, end, ";", "{") + 1
        name = self.toks[j].text.strip("'\"")
        generic = self.find(j + 1, end, "(", ";", "=", ":", "{") if self.is_(j + 1, "<") else j + 1
        private = bool(marks & {"private", "protected"}) or name.startswith(("_", "#"))
        if self.is_(generic, "("):
            return self._function(j, start, cls, True, "async" in marks, doc, marks, private)
        last = j + 1
        while last < end and not self.is_(last, ";"):
            if self.toks[last].line > self.toks[last - 1].line and self.toks[last - 1].text not in ("=", ":", "|", "&", ",", "=>") and not self.is_(last, "=", "|", "&", ".", "?"):
                break
            last = self.toks[last].mate + 1 if self.is_(last, "(", "[", "{") else last + 1
        typed = ""
        after = j + 1 + self.is_(j + 1, "?", "!")
        if self.is_(after, ":"):
            typed = self.source(after + 1, self.find(after + 1, last, "="))
        self.add("field", owner=cls, name=name, line=self.toks[start].line, ord=j, text=typed.rstrip(";").strip(), flag=private)
        return last + self.is_(last, ";")

    def _function(self, at: int, start: int, parent: str, is_method: bool, is_async: bool, doc: str | None, marks: set[str] = frozenset(), private: bool | None = None) -> int:
        name = self.toks[at].text.strip("'\"") if is_method else self.name(at)
        open_ = self.find(at + 1, len(self.toks), "(", "{", ";")
        if not self.is_(open_, "("):
            raise Broken(name)
        close = self.toks[open_].mate
        body = self.find(close + 1, len(self.toks), "{", ";")
        if self.is_(close + 1, ":") and self.is_(close + 2, "{"):  # an object type comes before the body
            body = self.find(self.toks[close + 2].mate + 1, len(self.toks), "{", ";")
        if not self.is_(body, "{"):
            return body + 1
        returns = self.source(close + 2, body) if self.is_(close + 1, ":") else ""
        self._emit(name, parent, is_method, start, self.source(open_, close + 1), returns, body, self.toks[body].mate, is_async, doc, marks, private)
        return self.toks[body].mate + 1

    def _emit(self, name, parent, is_method, start, params, returns, body, end, is_async, doc, marks=frozenset(), private=None) -> None:
        words = sorted(({"async"} if is_async else set()) | ({"static"} if "static" in marks else set()))
        self.add(
            "function", owner=parent, name=name, line=self.toks[start].line, flag=is_method, text=params + (f" -> {returns}" if returns else ""), doc=doc, modifiers=words,
            number=self.decisions(body + 1, end), loc=self.end_line(end) - self.toks[start].line + 1, ord=int(name.startswith("_") if private is None else private),
        )
        self._calls(f"{parent}.{name}@{self.toks[start].line}", body + 1, end, parent if is_method else None)

    def _calls(self, scope: str, a: int, b: int, cls: str | None) -> None:
        i = a
        while i < b:
            i = max(i, self.nested(i))
            t = self.toks[i]
            if self.is_(i, "new") and i + 1 < b and self.toks[i + 1].kind == "name" and not self.is_(i + 2, "."):
                self.add("call", owner=scope, text="new", name=self.toks[i + 1].text, token=f"N:{self.toks[i + 1].text}", line=t.line, ord=i)
                i += 1
            elif t.kind == "name" and self.is_(i + 1, "(") and t.text not in KEYWORDS and not self.is_(i - 1, ".", "?.", "function", "new"):
                self.add("call", owner=scope, text="name", name=t.text, token=f"N:{t.text}", line=t.line, ord=i)
            elif cls and self.is_(i, "this") and self.is_(i + 1, ".") and self.is_(i + 3, "("):
                self.add("call", owner=scope, text="this", name=self.toks[i + 2].text, token=f"t:{cls}", line=t.line, ord=i)
            i += 1

    def _arrow(self, i: int, doc: str | None) -> int:
        end = self.find(i + 1, len(self.toks), ";")
        if i + 1 >= len(self.toks) or self.toks[i + 1].kind != "name":
            return i + 1
        name, eq = self.toks[i + 1].text, self.find(i + 2, end, "=", ",")
        j = eq + 1
        is_async = self.is_(j, "async")
        j += is_async
        if self.is_(eq, "=") and (self.is_(j, "(") or j < len(self.toks) and self.toks[j].kind == "name" and self.is_(j + 1, "=>")):
            close = self.toks[j].mate if self.is_(j, "(") else j
            arrow = self.find(close + 1, end, "=>", "{", ",")
            if self.is_(arrow, "=>"):
                returns = self.source(close + 2, arrow) if self.is_(close + 1, ":") else ""
                last = self.toks[arrow + 1].mate if self.is_(arrow + 1, "{") else end
                words = ["async"] * is_async
                self.add(
                    "function", owner=self.module, name=name, line=self.toks[i].line, flag=False, text=self.source(j, close + 1) + (f" -> {returns}" if returns else ""), doc=doc,
                    modifiers=words, number=self.decisions(arrow + 1, last), loc=self.end_line(last) - self.toks[i].line + 1, ord=int(name.startswith("_")),
                )
                return last + 1
        return eq + 1


class Java(Scanner):
    """Java."""

    doc_format = "javadoc"

    def run(self) -> list[dict]:
        stem = posixpath.basename(self.path).rsplit(".", 1)[0]
        package, i = "", 0
        if self.is_(0, "package"):
            end = self.find(0, len(self.toks), ";")
            package, i = self.source(1, end).replace(" ", ""), end + 1
        self.module = f"{package}.{stem}" if package else stem
        self.package = package
        while i < len(self.toks):
            if self.is_(i, "import"):
                end = self.find(i, len(self.toks), ";")
                dotted = "".join(t.text for t in self.toks[i + 1 : end] if t.text != "static")
                self.add("import", token=dotted, text=dotted.rsplit(".", 1)[-1], line=1, ord=i, names=[package])
                i = end + 1
            elif self.is_(i, ";"):
                i += 1
            else:
                i = self._type(i)
        self.add("module", name=stem, line=1, doc=None, modifiers=[], loc=len(self.text.splitlines()), text=package)
        return self.rows

    def _marks(self, i: int) -> tuple[int, list[str], bool]:
        marks: list[str] = []
        private = False
        while True:
            if self.is_(i, "@") and not self.is_(i + 1, "interface"):
                j = i + 2
                while self.is_(j, "."):
                    j += 2
                j = self.toks[j].mate + 1 if self.is_(j, "(") else j
                marks.append("decorator:" + self.source(i + 1, j))
                i = j
            elif i < len(self.toks) and self.toks[i].text in MODIFIERS:
                private |= self.toks[i].text in ("private", "protected")
                if self.toks[i].text not in ("public", "private", "protected"):
                    marks.append(self.toks[i].text)
                i += 1
            else:
                return i, marks, private

    def _type(self, i: int) -> int:
        start, doc = i, self.docs.get(i)
        i, marks, private = self._marks(i)
        i += self.is_(i, "@")
        if not self.is_(i, "class", "interface", "enum", "record"):
            raise Broken("a type is missing")
        kind = {"record": "class"}.get(self.toks[i].text, self.toks[i].text)
        name = self.name(i + 1)
        cls = f"{self.module}.{name}"
        body = self.find(i + 2, len(self.toks), "{", ";")
        if not self.is_(body, "{"):
            raise Broken(name)
        end = self.toks[body].mate
        self.add("class", owner=self.module, name=name, line=self.toks[start].line, loc=self.end_line(end) - self.toks[start].line + 1, text=kind, doc=doc, modifiers=sorted(set(marks)), ord=int(private), names=[self.package])
        how, j = "", i + 2
        while j < body:
            if self.is_(j, "extends", "implements"):
                how = "inherits" if self.toks[j].text == "extends" else "implements"
            elif how and self.toks[j].kind == "name" and not self.is_(j - 1, ".", "<"):
                self.add("link", owner=cls, token=f"N:{self.toks[j].text}", line=self.toks[j].line, text=how)
                if self.is_(j + 1, "<"):
                    j = self.find(j + 1, body, ",", "implements", "extends") - 1
            j += 1
        j = body + 1
        if kind == "enum":
            j = self.find(j, end, ";") + 1
        while j < end:
            j = self._member(j, end, cls, name, kind)
        return end + 1

    def _member(self, j: int, end: int, cls: str, type_name: str, kind: str) -> int:
        start, doc = j, self.docs.get(j)
        j, marks, private = self._marks(j)
        if j >= end or self.is_(j, ";"):
            return j + 1
        if self.is_(j, "{"):
            return self.toks[j].mate + 1
        if self.is_(j, "class", "interface", "enum", "record"):
            return self.toks[self.find(j, end, "{")].mate + 1
        stop = self.find(j, end, "(", "=", ";", "{")
        if self.is_(stop, "("):
            name, close = self.name(stop - 1), self.toks[stop].mate
            body = self.find(close + 1, end, "{", ";")
            typed = self.source(j, stop - 1)
            text = self.source(stop, close + 1) + (f" -> {typed}" if typed else "")
            last = self.toks[body].mate if self.is_(body, "{") else body
            number = self.decisions(body + 1, last) if self.is_(body, "{") else 1
            line = self.toks[start].line
            self.add("function", owner=cls, name=name, line=line, flag=True, text=text, doc=doc, modifiers=sorted(set(marks)), number=number, loc=self.end_line(last) - line + 1, ord=int(private))
            scope = f"{cls}.{name}@{line}"
            self._typed(scope, "param", stop + 1, close)
            if self.is_(body, "{"):
                self._body(scope, cls, body + 1, last)
            return last + 1
        semi, angle, stop = self.find(stop, end, ";"), 0, j
        while stop < semi and (angle or not self.is_(stop, ",", "=")):  # commas of type arguments do not end a declarator
            angle += self.is_(stop, "<") - self.is_(stop, ">")
            stop += 1
        typed_end = stop - 1
        typed = self.source(j, typed_end)
        first = re.match(r"[^\W\d][\w$]*", typed)
        names, k = [self.name(typed_end)], stop
        while k < semi:
            k = self.find(k, semi, ",")
            if k < semi and self.toks[k + 1].kind == "name":
                names.append(self.toks[k + 1].text)
            k += 1
        for n in names:
            self.add("field", owner=cls, name=n, line=self.toks[start].line, ord=j, text=typed, names=[f"N:{first[0]}"] if first else [], modifiers=sorted(set(marks)), flag=private)
        return semi + 1

    def _typed(self, scope: str, fact: str, a: int, b: int) -> None:
        """Pairs ``Type name`` of a parameter list."""
        while a < b:
            end = self.find(a, b, ",")
            depth = 0
            for k in range(a, end):  # a comma within <> does not end a parameter
                depth += self.is_(k, "<") - self.is_(k, ">")
            while depth > 0 and end < b:
                depth -= sum(self.is_(k, ">") for k in range(end, self.find(end + 1, b, ",")))
                end = self.find(end + 1, b, ",")
            first = next((self.toks[k].text for k in range(a, end) if self.toks[k].kind == "name" and self.toks[k].text != "final" and not self.is_(k - 1, "@")), None)
            if first and end - 1 > a and self.toks[end - 1].kind == "name":
                self.add(fact, owner=scope, name=self.toks[end - 1].text, names=[f"N:{first}"])
            a = end + 1

    def _body(self, scope: str, cls: str, a: int, b: int) -> None:
        i = a
        while i < b:
            i = max(i, self.nested(i))
            t = self.toks[i]
            begins = self.is_(i - 1, "{", "}", ";", "(") or i == a
            if begins and t.kind == "name" and t.text not in KEYWORDS:
                j = self.find(i + 1, b, "=", ";", ":", "(", ".") if not self.is_(i + 1, "(", ".", "=") else i
                if j > i + 1 and self.toks[j - 1].kind == "name" and self.is_(j, "=", ";", ":") and (j == i + 2 or self.is_(i + 1, "<", "[")):
                    self.add("local", owner=scope, name=self.toks[j - 1].text, ord=i, names=[f"N:{t.text}"])
            call = None
            if self.is_(i, "new") and i + 1 < b and self.toks[i + 1].kind == "name":
                made = self.toks[i + 1].text
                call = ("new", made, f"N:{made}", [])
            elif t.kind == "name" and self.is_(i + 1, "(") and t.text not in KEYWORDS and not self.is_(i - 1, "new"):
                if not self.is_(i - 1, "."):
                    call = ("this", t.text, f"t:{cls}", [])
                elif self.is_(i - 2, "this", "super"):
                    call = (self.toks[i - 2].text, t.text, f"t:{cls}", [])
                elif self.toks[i - 2].kind == "name" and not self.is_(i - 3, "."):
                    call = ("var", t.text, f"n:{self.toks[i - 2].text}", [])
                elif self.toks[i - 2].kind == "name" and self.is_(i - 3, ".") and self.is_(i - 4, "this"):
                    call = ("field", t.text, f"n:{self.toks[i - 2].text}", [])
            if call:
                self.add("call", owner=scope, text=call[0], name=call[1], token=call[2], attrs=[cls], line=t.line, ord=i)
            i += 1


def extract(sub: str, path: str, text: str) -> list[dict]:
    """The facts of one file; a broken one is one ``skip``."""
    try:
        scanner = Java(sub, path, text, False) if path.endswith(".java") else Script(sub, path, text, True)
        return scanner.run()
    except (Broken, IndexError):
        return [{"fact": "skip", "sub": sub, "path": path, "text": BROKEN}]
