"""HTML extraction by nearest-URL page differencing.

A page becomes lines, one a block. Pages are sorted by host, path and id; each
is paired with the page before it on its host (the first one with the next),
which shares the longest path prefix. All lines of both are aligned by a longest
common subsequence, and the lines of the page that both share are deleted.

Tags decide where the difference cannot. Each line is ``CONTENT`` (inside an
article or main element), ``CHROME`` (inside an element that by its name, role,
or a whole token of its class or id is menu, footer, sidebar, advert, form or
comments) or ``OPEN``. A shared line stays only if it is CONTENT: neighbouring
articles repeat passages. A line of the page's own goes only if it is CHROME:
menus and adverts may differ from page to page. Doubtful elements (a header in
an article, a class of ``notice``) are ``OPEN``. A name that holds such a word
beside others (``comments-area``, ``ad-slot``) is chrome if it names comments, and
``LIKELY`` else: of those lines a shared one goes, and of the page's own all but
long sentences; ``no-sidebar`` and its like name nothing. ``html`` and ``body`` are never
chrome, nor is another element that holds most of the page's text, unless it
stands beside an article and is no form; nor is one around an article, unless
its tag names chrome. ``n_lines`` counts a page's lines, ``n_shared`` those that go
and that the neighbour has, ``n_decided`` those of them that would stay without it.

The sorted sequence is cut into ranges of about equal bytes at sampled keys, one
a task. The page at a cut goes to the range before it, where its predecessor is,
and once more, as context only, to its own; so the pairs do not depend on the
cuts, a range is read as a stream with two pages in memory, and a hot host is
spread over many ranges.

Defined cases: a null html has no lines and an empty text; a null URL, or one
without ``://``, is a page of the empty host. A page alone on its host keeps
its OPEN lines. Rows repeat as they do in the input; an empty table gives an
empty result. Broken html never fails: unclosed elements end with the page.
Only the id, URL and html columns are read.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_stream
from .url_filter import split_url

OPEN, CONTENT, CHROME, LIKELY = 0, 1, 2, 3
#: Words of a sentence that is no slogan.
SENTENCE = 12
#: Sampled keys (expected number) for each range of the sorted pages.
SAMPLES_PER_RANGE = 24

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|select)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Elements that begin a block, that hold no main text, and words that name such parts.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr del rp rt math mi mn mo ms mtext mrow msup msub mfrac msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation masthead sidebar ad ads advert adverts advertisement advertising cookie cookies consent "
    "breadcrumb breadcrumbs comment comments commentlist disqus respond newsletter login signup pagination pager".split()
)
#: Words that name reader comments, also beside others in a name; and words that say that a part is not there.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond".split())
DENYING_WORDS = frozenset("no not non without has with hide hidden".split())
#: Words, and tags inside content, that may as well name a part of the main text; the difference decides on these.
DOUBTFUL_WORDS = frozenset(
    "menu header footer aside banner promo sponsor sponsored notice notification alert popup modal overlay share sharing "
    "social reply replies related subscribe subscription widget toolbar skip legal copyright".split()
)
DOUBTFUL_TAGS = frozenset("header footer aside".split())
#: Never chrome; and tags that name chrome, so that an article inside shows them unclosed.
PAGE_TAGS = frozenset("html body".split())
CONTENT_TAGS = frozenset("article main".split())
NAMING_TAGS = CHROME_TAGS - {"form"}


def _compound_role(tokens: list[str]) -> int | None:
    """What a word of chrome within a longer name says."""
    found = None
    for token in tokens:
        parts = re.split(r"[-_]+", token)
        if len(parts) > 1 and DENYING_WORDS.isdisjoint(parts):
            if not COMMENT_WORDS.isdisjoint(parts):
                return CHROME
            if not CHROME_WORDS.isdisjoint(parts):
                found = LIKELY
    return found


def _role_of(tag: str, attrs: str, in_content: bool) -> int | None:
    """``CHROME``, ``LIKELY``, ``OPEN`` if in doubt, or None for an element that says nothing."""
    if tag in PAGE_TAGS:
        return None
    if tag in CHROME_TAGS:
        return OPEN if in_content and tag in DOUBTFUL_TAGS else CHROME
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return None
    doubt = None
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            tokens = value.split()
            if not CHROME_WORDS.isdisjoint(tokens):
                return CHROME
            compound = _compound_role(tokens) if tag not in CONTENT_TAGS else None
            if compound == CHROME:
                return CHROME
            if compound is not None:
                doubt = compound
            elif doubt is None and not DOUBTFUL_WORDS.isdisjoint(tokens):
                doubt = OPEN
        elif name == "role" and value in CHROME_ROLES or name == "hidden":
            return CHROME
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return CHROME
    return doubt


class _Marked:
    """An element that is chrome or in doubt: its tag, role, place and the text in it."""

    __slots__ = ("tag", "role", "outer", "inside", "depth", "chars", "exempt")

    def __init__(self, tag: str, role: int, outer: _Marked | None, inside: bool):
        self.tag, self.role, self.outer, self.inside = tag, role, outer, inside
        self.depth, self.chars, self.exempt = 1, 0, False


def lines(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text."""
    page = page or ""
    found: list[tuple[_Marked | None, bool, str]] = []
    parts: list[str] = []
    marked: list[_Marked] = []
    stack: list[_Marked] = []
    by_tag: dict[str, list[_Marked]] = {}
    content = {"article": 0, "main": 0}
    place: tuple[_Marked | None, bool] = (None, False)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((*place, text))
            parts.clear()

    def pop() -> None:
        by_tag[stack.pop().tag].pop()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("script", "style", "noscript", "template"):
                flush()
            continue
        tag = tag.lower()
        closing = bool(m["close"] or m["close2"])
        if tag not in INLINE:
            flush()
        same = by_tag.get(tag)
        if stack and not closing and (tag == "body" or tag in content and not same):
            while stack:  # an unclosed menu does not swallow the article, nor a head the body
                stack[-1].exempt |= tag in content and stack[-1].tag not in NAMING_TAGS
                pop()
        in_content = bool(content["article"] or content["main"])
        role = None if closing or tag in VOID else _role_of(tag, m["attrs"] or m["attrs2"] or "", in_content)
        if role is not None:
            element = _Marked(tag, role, stack[-1] if stack else None, in_content)
            marked.append(element)
            stack.append(element)
            by_tag.setdefault(tag, []).append(element)
        elif same:
            same[-1].depth += -1 if closing else 1
            if not same[-1].depth:
                element = same[-1]
                while stack[-1] is not element:
                    pop()
                pop()
        elif tag in content:
            while closing and stack and stack[-1].inside:  # nor does an unclosed advert what follows the article
                pop()
            content[tag] = max(0, content[tag] + (-1 if closing else 1))
        now = (stack[-1] if stack else None, bool(content["article"] or content["main"]))
        if now != place:
            flush()
            place = now
    if at < len(page):
        parts.append(page[at:])
    flush()

    total, beside = 0, False
    for element, inside, text in found:
        total += len(text)
        beside |= inside and element is None
        if element:
            element.chars += len(text)
    for e in reversed(marked):
        if e.outer:
            e.outer.chars += e.chars
    kinds: dict[_Marked | None, int | None] = {None: None}
    for e in marked:  # those outside come first
        large = e.chars * 2 > total and (e.inside or e.tag == "form" or not beside)
        role = None if e.exempt or large and e.role in (CHROME, LIKELY) else e.role
        outer = kinds[e.outer]
        kinds[e] = next((k for k in (CHROME, LIKELY) if k in (outer, role)), role if outer is None else outer)
    return [(CONTENT if kinds[e] is None and inside else OPEN if kinds[e] is None else kinds[e], text) for e, inside, text in found]


def _prefix_lengths(a: list, b: list) -> list[int]:
    """Lengths of the longest common subsequence of ``a`` with each prefix of ``b``, by bits."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    zero = np.frombuffer(f"{v:0{len(b)}b}"[::-1].encode(), np.uint8) == ord("0") if b else np.zeros(0, bool)
    return [0, *np.cumsum(zero).tolist()]


#: Bits of the rows kept for one alignment; larger ones are halved.
_KEPT_BITS = 1 << 28


def shared(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = set(range(start)) | set(range(len(a) - end, len(a)))
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    if not x or not y:
        return out
    if len(x) * len(y) > _KEPT_BITS and len(x) > 1:
        half = len(x) // 2
        ahead = _prefix_lengths(x[:half], y)
        behind = _prefix_lengths(x[half:][::-1], y[::-1])[::-1]
        j = int(np.argmax(np.add(ahead, behind)))
        return out | {start + i for i in shared(x[:half], y[:j])} | {start + half + i for i in shared(x[half:], y[j:])}
    where: dict = {}
    for j, t in enumerate(y):
        where[t] = where.get(t, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for t in x:
        v = rows[-1]
        u = v & where.get(t, 0)
        rows.append((v + u | v - u) & full)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> j - 1 & 1:  # the last of b adds nothing
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:  # it added something without the last of a
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.add(start + i)
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def is_sentence(text: str) -> bool:
    return text.rstrip("\"'»”’)").endswith((".", "!", "?", "…")) and text.count(" ") >= SENTENCE - 1


def main_text(kinds: list[int], marks: list[int], texts: list[str], other: list[int] | None) -> tuple[str, int, int]:
    """The text that stays of a page beside the line hashes of its neighbour, the number of shared lines deleted, and of those among them that would stay alone."""
    both = shared(marks, other) if other else set()
    alone = [k == CHROME or k == LIKELY and not is_sentence(t) for k, t in zip(kinds, texts, strict=True)]
    gone = [kinds[i] != CONTENT if i in both else g for i, g in enumerate(alone)]
    text = " ".join(t for t, g in zip(texts, gone, strict=True) if not g)
    return text, sum(gone[i] for i in both), sum(gone[i] and not alone[i] for i in both)


def _cuts(keys: DataFrame, ranges: int) -> list[tuple[tuple, bool]]:
    """At most ``ranges - 1`` keys in order that part about equal bytes, each with whether it is the first of its host.

    The sample (by hash, each key standing for its weight in bytes and the even
    share of the rest) only says where ranges begin; its size depends on
    ``ranges``, not on the pages.
    """
    names = ["host", "path", "has_id", "id"]
    total = keys.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    if ranges < 2 or not total["n"]:
        return []
    step = max(1, total["n"] // (ranges * SAMPLES_PER_RANGE))
    sampled = keys.where(F.pmod(F.xxhash64(*names), F.lit(step)) == 0).groupBy(*names).agg(F.sum("weight").alias("weight"))
    found = sorted(((r["host"], r["path"], r["has_id"], r["id"]), r["weight"]) for r in sampled.collect())
    mean = total["w"] / total["n"]
    weights = np.array([w + mean * (step - 1) for _, w in found])
    ends = np.cumsum(weights)
    picked = sorted({int(np.searchsorted(ends, ends[-1] * k / ranges)) for k in range(1, ranges)}) if found else []
    cuts = [found[i][0] for i in picked if i < len(found)]
    hosts = keys.sparkSession.createDataFrame([(h,) for h in sorted({c[0] for c in cuts})], "host string")
    least = keys.join(F.broadcast(hosts), "host", "left_semi").groupBy("host").agg(F.min(F.struct("path", "has_id", "id")).alias("least"))
    first = {r["host"]: tuple(r["least"]) for r in least.collect()}
    return [(c, first[c[0]] == c[1:]) for c in cuts]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, n_decided) of each page."""
    host, path = split_url(pages[url_col].cast("string"))
    page_id = pages[id_col].cast("long")
    key = [
        host.alias("host"), path.alias("path"), page_id.isNotNull().alias("has_id"), F.coalesce(page_id, F.lit(0)).alias("id"),
    ]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.coalesce(F.octet_length(pages[html_col].cast("string")), F.lit(0)).alias("weight")
    found = _cuts(pages.select(*key, weight), parts)
    shared_cuts = pages.sparkSession.sparkContext.broadcast(([k for k, _ in found], {k: first for k, first in found}))
    rows = pages.select(*key, pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    names = ["range", "host", "path", "has_id", "id", "mark", "url", "kinds", "marks", "texts", "owned"]

    def make_lines():
        cuts, first_of_host = shared_cuts.value

        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            for c in batches:
                out: dict[str, list] = {n: [] for n in names}
                for host, path, has_id, page, url, page_html in zip(*(c[n] for n in ("host", "path", "has_id", "id", "url", "html")), strict=True):
                    found = lines(page_html)
                    kinds = [k for k, _ in found]
                    row = [
                        host, path, has_id, page, _hash(page_html or ""), url,
                        kinds, [_hash(t) for _, t in found], ["" if k == CHROME else t for k, t in found],
                    ]
                    own = (host, path, has_id, page)
                    at = bisect.bisect_right(cuts, own)
                    copies = [(at, True)]
                    if first_of_host.get(own) is False:
                        copies = [(at - 1, True), (at, False)]
                        context = [*row[:8], [""] * len(found)]
                    for place, owned in copies:
                        for name, value in zip(names, [place, *(row if owned else context), owned], strict=True):
                            out[name].append(value)
                yield out

        return run

    schema = (
        "range int, host string, path string, has_id boolean, id long, mark long, url string, "
        "kinds array<tinyint>, marks array<long>, texts array<string>, owned boolean"
    )
    lined = map_stream(rows, make_lines, schema)
    order = ["range", "host", "path", "has_id", "id", "mark", "url"]
    dealt = lined.repartitionById(len(found) + 1, F.col("range")).sortWithinPartitions(*order)

    result = ("page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_decided")

    def make_pairs():
        def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
            before: dict | None = None  # the row before, of any host
            waiting: dict | None = None  # the first row of a host, until the next row is here

            def emit(out: dict[str, list], row: dict, other: list[int] | None) -> None:
                text, n_shared, n_decided = main_text(row["kinds"], row["marks"], row["texts"], other)
                out["page_id"].append(row["id"] if row["has_id"] else None)
                out["url"].append(row["url"])
                out["text"].append(text)
                out["n_chars"].append(len(text))
                out["n_lines"].append(len(row["kinds"]))
                out["n_shared"].append(n_shared)
                out["n_decided"].append(n_decided)

            for c in batches:
                out: dict[str, list] = {n: [] for n in result}
                for values in zip(*(c[n] for n in names), strict=True):
                    row = dict(zip(names, values, strict=True))
                    near = before is not None and (before["range"], before["host"]) == (row["range"], row["host"])
                    if waiting is not None:
                        emit(out, waiting, row["marks"] if near else None)
                        waiting = None
                    if row["owned"]:
                        if near:
                            emit(out, row, before["marks"])
                        else:
                            waiting = row
                    before = row
                yield out
            if waiting is not None:
                out = {n: [] for n in result}
                emit(out, waiting, None)
                yield out

        return run

    return map_stream(dealt.select(*names), make_pairs, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_decided long")
