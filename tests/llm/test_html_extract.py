import random

from cartolith.llm import html_extract as H

from .helpers import pages, rows


def length(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_is_longest(monkeypatch):
    r = random.Random(3)
    for bits in (1 << 28, 16):
        monkeypatch.setattr(H, "_KEPT_BITS", bits)
        for _ in range(400):
            a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
            found = [a[i] for i in sorted(H.shared(a, b))]
            rest = iter(b)
            assert all(x in rest for x in found) and len(found) == length(a, b)


def test_lines():
    page = (
        '<head><title>no</title></head><body><nav><li>menu</nav><div class="ad">x</div><article><h1>T &amp; U&nbsp;V</h1>'
        '<p>on<b>e</b><br><p>two<script>"</p>"</script> t<!-- c -->wo<div class="comments"><p>c<div>d</div></div><form>f</form>'
        '<p title="a>b">five &am</article>tail<footer>f'
    )
    assert [t for k, t in H.lines(page) if k == H.CONTENT] == ["T & U V", "one", "two two", "five &am"]
    assert [t for k, t in H.lines(page) if k == H.OPEN] == ["tail"]
    assert H.lines(None) == H.lines("") == []
    assert H.lines("<<p a='>x<") != [] and H.lines("<p " + "a=\"" * 20000)  # broken html ends
    assert H.main_text(*[[] for _ in range(3)], None) == ("", 0, 0)


def page(lines, article=False):
    body = "".join(f"<p>{x}</p>" for x in lines)
    return f"<article>{body}</article>" if article else f"<body>{body}</body>"


def test_differencing_with_the_nearest_url(spark):
    items = [
        (1, "http://h/a/1", page(["menu", "own one", "foot"])),
        (2, "http://h/a/2", page(["menu", "own two", "foot"])),
        (3, "http://h/b/1", page(["menu", "own three", "foot", "foot"])),
        (4, "http://g/a", page(["menu", "alone", "foot"])),
        (5, "http://h/a/3", page(["menu", "own two", "more"], article=True)),
        (6, None, None), (None, "", ""), (None, "no url", page(["left"])),
        (7, "http://k/x", page(["same"])), (7, "http://k/x", page(["same"])),
    ]
    found = rows(H.extract(pages(spark, items)), "page_id", "text", "n_chars")
    want = [(1, "own one"), (2, "own two"), (3, "own three foot foot"), (4, "menu alone foot"), (5, "menu own two more"), (6, ""), (7, ""), (7, ""), (None, ""), (None, "left")]
    assert found == rows(spark.createDataFrame([(i, t, len(t)) for i, t in want], "page_id long, text string, n_chars long"))
    assert rows(H.extract(pages(spark, []))) == []


def test_pairs_do_not_depend_on_cuts(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, f"http://h{r.randint(0, 3)}/{r.randint(0, 40)}", page([f"m{r.randint(0, 3)}" for _ in range(6)] + [f"own {i}"])) for i in range(120)]
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (1, 4, 64):
        monkeypatch.setattr(H, "SAMPLES_PER_RANGE", ranges)
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        results.append(rows(H.extract(pages(spark, items)), "page_id", "url", "text"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    by_host = {}
    for i, url, h in items:
        by_host.setdefault(url.split("/")[2], []).append(("/" + url.split("/")[3], i, url, h))
    want = []
    for own in by_host.values():
        own.sort()
        for k, (_, i, url, h) in enumerate(own):
            lines = [t for _, t in H.lines(h)]
            other = own[k - 1] if k else own[1] if len(own) > 1 else None
            gone = H.shared([H._hash(t) for t in lines], [H._hash(t) for _, t in H.lines(other[3])]) if other else ()
            want.append((i, url, " ".join(t for j, t in enumerate(lines) if j not in gone)))
    assert results[0] == sorted(want)


def test_open_lines_beside_content_are_left_to_the_difference(spark):
    teaser = lambda i: f"<p>menu</p><article>teaser {i}</article><div><p>body {i}</p><p>foot</p></div>"
    found = rows(H.extract(pages(spark, [(i, f"http://h/{i}", teaser(i)) for i in (1, 2, 3)])), "page_id", "text")
    assert found == [(i, f"teaser {i} body {i}") for i in (1, 2, 3)]


def test_chrome_needs_whole_words_and_never_holds_the_page():
    text = lambda html, *kinds: [t for k, t in H.lines(html) if k in (kinds or (H.OPEN, H.CONTENT))]
    for c in ("home no-sidebar", "has-sidebar", "with-header", "cookies-not-set", "sidebar"):
        assert text(f"<body class='{c}'><nav>m</nav><p>own text of the page</p><footer>f</footer></body>") == ["own text of the page"]
    assert text("<body><form id='f'><nav>m</nav><div>own text of the page</div><div class='ad'>a</div></form></body>") == ["own text of the page"]
    assert text("<form><div>body</div><article>a longer teaser</article></form>") == ["body", "a longer teaser"]
    assert text("<head><title>t</title><body><p>x</p><nav>much longer</nav><p>also of the page</p>") == ["x", "also of the page"]
    page = "<article><header><h1>T</h1></header><p>a long paragraph</p>{}</article>"
    for c in ("section-header", "notices", "legal-text", "share-price"):
        assert text(page.format(f"<div class='{c}'>kept</div>"), H.CONTENT) == ["a long paragraph", "kept"]
    for c in ("notice", "legal", "x share"):  # in doubt
        assert text(page.format(f"<div class={c!r}>kept</div>"), H.OPEN) == ["T", "kept"]
    for a in ("class='ad'", "id=ad", "hidden", "role=banner", "class='x comments'"):
        assert text(page.format(f"<div {a}>gone</div>")) == ["T", "a long paragraph"]
    for a in ("data-id='ad'", "data-role='banner'", "data-hidden", "title='x hidden'"):
        assert text(page.format(f"<div {a}>kept</div>")) == ["T", "a long paragraph", "kept"]
    assert text("<article>x</article><footer>much longer than the article</footer>") == ["x"]
    assert text("<article>a long paragraph<div class=ad>gone</article><p>rest") == ["a long paragraph", "rest"]
    deep = "<div class=ad>" * 20_000
    assert text(deep + "x") == ["x"] and H.lines(deep) == []


def test_brute_force_over_pages_with_and_without_articles(spark):
    """Each line by a plain table of the longest common subsequence; tags break ties."""
    r = random.Random(8)

    def one(i):
        nav = "".join(f"<li>{x}</li>" for x in (["home", "news", f"m{r.randint(0, 2)}"] if r.random() < 0.7 else [f"only {i}"]))
        body = "".join(f"<p>{x}</p>" for x in ["quote", f"p{r.randint(0, 5)}", f"own {i}"][: r.randint(1, 3)])
        main = r.choice(["<article class='post no-sidebar'>{}</article>", "<div class='x no-sidebar'>{}</div>", "<main id='comment-policy'>{}</main>"])
        return f"<body class='has-menu no-comments'><nav>{nav}</nav><div>banner {r.randint(0, 1)}</div>{main.format(body)}<footer>foot</footer></body>"

    items = [(i, f"http://h{i % 2}/{r.randint(0, 30):02d}", one(i)) for i in range(80)]
    found = {p: (t, n) for p, t, n in rows(H.extract(pages(spark, items)), "page_id", "text", "n_shared")}
    by_host = {}
    for i, url, h in items:
        by_host.setdefault(url[:9], []).append((url[9:], i, h))
    changed = 0
    for own in by_host.values():
        own.sort()
        for k, (_, i, h) in enumerate(own):
            mine = H.lines(h)
            other = [t for _, t in H.lines(own[k - 1 if k else 1][2])]
            both = H.shared([t for _, t in mine], other)
            assert len(both) == length([t for _, t in mine], other)
            keep = [t for j, (kind, t) in enumerate(mine) if kind == H.CONTENT or kind == H.OPEN and j not in both]
            assert found[i] == (" ".join(keep), sum(mine[j][0] != H.CONTENT for j in both))
            changed += any(mine[j][0] == H.OPEN for j in both)
    assert changed > 20


def test_text_of_formulas_and_long_pages_stays(spark):
    assert [t for _, t in H.lines("<article><p>Let <math><mi>x</mi></math> be</p><object>o</object></article>")] == ["Let x be", "o"]
    long = "".join(f"<p>line {i}</p>" for i in range(30_000))
    found = rows(H.extract(pages(spark, [(1, "http://h/1", long + "<p>a</p>"), (2, "http://h/2", long + "<p>b</p>")])), "page_id", "text", "n_shared")
    assert found == [(1, "a", 30_000), (2, "b", 30_000)]


def test_compound_names_of_adverts_and_comments(spark):
    page = "<article><h1>T</h1><p>alpha beta</p><div class='ad-slot'>{}</div><div class='comments-area'><p>{}</p></div></article>"
    one = lambda *x: [(1, "http://h/1", page.format(*x))]
    found = lambda items: rows(H.extract(pages(spark, items)), "page_id", "text", "n_decided")
    assert found(one("Buy shoes", "I agree")) == [(1, "T alpha beta", 0)]
    assert found(one("Buy shoes", "I agree") + [(2, "http://h/2", page.format("Buy shoes", "I agree"))]) == [(1, "T alpha beta", 0), (2, "T alpha beta", 0)]
    prose = "In this part of the article an aside tells at some length what ad hoc means."
    body = "alpha beta, and so on for more than half of what the page says. " * 4
    long = lambda i, *x: (i, f"http://h/{i}", page.replace("alpha beta", body).format(*x))
    mine = long(1, prose, "I agree with each and every word that has been said here so far, dear friend.")
    assert found([mine]) == [(1, f"T {body}{prose}", 0)]
    assert found([mine, long(2, prose, "no")]) == [(1, f"T {body.strip()}", 1), (2, f"T {body.strip()}", 1)]
    kinds = lambda c: [k for k, t in H.lines(f"<article><p>a long paragraph of text</p><div class='{c}'>x</div></article>") if t == "x"]
    assert [kinds(c) for c in ("cookie-banner", "comment_list", "no-comments", "hero has-ad", "adhoc")] == [[H.LIKELY], [H.CHROME], [H.CONTENT], [H.CONTENT], [H.CONTENT]]
