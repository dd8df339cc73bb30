import time

import pytest

from eventloom.llm import html
from eventloom.llm.queries import op8_html_extraction

SENTENCE = "This sentence of the article goes on for quite a while, with commas and all. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, {SENTENCE}</p></div>
<div id="main"><h2>Head  &amp;\n line</h2><p>{SENTENCE * 3}</p><p>Fish &lt;b&gt; <b>bold</b>ly&nbsp;x &#233;</p><script>var x = "<p>no</p>";</script>
<div class="advert">{SENTENCE * 4}</div><form><p>{SENTENCE}</p></form><p>{SENTENCE * 2}<!-- hidden --></p></div>
<div class="comments"><p>Reader: {SENTENCE * 5}</p></div><aside>{SENTENCE}</aside><footer><p>Copyright {SENTENCE}</p></footer></body></html>"""


def test_article_only():
    s = SENTENCE.strip()
    assert html.main_text(PAGE) == " ".join(["Head & line", *[s] * 3, "Fish <b> boldly x é", *[s] * 2])


def test_all_that_reaches_the_threshold():
    def block(tag, name, n):
        return f"<{tag}>" + "".join(f"<p>{name}{i} {SENTENCE * 3}</p>" for i in range(n)) + f"</{tag}>"

    menu = '<div class="menu"><p>Menu <a href="/">home</a></p></div><div><a href="/a">More</a> <a href="/b">links</a></div>'
    for page in (
        f"<div>{block('section', 'a', 10)}{block('section', 'b', 6)}</div>",
        f"<main>{block('article', 'a', 10)}{block('article', 'b', 6)}</main>",
        f"<main>{block('article', 'a', 10)}{block('section', 'b', 6)}</main>",
        f"{block('article', 'a', 10)}<div>{block('section', 'b', 6)}</div>",
        f"{block('section', 'a', 10)}{block('article', 'b', 6)}",
    ):
        got = html.main_text(f"<body>{menu}{page}{menu}</body>")
        assert got == " ".join(f"{k}{i} {SENTENCE * 3}".strip() for k, n in (("a", 10), ("b", 6)) for i in range(n)), page
    long = SENTENCE * 8
    assert html.main_text(f"<div>{long}{block('section', 'a', 10)}</div>").startswith(long.strip() + " a0")


def test_density_decides(monkeypatch):
    """Nothing but link-adjusted text density tells the article from lists of links: with a constant density the result is another."""
    links = "".join(f'<li><a href="/{i}">A headline of some length number {i}</a></li>' for i in range(40))
    body = "".join(f"<p>{SENTENCE * 4}</p>" for _ in range(6))
    page = f"<body><div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div></body>"
    want = " ".join([SENTENCE.strip()] * 24)
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "_density", lambda n, body: 1.0)
    assert html.main_text(page) != want


WRAPPERS = ('<div class="page with-sidebar">', '<div id="content" class="has-sidebar">', '<div class="post no-ads">', '<div class="layout-comments-off">', '<section class="search-results-none article-body">', '<article><div class="entry share-enabled">', '<div class="menu"><div class="sidebar">')


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_do_not_take_an_article(wrapper):
    """Words of asides around the text with the largest sum of densities, also where they come again."""
    names = [x.split()[0] for x in wrapper[1:].replace(">", "").split("<")]
    end = "".join(f"</{n}>" for n in reversed(names))
    body = "".join(f"<p>{k} {SENTENCE * 3}</p>" for k in range(5))
    more = f"<p>more {SENTENCE * 3}</p>" * 3
    side = f'<div class="widget"><p>aside {SENTENCE}</p></div>'
    page = f"<body><nav><a href='/'>Home</a></nav>{wrapper}{body}{side}{end}{wrapper}{more}{end}<footer>Copyright {SENTENCE}</footer></body>"
    want = [*(f"{k} {SENTENCE * 3}".strip() for k in range(5)), *[f"more {SENTENCE * 3}".strip()] * 3]
    assert html.main_text(page) == " ".join(want)


def by_definition(page):
    """The node whose children's densities add up to most, from every subtree's own text and tags."""
    root = html.parse(page)

    def nodes(n):
        yield n
        for x in n.children:
            if isinstance(x, html._Node):
                yield from nodes(x)

    def count(n):
        text = [t for m in nodes(n) for t in m.children if isinstance(t, tuple)]
        size = lambda ts: sum(len("".join(t[0].split())) for t in ts)
        n.c, n.lc, n.t, n.lt = size(text), size([t for t in text if t[1]]), sum(1 for _ in nodes(n)) - 1, sum(links[id(m)] for m in nodes(n))
        return n

    links = {id(n): n.lt for n in nodes(root)}
    every = [count(n) for n in nodes(root)]
    def factor(n):
        return (html.LOWERED if n.aside else 1.0) * (factor(n.parent) if n.parent is not None else 1.0)

    for n in every:
        text = [(m, len("".join(t[0].split()))) for m in nodes(n) for t in m.children if isinstance(t, tuple)]
        n.factor = sum(k * factor(m) for m, k in text) / n.c if n.c else 1.0
    own = lambda n: factor(n) * sum(len("".join(t[0].split())) for t in n.children if isinstance(t, tuple) and not t[1])
    return max(sum(html._density(x, root) for x in n.children if isinstance(x, html._Node)) + own(n) for n in every)


def test_sums_by_definition(spark, small, monkeypatch):
    """The threshold's node has the largest sum of densities over all subtrees, each counted by itself."""
    seen = []
    keep = max

    def watch(*a, **k):
        out = keep(*a, **k)
        if a and isinstance(a[0], list) and a[0] and isinstance(a[0][0], html._Node) and a[0][0].parent is None:
            seen.append(k["key"](out))
        return out

    monkeypatch.setattr(html, "max", watch, raising=False)
    monkeypatch.setattr(html, "ASIDE_WORDS", set())
    monkeypatch.setattr(html, "HEADER_WORDS", set())
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(20).collect():
        seen.clear()
        html.main_text(r.html)
        assert seen and abs(seen[0] - by_definition(r.html)) < 1e-9 * seen[0]


def test_constant_density_changes_given_pages(spark, small, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    before = [html.main_text(p) for p in pages]
    monkeypatch.setattr(html, "_density", lambda n, body: 1.0)
    assert sum(a != html.main_text(p) for a, p in zip(before, pages, strict=True)) > 0.9 * len(pages)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "plain words"), (5, "u", "<p>open <p>next"), (6, "u", "</div></div><p>x</p>"), (7, "u", "<" * 2000), (8, "u", "<script>never closed"), (None, "u", "<p>a</p>"), (9, "u", "<p>a</p>"), (9, "u", "<p>a</p>")]
    d = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(d).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert (by[1], by[2], by[3], by[4], by[5], by[6], by[8], by[None], by[9]) == ("", "", "", "plain words", "open next", "x", "", "a", "a")
    assert html.extract(d.limit(0)).collect() == []


def test_deep_and_long_pages_take_linear_time():
    t = time.time()
    assert html.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert len(html.main_text(f"<article>{f'<p>{SENTENCE}</p>' * 20_000}</article>")) > 1_000_000
    assert time.time() - t < 60


def test_whole_table(spark, small):
    d = op8_html_extraction(spark, small).toPandas()
    assert len(d) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert (d["text"].str.len() == d["n_chars"]).all() and not d["text"].str.contains(r"\s\s|<script|<div").any()
    assert (d["n_chars"] > 0).mean() > 0.9
